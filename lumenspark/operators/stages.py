"""Restart of a chain of stages: what each stage still lacks is found by its keys, and only that is made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = "position int, stage string, status string, n_wanted long, n_made long"


@dataclass(frozen=True)
class Stage:
    """A table of rows with the keys; wanted gives all keys, made the rows of some of them."""

    name: str
    path: str
    keys: tuple[str, ...]
    wanted: Callable[[SparkSession], DataFrame]
    made: Callable[[DataFrame], DataFrame]


def stored(spark: SparkSession, stage: Stage) -> DataFrame | None:
    """The stage's table, or None if it was never written."""
    try:
        return spark.read.parquet(stage.path)
    except AnalysisException:
        return None


def missing(spark: SparkSession, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(all wanted keys, those without a row); null keys are wanted by nobody."""
    wanted = stage.wanted(spark).select(*stage.keys).dropna().distinct()
    have = stored(spark, stage)
    return wanted, wanted if have is None else wanted.join(have.select(*stage.keys).distinct(), list(stage.keys), "left_anti")


def restart(spark: SparkSession, stages: list[Stage]) -> DataFrame:
    """Check the stages in order, append the rows of missing keys, and report one row for each: found or regenerated.

    A later stage may read the tables of those before it, for it is checked when they are complete.  A
    stage without wanted keys and without a table is reported as empty.
    """
    rows = []
    for position, stage in enumerate(stages, 1):
        wanted, left = missing(spark, stage)
        n_wanted, n_left = wanted.count(), left.count()
        if n_left:
            stage.made(left).write.mode("append").parquet(stage.path)
        status = "regenerated" if n_left else "found" if n_wanted else "empty"
        rows.append((position, stage.name, status, n_wanted, n_left))
    return spark.createDataFrame(rows, SUMMARY)


def status_counts(summary: DataFrame) -> DataFrame:
    """How many stages have each status."""
    return summary.groupBy("status").agg(F.count("*").alias("n_stages"), F.sum("n_made").alias("n_made"))
