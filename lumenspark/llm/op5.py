"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import read
from lumenspark.llm.quality import quality_scores, train


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = train(docs, read(spark, sf_dir, "labels"), ~held_out())
    scored = quality_scores(docs, machine).select("carried.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# SQL can't fit the model; tests/llm/test_others.py measures held-out accuracy.
QUERIES = {"op5_quality_classifier": op5_quality_classifier}
SQL: dict[str, str] = {}
