"""Batches of rows that count only once they are committed.

A batch is written aside, under its own name, and then a marker of one row says that it is whole.
Readers take committed batches alone, so a job that dies in between leaves nothing that anyone sees,
and running it again under the same name writes the batch anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def is_committed(spark: SparkSession, folder: str, batch: str) -> bool:
    try:
        return not spark.read.schema("done long").parquet(f"{folder}/commits/batch={batch}").isEmpty()
    except AnalysisException:  # no marker
        return False


def write_batch(df: DataFrame, folder: str, batch: str) -> None:
    """Write a batch's rows, then its marker.

    A batch that is committed stays as it is; what one of that name left unfinished is replaced.
    """
    spark = df.sparkSession
    if is_committed(spark, folder, batch):
        return
    df.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
    spark.range(1).selectExpr("id AS done").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")


def read_committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all committed batches, with the batch of each; batches that are not committed are not read."""
    whole = f"{schema}, batch string"
    try:
        done = spark.read.schema("done long, batch string").parquet(f"{folder}/commits").where("done is not null").select("batch")
        return spark.read.schema(whole).parquet(f"{folder}/rows").join(done, "batch", "left_semi")
    except AnalysisException:  # nothing yet
        return spark.createDataFrame([], whole)
