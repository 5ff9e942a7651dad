"""Tables in the order of a key, written and read without sorting them in one task.

Rows are dealt to ranges of the key and sorted within each; a range is a file, and files are named
in the order of the ranges, so that the files one after the other are the sorted table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_ordered(df: DataFrame, path: str, *keys: str, files: int | None = None, form: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table in the order of keys (nulls first); rows that tie in all keys may come in any order."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).write.mode(mode)
    (writer.csv(path, header=True) if form == "csv" else writer.parquet(path))


def read_ordered(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """A Parquet table with each row's place in the order of its files, from 1.

    Files are counted first, a row for each; each row's place is its place in its file after the rows of the files before.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))  # a row for each file
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_file", before.alias("_before"))
    return rows.join(offsets, "_file").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_file", "_at", "_before")
