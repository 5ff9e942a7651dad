"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder and read again: later work starts there, also after a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that columns of a caller's table can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Bytes of a batch that a Python worker gets at once, unless the session says otherwise.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """Let the session cut the batches for Python workers by bytes, so that long texts don't add up; a smaller limit of its own stays."""
    if int(str(spark.conf.get(_BATCH)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, after which the worker, which later stages use again, gives freed memory back."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return run


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow in batches that are bounded in bytes."""
    in_small_batches(df.sparkSession)
    return df.mapInArrow(released(function), schema)
