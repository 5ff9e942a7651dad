"""Query of the near-duplicate operator, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm.common import read
from lumenspark.llm.near_dedup import near_duplicates


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


# SQL: all pairs of documents that share a shingle, and a recursive walk, are too slow on whole
# tables; tests/llm/test_near_dedup.py holds the query against brute force.
QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
SQL: dict[str, str] = {}
