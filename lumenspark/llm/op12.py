"""Query of the whitening of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm.common import read
from lumenspark.llm.whitening import whitened


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=64.0, most=32)


# SQL has no eigenvectors; tests/llm/test_whitening.py holds the query against a plain eigensolver in whole numbers.
QUERIES = {"op12_embedding_whitening": op12_embedding_whitening}
SQL: dict[str, str] = {}
