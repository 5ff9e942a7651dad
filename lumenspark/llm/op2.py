"""Query of the document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm.common import read
from lumenspark.llm.fingerprints import document_fingerprints


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(read(spark, sf_dir, "documents"))


# DuckDB has neither this xxhash nor Unicode compatibility forms; tests/llm/test_others.py
# holds the query against Python.
QUERIES = {"op2_document_fingerprints": op2_document_fingerprints}
SQL: dict[str, str] = {}
