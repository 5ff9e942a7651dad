"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import read
from lumenspark.llm.language import fit_on, identify


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    network = fit_on(docs, ~held_out())
    return identify(docs, network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


# SQL can't fit the network; tests/llm/test_others.py measures held-out accuracy.
QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
