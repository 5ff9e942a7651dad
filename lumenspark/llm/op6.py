"""Query of the repeated-string operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import read
from lumenspark.llm.suffixes import repeated_spans


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(read(spark, sf_dir, "documents"), width=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# SQL: a row for each byte of each text is too slow on whole tables; tests/llm/test_suffixes.py
# holds the query against brute force.
QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL: dict[str, str] = {}
