"""Query of the packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm.common import read
from lumenspark.llm.op4 import tokenizer_path
from lumenspark.llm.packing import pack


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end=2)


# SQL has no tokenizer; tests/llm/test_packing.py checks pieces against the library and the plan
# against its own rules and the lower bound.
QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
SQL: dict[str, str] = {}
