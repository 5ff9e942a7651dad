"""Query of the token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspark.llm.common import read
from lumenspark.llm.tokens import token_counts


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


# SQL has no tokenizer; tests/llm/test_tokens.py holds the counts against the library.
QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
