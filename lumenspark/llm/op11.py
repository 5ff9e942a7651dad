"""Query of BPE encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.bpe import decoded, encoded
from lumenspark.llm.common import read
from lumenspark.llm.op4 import tokenizer_path


def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(read(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))


# SQL has no tokenizer; tests/llm/test_bpe.py holds ids and texts against the library.
QUERIES = {"op11_bpe_encoding": op11_bpe_encoding}
SQL: dict[str, str] = {}
