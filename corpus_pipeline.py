"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents, and columns of other names in the order in which they come.

Rows: a null or empty text is scored as an empty one, has no near duplicates, loses nothing, contains no
item and is packed as its end token, if the classifier lets it through.  Where stages go by doc_id, a row
with a null id is a document of its own, named by a hash of its text; rows that share an id are one
document, and of rows equal in id and text near_dedup leaves one.  Of a group of near duplicates, the
document with the least id stays, a null id counting as large.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import read, saved
from lumenspark.llm.decontamination import contaminated
from lumenspark.llm.near_dedup import near_duplicates
from lumenspark.llm.op4 import tokenizer_path
from lumenspark.llm.packing import pack
from lumenspark.llm.quality import quality_scores, train
from lumenspark.llm.suffixes import repeated_spans

#: Passages of over 50 words go; the shortest has 51 of one byte and the blanks between them.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 101


def _key() -> Column:
    """The id of a document; where it is null, a large number by its text."""
    return F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 1).bitwiseOR(F.lit(1 << 62)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: all with a score of 0.5 or more."""
    machine = train(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return quality_scores(docs, machine, carry=tuple(docs.columns), least=0.5).select("carried.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one of rows equal in id and text."""
    found = near_duplicates(docs.select(_key().alias("doc_id"), "text"), width=5, percent=80)
    dropped = found.where("not kept").select(F.col("doc_id").alias("_key")).distinct()
    again = docs.groupBy(_key().alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again")
    left = docs.join(dropped, _key() == dropped["_key"], "left_anti")
    once, several = (left.join(again, _key() == again["_again"], how) for how in ("left_anti", "left_semi"))
    return once.union(several.dropDuplicates(["doc_id", "text"])).select(docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that an earlier document has; a text of which nothing is left goes.

    A character that a passage parts goes as a whole, a null text leaves as an empty one, and n_chars follows the text.
    """
    carry = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    found = repeated_spans(docs, width=PASSAGE_BYTES, least_words=PASSAGE_WORDS, filler=b" ", carry=carry, whole_characters=True)
    rows = found.select("carried.*", F.col("kept").cast("string").alias("text"), (F.size("spans") > 0).alias("changed"))
    return rows.where("not changed or trim(text) <> ''").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; what contains one goes, also where its id is null."""
    bad = contaminated(docs.select(_key().alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"), width=5, percent=80)
    bad = bad.select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(bad, _key() == bad["_key"], "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece of a document."""
    return pack(docs, tokenizer_path(), capacity=1024, end=2)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_others.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
