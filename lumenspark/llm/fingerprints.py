"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

The canonical form of a text is Unicode-normalised (NFKC, composed), case-folded, and has each run of
white space as one blank, none at the ends.  The digest is two chained 64-bit xxhashes of it (128
bits); rows with equal digests form a bucket.  Inside a bucket the canonical bytes are compared, by
the least and the greatest of them, which partial aggregation shrinks before the shuffle, so that a
text that a third of all rows share is no burden.  Edited texts, which are not kept, are compared with
those of their bucket by SHA-256.  In a bucket with differences, each fingerprint gets a SHA-256 suffix,
so equal fingerprints always mean equal canonical texts.

Normalisation and case folding call the ICU library that comes with Spark through ``java_method``.

Neighbours in descending doc_id come without a global sort: doc_id is cut into cells at approximate
quantiles, an id that several of them hit has as many cells, by a hash of the text; the first row of
each cell is also sent to the cell that precedes it, and each cell is sorted by itself.  The table of
first rows, one for each cell, is broadcast with digests in place of texts.  Rows equal in id and text that are
more than one in OFTEN of all are sorted as one, which counts as many; their results become as many again at the
end, in parts, when they hold no text.  At most OFTEN such groups can exist, so that their list, too, may be broadcast.

Rows: a null text is the empty text; the canonical form of blank texts is empty; rows with one
doc_id are ordered by cell, then by the SHA-256 of the text, null ids come last in an order of their texts' hashes; repeated rows are rows of their own; the next row of the
last is the first, of a single row itself; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.llm.common import only, saved, shuffle_partitions

#: Groups of equal rows with more than one row in so many are sorted as one row, if they are more than LEAST.
OFTEN, LEAST = 10_000, 1000
#: Equal rows that are made of one at a time.
PART = 10_000
_NORMALIZER, _CHARACTERS = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """The canonical form of a text that is not null."""
    plain = text.rlike(r"\A[\x00-\x7f]*\z")
    composed = F.java_method(F.lit(_NORMALIZER), F.lit("compose"), text, F.lit(True))
    folded = F.java_method(F.lit(_CHARACTERS), F.lit("foldCase"), composed, F.lit(True))
    again = F.java_method(F.lit(_NORMALIZER), F.lit("compose"), folded, F.lit(True))  # folding may undo composition
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(again), r"[\s\x{85}\p{Z}]+", " "))


def digest(text: Column) -> Column:
    """128 bits of a canonical text in lowercase hex."""
    first = F.xxhash64(F.lit(1), text)
    return F.lower(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(F.xxhash64(first, text)), 16, "0")))


def expanded(rows: DataFrame) -> DataFrame:
    """Each row as often as its copies say; groups of equal ones are dealt to tasks in parts."""
    once = rows.where("copies = 1").drop("copies")
    parts = rows.where("copies > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / PART))))
    parts = parts.repartition(shuffle_partitions(rows.sparkSession), F.xxhash64("doc_id", "part"))
    inside = F.least(F.col("copies") - F.col("part") * PART, F.lit(PART))
    again = parts.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), inside))).select(once.columns)
    return once.union(again)


def with_next(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text) -> (doc_id, text, next_id, next_text, copies): the next row in descending doc_id, after the last the first.

    copies: how many rows are meant; of equal rows, each is followed by the next, and the last by what follows them all.
    """
    rows = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    cells = 8 * shuffle_partitions(docs.sparkSession)
    found = rows.agg(F.percentile_approx("doc_id", [i / cells for i in range(1, cells)], 10 * cells + 10_000).alias("q"), F.count("*").alias("n")).first()
    borders = F.lit(found.q or []).cast("array<bigint>")
    steps = F.lit([1 << i for i in reversed(range(cells.bit_length()))])
    # borders up to the id, and those below it, by bisection
    upto = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(borders, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(borders, at + step - 1) < F.col("doc_id"), at + step).otherwise(at))
    hashed = F.xxhash64("text")
    rows = rows.select("*", upto.alias("upto"), below.alias("below"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    of_id = F.when(F.col("upto") == F.col("below"), F.col("upto")).otherwise(F.col("below") + 1 + F.pmod(hashed, F.col("upto") - F.col("below"))).cast("long")
    rows = rows.select("doc_id", "text", "sha", F.when(F.col("doc_id").isNotNull(), of_id).otherwise(-1 - F.pmod(hashed, F.lit(cells))).alias("cell"))
    # a row for each cell, 16 * shuffle partitions at most: its first row, and the cell that comes before it
    heads = rows.groupBy("cell").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("down"), "sha")).alias("first"))
    heads = heads.select("cell", F.bitwise_not("first.down").alias("head"), F.col("first.sha").alias("head_sha"))
    every = Window.orderBy("cell")
    target = F.coalesce(F.lead("cell").over(every), F.min("cell").over(Window.orderBy(F.lit(1))))
    heads = heads.select(F.col("cell").alias("c"), "head", "head_sha", target.alias("target"))
    # OFTEN groups of equal rows at most
    often = rows.groupBy(F.col("doc_id").alias("d"), F.col("sha").alias("s")).agg(F.count("*").alias("copies")).where(F.col("copies") > max(least, found.n // OFTEN))
    marked = rows.join(F.broadcast(often), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s")), "left")
    alone = marked.where("copies IS NULL").select("doc_id", "text", "sha", "cell", F.lit(1).cast("long").alias("copies"))
    as_one = marked.where("copies IS NOT NULL").groupBy("doc_id", "sha", "cell", "copies").agg(F.first("text").alias("text")).select("doc_id", "text", "sha", "cell", "copies")
    rows = alone.union(as_one)
    is_head = (F.col("cell") == heads["c"]) & (F.col("doc_id").eqNullSafe(F.col("head"))) & (F.col("sha") == F.col("head_sha"))
    sent_to = F.array_compact(F.array(F.struct(F.col("cell").alias("at"), F.lit(0).alias("sent")), F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("at"), F.lit(1).alias("sent")))))
    sent = rows.join(F.broadcast(heads), is_head, "left").select("doc_id", "text", "sha", "copies", F.explode(sent_to).alias("copy")).select("doc_id", "text", "sha", "copies", "copy.*")
    window = Window.partitionBy("at").orderBy("sent", F.desc_nulls_last("doc_id"), "sha")
    led = sent.select("*", F.lead("doc_id").over(window).alias("next_id"), F.lead("text").over(window).alias("next_text")).where("sent = 0")
    last = F.struct("next_id", "next_text", F.lit(1).cast("long").alias("copies"))
    others = F.when(F.col("copies") > 1, F.struct(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"), (F.col("copies") - 1).alias("copies")))
    return led.select("doc_id", "text", F.explode(F.array_compact(F.array(last, others))).alias("then")).select("doc_id", "text", "then.*")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> digests of each row's text and edited text, their likeness, SHA-256 of the canonical forms, and copies.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many,
    or all, of the next row's text.
    """
    led = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = led.select("doc_id", "copies", n.cast("long").alias("n_chars"), edited.alias("edited_text"), canonical(F.col("text")).alias("c"), canonical(edited).alias("e"), canonical(F.col("next_text")).alias("x"))
    return made.select(
        "doc_id",
        "copies",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("c")).alias("digest"),
        digest(F.col("e")).alias("edited_digest"),
        F.sha2(F.col("c").cast("binary"), 256).alias("sure"),
        F.sha2(F.col("e").cast("binary"), 256).alias("edited_sure"),
        (F.col("c") == F.col("e")).cast("double").alias("near_edited"),
        (F.col("c") == F.col("x")).cast("double").alias("near_next"),
    )


def collisions(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Those of the repeated digests whose rows have different canonical bytes."""
    texts = only(docs, "text").select(canonical(F.coalesce("text", F.lit(""))).alias("bytes"))
    inside = texts.withColumn("bucket", digest(F.col("bytes"))).join(repeated, "bucket", "left_semi")
    return inside.groupBy("bucket").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where("least <> most").select("bucket")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = saved(fingerprints(docs))
    repeated = rows.groupBy(F.col("digest").alias("bucket")).count().where("count > 1").select("bucket")
    both = rows.select(F.col("digest").alias("bucket"), "sure").union(rows.select("edited_digest", "edited_sure"))
    apart = both.groupBy("bucket").agg(F.min("sure").alias("least"), F.max("sure").alias("most")).where("least <> most").select("bucket")
    bad = saved(collisions(docs, repeated).union(apart).distinct())
    own, other = bad.select(F.col("bucket").alias("own")), bad.select(F.col("bucket").alias("other"))
    told = rows.join(own, rows["digest"] == own["own"], "left").join(other, rows["edited_digest"] == other["other"], "left")
    name = lambda base, sure, hit: F.concat(F.col(base), F.when(F.col(hit).isNotNull(), F.concat(F.lit("-"), F.col(sure))).otherwise(F.lit("")))
    return expanded(told.select("doc_id", "copies", "n_chars", "edited_sha256", name("digest", "sure", "own").alias("fingerprint"), name("edited_digest", "edited_sure", "other").alias("edited_fingerprint"), "near_edited", "near_next"))
