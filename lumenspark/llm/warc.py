"""WARC records and a Merkle audit of replicas.

Pages become WARC 1.1 response records.  Records are kept in archives (ranges of page_id), in order
of page_id, and each has its byte offset there.  The audit hashes every record (SHA-256), then
ordered ranges of FANOUT hashes, with their places and lengths and so with their offsets, into the next
level up to the root of each archive, and the archives in the same way into one root.  Two replicas are compared from the root down: only children of nodes
that differ are looked at, until the records are found that are corrupt, missing or added.

Trees are built level by level with grouped aggregation; a group has at most FANOUT ranges, so no
task sees more than its share, and comparing moves hashes alone, never record bodies.  Levels are stored by
SLOTS of archives; below the first level a level's files are read only for slots in which something differs.

Rows: null urls and bodies are empty; a null page_id is in archive -1, place 0; rows that share a page_id
are one leaf, whose hash is that of their sorted hashes with the number of each, taken in two steps by leading
digits, so that no task holds all of them; extra columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.llm.common import only, saved, shared_folder

FANOUT = 64
#: Record places in an archive, and parts in which levels are stored.
ARCHIVE, SLOTS = 4096, 64


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, record binary): the WARC record of each page."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "")
    number = F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), 12, "0")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http.cast("binary"), body)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), number, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return only(pages, "page_id", "url", "html").select("page_id", "url", F.concat(head.cast("binary"), block, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def _joined(hashes: DataFrame) -> DataFrame:
    """(page_id, hash) -> (id, joined): one hash of all that share a page_id, whatever their order."""
    counted = hashes.groupBy("page_id", "hash").agg(F.count("*").alias("n"))
    line = lambda items: F.sha2(F.concat_ws(";", F.array_sort(F.collect_list(items))), 256)
    parts = counted.groupBy("page_id", F.substring("hash", 1, 4).alias("lead")).agg(line(F.concat_ws("*", "hash", F.col("n").cast("string"))).alias("part"))
    return parts.groupBy(F.col("page_id").alias("id")).agg(line(F.concat_ws(":", "lead", "part")).alias("joined"))


def leaves(recorded: DataFrame) -> DataFrame:
    """(page_id, record) -> (archive, place, page_id, length, hash): a leaf for each page_id."""
    one = recorded.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    found = one.groupBy("page_id").agg(F.sum("length").alias("length"), F.min("hash").alias("hash"), F.count("*").alias("n"))
    shared = found.where("n > 1").select(F.col("page_id").alias("id"))
    several = _joined(one.join(shared, F.col("page_id").eqNullSafe(F.col("id")), "left_semi"))
    told = found.join(several, F.col("page_id").eqNullSafe(F.col("id")), "left").withColumn("hash", F.coalesce("joined", "hash"))
    place = F.pmod("page_id", F.lit(ARCHIVE))
    archive = F.call_function("div", F.col("page_id") - place, F.lit(ARCHIVE).cast("long"))  # whole numbers: a double would part large ids
    return told.select(F.coalesce(archive, F.lit(-1)).cast("long").alias("archive"), F.coalesce(place, F.lit(0)).cast("long").alias("place"), "page_id", "length", "hash")


def _stored(nodes: DataFrame) -> DataFrame:
    """A level by slots of archives."""
    spark = nodes.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    nodes.withColumn("slot", F.pmod("archive", F.lit(SLOTS)).cast("int")).write.partitionBy("slot").parquet(path)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return spark.read.schema(f"{kinds}, slot int").parquet(path)


def _up(nodes: DataFrame, archive: Column, place: Column) -> DataFrame:
    """The next level: ordered children hashed together with their places and lengths, and the bytes below."""
    children = F.array_sort(F.collect_list(F.struct(F.col("place").alias("p"), F.col("length").cast("string").alias("n"), F.col("hash").alias("h"))))
    grouped = nodes.groupBy("replica", archive.alias("up"), place.alias("above")).agg(F.sum("length").alias("length"), F.concat_ws(";", F.transform(children, lambda c: F.concat_ws(":", c["p"].cast("string"), c["n"], c["h"]))).alias("line"))
    return grouped.select("replica", F.col("up").alias("archive"), F.col("above").alias("place"), "length", F.sha2("line", 256).alias("hash"))


def _range_of(place: str | Column) -> Column:
    return F.floor((F.col(place) if isinstance(place, str) else place) / FANOUT).cast("long")


def trees(leaf: DataFrame) -> list[tuple[str, DataFrame]]:
    """(replica, archive, place, length, hash, slot) leaves -> stored levels from the leaves up to one root for each replica.

    A level is within archives, or, above their roots, over them (archive 0, place of archive a is a + 1).
    """
    levels = [("within", leaf)]
    size = ARCHIVE
    while size > 1:
        levels.append(("within", _stored(_up(levels[-1][1], F.col("archive"), _range_of("place")))))
        size = -(-size // FANOUT)
    most = levels[-1][1].agg(F.max("archive")).first()[0]
    over = levels[-1][1].select("replica", F.lit(0).cast("long").alias("archive"), (F.col("archive") + 1).alias("place"), "length", "hash")
    levels.append(("over", over))
    size = (most if most is not None else -1) + 2
    while size > 1:
        levels.append(("over", saved(_up(levels[-1][1], F.col("archive"), _range_of("place")))))
        size = -(-size // FANOUT)
    return levels


def _differ(nodes: DataFrame, among: DataFrame | None) -> DataFrame:
    """Nodes of one level that differ between the replicas, of those below the nodes given."""
    if among is not None:
        if "slot" in nodes.columns:  # SLOTS numbers at most
            slots = [r.slot for r in among.select(F.pmod("archive", F.lit(SLOTS)).cast("int").alias("slot")).distinct().collect()]
            nodes = nodes.where(F.col("slot").isin(slots))
        keys = among.select("archive", F.col("place").alias("above"))
        nodes = nodes.withColumn("above", _range_of("place")).join(keys, ["archive", "above"], "left_semi")
    of = lambda r: F.max(F.when(F.col("replica") == r, F.col("hash")))
    return nodes.groupBy("archive", "place").agg(of(0).alias("ha"), of(1).alias("hb")).where(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(both: DataFrame) -> DataFrame:
    """Leaves of two replicas (0 and 1) -> (archive, place, ha, hb): the records that differ, found by descending from the roots."""
    bad, kind = None, "over"
    levels = trees(both)
    for i, (level, nodes) in enumerate(reversed(levels)):
        if kind == "over" and level == "within":  # from the archives to their roots, the same nodes
            kind, bad = level, bad.select((F.col("place") - 1).alias("archive"), F.lit(0).cast("long").alias("place"))
            if i + 1 < len(levels):
                continue
        bad = saved(_differ(nodes, bad))
    return bad


def fixity(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records (page_id, record) of two replicas -> a row for each page_id: where it lies, its hash, and its state.

    (page_id, archive, offset, length, hash, state): offset and length are those of the primary
    replica, null if it lacks the record; state is ok, corrupt, missing (not in the replica) or
    added (only there).
    """
    both = _stored(leaves(primary).withColumn("replica", F.lit(0)).union(leaves(replica).withColumn("replica", F.lit(1))))
    a, b = both.where("replica = 0"), both.where("replica = 1")
    bad = audit(both.select("replica", "archive", "place", "length", "hash", "slot")).select("archive", "place", F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "added").otherwise("corrupt").alias("found"))
    before = Window.partitionBy("archive").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = a.select("archive", "place", "page_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "hash")
    new = b.join(bad.where("found = 'added'"), ["archive", "place"], "left_semi").select("archive", "place", "page_id", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"), "hash")
    return placed.union(new).join(bad, ["archive", "place"], "left").select("page_id", "archive", "offset", "length", "hash", F.coalesce("found", F.lit("ok")).alias("state"))
