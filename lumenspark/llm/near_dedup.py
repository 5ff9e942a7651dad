"""Near-duplicate detection: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

A document is the set of its hashed word shingles.  One hash of each shingle is dealt to BINS bins
by its leading bits and the least value of a bin is kept (one-permutation hashing); an empty bin
borrows from the first filled bin of its own fixed random order (optimal densification).  Bands of
three bins make bucket keys: two sets of similarity 0.8 miss all BANDS buckets with probability
(1 - 0.8**3) ** BANDS, below 1e-9.

Documents with equal words in equal order are one node, by BLAKE2b of their words.  In each bucket every
node is paired with the bucket's smallest node alone (a star), so candidate pairs follow the number of bucket
members.  Links are confirmed on the words themselves: shingles are numbered without hashing, and the sets of
numbers are compared.  A bucket whose members then lie in several components may hold links
between two spokes.  In such buckets alone, the members outside the main component are compared with all:
signatures rule out most pairs (five standard errors below the threshold; sets of few shingles are never
ruled out) and full sets decide the rest, so no link is lost to the star form.  The main component is
dealt to blocks, and the others, few as a rule, go to each of them.  Where the others are more than a
block, the bucket is first split by a second band, also of MORE_BANDS further ones that are used for this
alone: a pair at the threshold that shares one band of BANDS and none of the others has a probability of
3e-12, far below that of sharing none.

Texts are not shuffled, but those of candidates: their words are taken where the texts are read, which a table
of bits of bounded size (BITS at most) picks; what it lets through by chance is dropped by a join.  Joins on a key
that many rows may share (a bucket, a hub, equal texts) deal those rows to several places.

Rows: null, empty or wordless texts have no shingles and link with nothing; rows that share a
doc_id count as one document; a row with null doc_id gets its own counts, is never linked and has
a null component_id.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import map_batches, only, saved
from lumenspark.llm.components import components, salted_join
from lumenspark.llm.textbytes import BLANK_SEPARATED, byte_values, coded, mix, shingles, utf8, words

BINS, ROWS, BANDS, MORE_BANDS = 128, 3, 30, 12
#: Shingles of the sets in a block, and pairs of a hub in one place of a join.
BLOCK, PAIRS = 1_000_000, 512
#: Bits of the table of candidates: 16 for each candidate, and so many at most.
BITS = 1 << 27
#: Sets of so few shingles are compared without a look at their signatures.
FEW = 32
_SHIFT = np.uint64(57)
_ORDER = np.argsort(np.random.default_rng(20240501).random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)
_FLOORS = np.arange(BINS, dtype=np.uint64) << _SHIFT


def signature(members: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted, non-empty set of 64-bit hashes."""
    first = np.searchsorted(members, _FLOORS)
    least = members[np.minimum(first, len(members) - 1)]
    filled = (least >> _SHIFT) == np.arange(BINS, dtype=np.uint64)
    filled &= first < len(members)
    if not filled.all():
        empty, full = np.flatnonzero(~filled), np.flatnonzero(filled)
        least[empty] = least[full[np.argmin(_ORDER[np.ix_(empty, full)], axis=1)]]
    return least


def _sets(batch, width: int) -> Iterator[np.ndarray]:
    hashes, _, rows = words(*utf8(batch.column("text")), BLANK_SEPARATED)
    hashed, at = shingles(hashes, rows, width)
    for i in range(len(at) - 1):
        yield hashed[at[i] : at[i + 1]]


def _words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z as a-z."""
    return (text or "").encode().lower().split()


def _digest(words_: bytes) -> tuple[int, int]:
    """Two numbers that name the words of a text."""
    both = np.frombuffer(hashlib.blake2b(words_, digest_size=16).digest(), np.int64)
    return int(both[0]), int(both[1])


def _size(hashed: np.ndarray, members: np.ndarray, words_: list[bytes], width: int) -> int:
    """The number of distinct shingles: that of their hashes, and by the words where hashes repeat."""
    if len(members) == len(hashed):
        return len(members)
    return len(set(zip(*[words_[j:] for j in range(width)], strict=False)))


def _sketch(width: int):
    def run(batches):
        factors = byte_values(5)[:ROWS] | np.uint64(1)
        used = BANDS + MORE_BANDS
        for batch in batches:
            n, d1, d2, bands, signs = [], [], [], [], []
            for text, hashed in zip(batch.column("text"), _sets(batch, width), strict=True):
                words_, members = _words(text.as_py()), np.unique(hashed)
                n.append(_size(hashed, members, words_, width))
                a, b = _digest(b" ".join(words_))
                d1.append(a)
                d2.append(b)
                if len(members):
                    s = signature(members)
                    key = mix((s[: used * ROWS].reshape(used, ROWS) * factors).sum(axis=1, dtype=np.uint64))
                    bands.append(key.view(np.int64))
                    signs.append((s & np.uint64(0xFF)).astype(np.uint8).tobytes())
                else:
                    bands.append(None)
                    signs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "bands", "sign"])

    return run


def _bit(bits: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(bits))


def _bits(ids: DataFrame, bits: int) -> np.ndarray:
    """A table of bits with those of the ids set, made in parts of 32768 bits by the executors."""
    each = 1 << 15
    parts = ids.select(_bit(bits).alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(each - 1)).alias("some"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():  # BITS / 8 bytes at most
        out[row.part * each // 8 : (row.part + 1) * each // 8] = np.frombuffer(row.some, np.uint8)[: len(out)]
    return out


def _full_words(bits: np.ndarray):
    def run(batches):
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            some = batch.filter(pa.array(((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)))
            texts = [b" ".join(_words(t.as_py())) for t in some.column("text")]
            digests = [_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(texts, pa.binary())], names=["node", "e1", "e2", "words"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(width: int, percent: int):
    def run(batches):
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            hubs = dict(zip(u.to_pylist(), range(batch.num_rows), strict=True))  # a hub's words stand in each of its rows
            at = {h: i for i, h in enumerate(hubs)}
            left, right = batch.column("a"), batch.column("b")
            sets = coded((x.as_py().split() for x in (*(left[i] for i in hubs.values()), *right)), width)
            keep = [_similar(sets[at[h]], members, percent) for h, members in zip(u.to_pylist(), sets[len(hubs) :], strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], names=["u", "v"])

    return run


def _within_blocks(width: int, percent: int):
    """Links between members of different components of one bucket, of those on the left with those on the right."""
    least = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / BINS)

    def run(table: pa.Table) -> pa.Table:
        t = table.drop_columns(["words"]).to_pydict()
        node, group = np.array(t["node"]), np.array(t["component"])
        left, right = np.array(t["left"], bool), np.array(t["right"], bool)
        sign = np.frombuffer(b"".join(t["sign"]), np.uint8).reshape(-1, BINS)
        sets = coded((x.as_py().split() for x in table.column("words")), width)
        size = np.array([len(x) for x in sets])
        found = []
        for x in np.flatnonzero(left).tolist():
            y = np.flatnonzero(right & (group != group[x]))
            if right[x]:
                y = y[~left[y] | (y > x)]  # a pair on both sides is looked at once
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            if not len(y):
                continue
            likely = (sign[y] == sign[x]).mean(axis=1)
            for k in y[(likely >= least) | (size[y] <= FEW)]:
                if group[k] != group[x] and _similar(sets[x], sets[k], percent):
                    found.append((node[x], node[k]))
                    group[group == group[k]] = group[x]
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v, n) whose sets are similar; n tells how many pairs u may have."""
    places = lambda n: F.greatest(F.ceil(F.col(n) / PAIRS), F.lit(1)).cast("int")
    hubs = pairs.groupBy("u").agg(F.max("n").alias("most"))
    left = hubs.join(sets.select(F.col("node").alias("u"), F.col("words").alias("a")), "u").select("u", "a", F.explode(F.sequence(F.lit(0), places("most") - 1)).alias("salt"))
    right = pairs.join(sets.select(F.col("node").alias("v"), F.col("words").alias("b")), "v").withColumn("salt", F.pmod(F.xxhash64("v"), places("n")).cast("int"))
    return map_batches(right.join(left, ["u", "salt"]).select("u", "v", "a", "b"), _confirm(width, percent), "u long, v long")


def _opened(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the buckets with several components, with the shingles of the largest (bulk) and of the others (rest)."""
    parts = rows.groupBy(*by, "component").agg(F.sum("size").alias("w"))
    largest = F.max(F.struct("w", "component"))
    mixed = parts.groupBy(*by).agg(F.count("*").alias("n"), largest.alias("main"), F.sum("w").alias("total")).where("n > 1")
    return salted_join(rows, mixed.select(*by, F.col("main.component").alias("main"), F.col("main.w").alias("bulk"), (F.col("total") - F.col("main.w")).alias("rest")), by, "node")


_PART = ["band", "key", "band2", "key2"]


def _dealt(opened: DataFrame, crossed: bool) -> DataFrame:
    """Rows of opened buckets for each block, or pair of blocks, in which they are compared, and on which sides."""
    blocks = F.greatest(F.ceil((F.col("bulk") + F.col("rest") if crossed else F.col("bulk")) / BLOCK), F.lit(1)).cast("int")
    rows = opened.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    every = F.sequence(F.lit(0), blocks - 1)
    if crossed:
        rows = rows.withColumn("other", F.explode(every)).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        sides = {"left": F.col("block") == F.col("i"), "right": F.col("block") == F.col("j")}
    else:
        stray = F.col("component") != F.col("main")
        rows = rows.withColumn("i", F.explode(F.when(stray, every).otherwise(F.array("block")))).withColumn("j", F.lit(-1))
        sides = {"left": stray, "right": ~stray | (F.col("i") == 0)}
    return rows.withColumns(sides).select(*_PART, "i", "j", "node", "component", "left", "right")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id, kept); width in words, percent of Jaccard similarity."""
    sketches = saved(map_batches(only(docs, "doc_id", "text"), _sketch(width), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sign binary"))
    some = sketches.where("n_shingles > 0 and doc_id is not null")
    # equal words have equal bands and signatures
    nodes = saved(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("size"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("sign").alias("sign")))
    banded = nodes.select("node", "size", F.posexplode(F.slice("bands", 1, BANDS)).alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = saved(salted_join(banded, hubs, ["band", "key"], "node").select("band", "key", "hub", "n", "node", "size"))

    candidates = saved(members.select(F.col("node").alias("doc_id")).distinct())
    bits = min(BITS, max(1 << 15, 1 << (16 * candidates.count()).bit_length()))
    texts = only(docs, "doc_id", "text").where("doc_id is not null").select("doc_id", "text", _bit(bits).alias("bit"))
    made = map_batches(texts, _full_words(_bits(candidates, bits)), "node long, e1 long, e2 long, words binary")
    wanted = nodes.select("node", "d1", "d2").join(candidates.withColumnRenamed("doc_id", "node"), "node", "left_semi")
    sets = saved(made.join(wanted, "node").where("e1 = d1 and e2 = d2").dropDuplicates(["node"]).select("node", "words"))

    pairs = members.where("hub <> node").groupBy(F.col("hub").alias("u"), F.col("node").alias("v")).agg(F.max("n").alias("n"))
    links = saved(_confirmed(pairs, sets, width, percent))
    first = saved(components(links))

    # buckets with members in several components; those with many outside the main one by a second band
    placed = members.where("n > 2").join(first, "node", "left").select("band", "key", "node", "size", F.coalesce("component", "node").alias("component"))
    opened = saved(_opened(placed, ["band", "key"]))
    simple = opened.where(F.col("rest") <= BLOCK).withColumns({"band2": F.lit(-1), "key2": F.lit(0).cast("long")})
    second = opened.where(F.col("rest") > BLOCK).select("band", "key", "node", "size", "component").join(nodes.select("node", F.posexplode("bands").alias("band2", "key2")), "node").where("band2 > band")
    split = _opened(second, _PART)
    dealt = _dealt(simple, False).union(_dealt(split.where(F.col("rest") <= BLOCK), False)).union(_dealt(split.where(F.col("rest") > BLOCK), True))
    more = dealt.join(nodes.select("node", "sign").join(sets, "node"), "node").groupBy(*_PART, "i", "j").applyInArrow(_within_blocks(width, percent), "u long, v long")

    # each row's node, and links between the nodes of rows that share an id
    named = saved(salted_join(some.select("doc_id", "n_shingles", "d1", "d2"), nodes.select("d1", "d2", "node"), ["d1", "d2"], "doc_id").select("doc_id", "n_shingles", "node"))
    shared = named.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("most")).where("u < most").select("doc_id", "u")
    same = named.join(shared, "doc_id").where("u <> node").select("u", F.col("node").alias("v"))
    found = components(links.union(more).union(same))
    linked = named.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    rest = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(rest).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
