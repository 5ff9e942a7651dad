"""Benchmark decontamination: which documents contain which test items.

An item is contained in a document if at least ``percent`` of the item's distinct word shingles are
among the document's.  Long documents make Jaccard similarity useless here, so the search is for
containment, with MinHash sketches of the items only:

* Items are partitioned by size (number of distinct shingles, in powers of two).  The sketch of an
  item is its ``k`` least shingle hashes; ``k`` is one more than the number of shingles that the
  partition's largest size lets a contained item miss.  A document that contains the item cannot
  miss all of its sketch, so the search loses nothing.
* Documents are read once; a document is a candidate for an item if it holds one of the sketch's
  hashes.  Each candidate whose hashes suffice is verified by exact containment of all of the item's
  shingles, numbered by their words without hashing.

Words are runs of ASCII letters, digits and bytes from 0x80, A-Z as a-z, so punctuation and white
space do not hide an item.  An item with fewer words than a shingle is one shingle of its own length,
and is contained in every document that has these words one after the other.

The sketches and shingles of the items are sent to all executors only if they are small
(``broadcast_limit`` hashes).  Larger benchmarks stay in tables: the items' sketches are joined with
the documents' shingles (a shingle that many documents hold goes to several places), the shingles of the
candidates' items are counted in a second join, and what is found meets the texts in a third, to be verified.

Rows: null or wordless items match nothing; null or wordless documents contain nothing; rows of
either table that share an id are judged row by row, and repeated pairs are given once with the
larger overlap; a null id is kept as it is; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import map_batches, only
from lumenspark.llm.components import salted_join
from lumenspark.llm.textbytes import ALPHANUMERIC, coded, shingles, utf8, words

#: Shingles, and bytes of text, of the items that are sent to all executors at most.
BROADCAST_LIMIT, BROADCAST_BYTES = 1_000_000, 64 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z as a-z."""
    return _WORD.findall((text or "").encode().lower())


def _overlap(document: list[bytes], item: list[bytes], width: int) -> tuple[int, int]:
    """How many of an item's distinct shingles are among the document's, and how many it has."""
    theirs, own = coded([document, item], min(width, len(item)))
    return len(np.intersect1d(theirs, own, assume_unique=True)), len(own)


def _shingled(column, widths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shingles, row offsets) of a column for each width."""
    hashes, _, rows = words(*utf8(column), ALPHANUMERIC)
    return [shingles(hashes, rows, w) for w in widths]


def _item_sets(width: int, percent: int):
    def run(batches):
        for batch in batches:
            hashes, _, rows = words(*utf8(batch.column("text")), ALPHANUMERIC)
            length = np.minimum(np.diff(rows), width)
            made = {w: shingles(hashes, rows, w) for w in np.unique(length[length > 0]).tolist()}
            sets = [np.unique(made[w][0][made[w][1][i] : made[w][1][i + 1]]).view(np.int64) if w else None for i, w in enumerate(length.tolist())]
            kept = [0 if s is None else sketch_length(len(s), percent) for s in sets]
            plain = [b" ".join(_words(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(length, pa.int32()), pa.array(kept, pa.int32()), pa.array(sets, pa.list_(pa.int64())), pa.array(plain, pa.binary())], names=["item_id", "length", "kept", "members", "words"])

    return run


def sketch_length(size: int, percent: int) -> int:
    """Least hashes to keep of an item, by the largest size of its partition, so that no contained item is lost."""
    upper = 1 << max(0, (size - 1).bit_length())
    return min(size, upper - -(-upper * percent // 100) + 1)


class _Block:
    """Items of one shingle length: their shingles by number, their words, and the sketches."""

    def __init__(self, items: list[tuple[int | None, np.ndarray, bytes]], percent: int):
        self.percent = percent
        self.ids, self.words = [i for i, _, _ in items], [w for _, _, w in items]
        self.sizes = np.array([len(m) for _, m, _ in items], np.int64)
        self.hashes = np.concatenate([m for _, m, _ in items]) if items else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), self.sizes)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owner = self.hashes[order], owner[order]
        sketched = [m[: sketch_length(len(m), percent)] for _, m, _ in items]
        self.sketch = np.unique(np.concatenate(sketched)) if sketched else np.zeros(0, np.uint64)
        # a small table by leading bits, so that most shingles of a document are ruled out at once
        self.bits = np.uint64(64 - 20)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.sketch >> self.bits] = True

    def contained(self, hashed: np.ndarray, at: np.ndarray):
        """(row, item) for rows of shingles, by their hashes."""
        if not len(self.sketch) or not len(hashed):
            return
        near = np.flatnonzero(self.maybe[hashed >> self.bits])
        found = self.sketch[np.minimum(np.searchsorted(self.sketch, hashed[near]), len(self.sketch) - 1)] == hashed[near]
        rows = np.unique(np.searchsorted(at, near[found], "right") - 1)
        for row in rows.tolist():
            members = np.unique(hashed[at[row] : at[row + 1]])
            low, high = np.searchsorted(self.hashes, members, "left"), np.searchsorted(self.hashes, members, "right")
            hit = high > low
            owners = np.concatenate([self.owner[a:b] for a, b in zip(low[hit].tolist(), high[hit].tolist(), strict=True)])
            items, shared = np.unique(owners, return_counts=True)
            for item, n in zip(items.tolist(), shared.tolist(), strict=True):
                if 100 * n >= self.percent * self.sizes[item]:
                    yield row, item


def _search(blocks: dict[int, _Block], percent: int):
    def run(batches):
        for batch in batches:
            columns, text = [[], [], [], []], {}
            for (width, block), (hashed, at) in zip(blocks.items(), _shingled(batch.column("text"), list(blocks)), strict=True):
                for row, i in block.contained(hashed, at):
                    if row not in text:
                        text = {row: _words(batch.column("text")[row].as_py())}
                    n, size = _overlap(text[row], block.words[i].split(), width)
                    if 100 * n >= percent * size:
                        for column, x in zip(columns, (row, block.ids[i], n, size), strict=True):
                            column.append(x)
            rows, *rest = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), *rest], names=["doc_id", "item_id", "n_shared", "n_shingles"])

    return run


def _spread(widths: list[int]):
    """Each distinct shingle of each document as a row."""

    def run(batches):
        for batch in batches:
            # few texts at a time: a row of output for each word and width
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                made = _shingled(part.column("text"), widths)
                for i in range(part.num_rows):
                    members = np.unique(np.concatenate([h[at[i] : at[i + 1]] for h, at in made])).view(np.int64)
                    one = pa.array(np.full(len(members), i))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(one), part.column("row").take(one), pa.array(members)], names=["doc_id", "row", "hash"])

    return run


def _verified(percent: int):
    """Found pairs with the words of the item and the text of the document, by exact containment."""

    def run(batches):
        for batch in batches:
            shared, sizes = [], []
            for text, item, length in zip(batch.column("text"), batch.column("words"), batch.column("length").to_pylist(), strict=True):
                n, size = _overlap(_words(text.as_py()), item.as_py().split(), length)
                shared.append(n)
                sizes.append(size)
            keep = pa.array(100 * np.array(shared, np.int64) >= percent * np.array(sizes, np.int64))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (batch.column("doc_id"), batch.column("item_id"), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64()))], names=["doc_id", "item_id", "n_shared", "n_shingles"])

    return run


def _by_join(texts: DataFrame, sets: DataFrame, widths: list[int], percent: int) -> DataFrame:
    """The contained items where the benchmark is too large to be sent to all executors."""
    keyed = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    spread = map_batches(keyed, _spread(widths), "doc_id long, row long, hash long")
    items = sets.select("item_id", F.xxhash64("item_id", "members").alias("item"), "members", "kept", "length", "words", F.size("members").cast("long").alias("size")).dropDuplicates(["item"])
    sketches = items.select("item", F.explode(F.slice("members", F.lit(1), F.col("kept"))).alias("hash"))
    candidates = salted_join(spread, sketches, ["hash"], "row").select("row", "item").distinct()
    wanted = candidates.join(items.select("item", "members", "size"), "item").select("row", "item", "size", F.explode("members").alias("hash"))
    shared = wanted.join(spread.select("row", "hash"), ["row", "hash"]).groupBy("row", "item", "size").agg(F.count_distinct("hash").alias("n"))
    found = shared.where(F.col("n") * 100 >= F.col("size") * percent).select("row", "item")
    met = keyed.dropDuplicates(["row"]).join(found, "row").join(items.select("item", "item_id", "length", "words"), "item")
    return map_batches(met.select("doc_id", "item_id", "text", "words", "length"), _verified(percent), "doc_id long, item_id long, n_shared long, n_shingles long")


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, text), (item_id, text) -> (doc_id, item_id, n_shared, n_shingles, containment), a row for each contained item."""
    sets = map_batches(only(items, "item_id", "text"), _item_sets(width, percent), "item_id long, length int, kept int, members array<long>, words binary").where("length > 0")
    texts = only(docs, "doc_id", "text")
    sizes = {r.length: (r.n, r.bytes) for r in sets.groupBy("length").agg(F.sum(F.size("members")).alias("n"), F.sum(F.octet_length("words")).alias("bytes")).collect()}
    if sum(n for n, _ in sizes.values()) > broadcast_limit or sum(b for _, b in sizes.values()) > BROADCAST_BYTES:
        found = _by_join(texts, sets, sorted(sizes), percent)
    else:
        rows: dict[int, list] = {w: [] for w in sorted(sizes) or [width]}
        for row in sets.collect():  # broadcast_limit hashes at most
            rows[row.length].append((row.item_id, np.array(row.members, np.int64).view(np.uint64), bytes(row.words)))
        blocks = {w: _Block(some, percent) for w, some in rows.items()}
        found = map_batches(texts, _search(blocks, percent), "doc_id long, item_id long, n_shared long, n_shingles long")
    largest = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shared", "n_shingles"), F.col("n_shared") / F.col("n_shingles")).alias("best"))
    return largest.select("doc_id", "item_id", "best.n_shared", "best.n_shingles", (F.col("best.n_shared") / F.col("best.n_shingles")).alias("containment"))
