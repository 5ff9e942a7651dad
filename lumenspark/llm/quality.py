"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are the shares of its words in hashed slots, a few statistics of its structure
(symbols, digits, capitals, lines, repeats), and its length as metadata, in bands.  The score is

    logistic(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

and the pairwise sum costs linear time by the sum-of-squares identity: half the sum over factors f of
``(sum_i v_if x_i)**2 - sum_i (v_if x_i)**2``.

The model is fitted in numpy on a bounded sample of labelled rows (``sample`` rows at most, the least
of a hash of the id, so the same in every run) by adaptive gradient steps, and is a few hundred
kilobytes that every task gets.  The executors make the sample's features, so that the driver gets no
text and at most WIDTH entries of a row.  Scoring reads whole texts, needs no shuffle and holds one
batch.

Rows: a null text counts as empty; an empty or wordless text is scored by its structure and length;
repeated rows are scored alike; a null id is kept; only ``text`` enters a score, extra columns are
ignored; without a usable label of both kinds every score is the labels' mean (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import map_batches, only
from lumenspark.llm.textbytes import BLANK_SEPARATED, by_bytes, utf8, words

SLOTS, FACTORS, SAMPLE = 1 << 13, 8, 6000
_LENGTH_BANDS = 16
_SLICE = 1 << 20  # bytes of text whose features are made at once
_CLASSES = 7  # letters, capitals, digits, white space, line ends, symbols, bytes from 0x80
STATISTICS = _CLASSES + 9
WIDTH = SLOTS + STATISTICS + _LENGTH_BANDS


def _byte_classes() -> np.ndarray:
    out = np.full(256, 5, np.uint8)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[9, 11, 12, 13, 32]] = 3
    out[10] = 4
    out[128:] = 6
    return out


_CLASS = _byte_classes()


@dataclass
class Features:
    """Rows of (slot, value) entries: row i has entries first[i] to first[i + 1]."""

    first: np.ndarray
    slot: np.ndarray
    value: np.ndarray


def features(column) -> Features:
    """Features of every row of an Arrow string column, from whole texts."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    counts = np.zeros((n, _CLASSES))
    for a, b, rows in _parts(offsets):
        row = np.repeat(np.arange(rows.start, rows.stop), np.diff(np.clip(offsets[rows.start : rows.stop + 1], a, b)))
        counts += np.bincount(row * _CLASSES + _CLASS[data[a:b]], minlength=n * _CLASSES).reshape(n, _CLASSES)
    hashes, lengths, at = words(data, offsets, BLANK_SEPARATED)
    n_words = np.diff(at)
    row = np.repeat(np.arange(n), n_words)
    slot = (hashes >> np.uint64(64 - 13)).astype(np.int64)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    # distinct words of a row by slot: one sort gives the counts that the squares need
    key, times = np.unique(row * SLOTS + slot, return_counts=True)
    of = key // SLOTS
    words_of = np.maximum(n_words, 1)
    distinct, top, square = np.bincount(of, minlength=n), np.zeros(n), np.bincount(of, times.astype(float) ** 2, minlength=n)
    np.maximum.at(top, of, times)
    total = np.maximum(size, 1)[:, None]
    stats = np.empty((n, STATISTICS))
    stats[:, :_CLASSES] = counts / total
    # words that end in a symbol other than ordinary punctuation show as symbols for each word
    stats[:, _CLASSES] = np.minimum(counts[:, 5] / words_of, 4) / 4
    stats[:, _CLASSES + 1] = np.bincount(row, same, minlength=n) / words_of
    stats[:, _CLASSES + 2] = distinct / words_of
    stats[:, _CLASSES + 3] = top / words_of
    stats[:, _CLASSES + 4] = np.sqrt(square) / words_of
    mean = np.bincount(row, lengths, minlength=n) / words_of
    stats[:, _CLASSES + 5] = np.minimum(mean, 20) / 20
    stats[:, _CLASSES + 6] = np.minimum(np.sqrt(np.maximum(np.bincount(row, lengths.astype(float) ** 2, minlength=n) / words_of - mean**2, 0)), 20) / 20
    stats[:, _CLASSES + 7] = n_words == 0
    stats[:, _CLASSES + 8] = np.log1p(counts[:, 4]) / 10
    band = np.minimum(np.log2(size + 1), _LENGTH_BANDS - 1).astype(np.int64)
    # entries row by row: words, statistics, length band
    per = distinct + STATISTICS + 1
    first = np.concatenate([[0], np.cumsum(per)])
    slots, values = np.empty(first[-1], np.int64), np.empty(first[-1], np.float32)
    begin = np.concatenate([[0], np.cumsum(distinct)])[:-1]
    place = np.arange(len(key)) - begin[of] + first[of]
    slots[place], values[place] = key % SLOTS, times / np.sqrt(square)[of]
    where = (first[:-1] + distinct)[:, None] + np.arange(STATISTICS)
    slots[where], values[where] = SLOTS + np.arange(STATISTICS), stats
    slots[first[1:] - 1], values[first[1:] - 1] = SLOTS + STATISTICS + band, 1.0
    return Features(first, slots, values)


def _parts(offsets: np.ndarray, limit: int = 1 << 19):
    """The bytes of all rows in parts, each with the rows that it touches."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + limit, end)
        yield at, to, slice(int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, to, "left")))
        at = to


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def sums(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        """(raw score, sums of v x for each factor) of each row, in linear time."""
        n = len(x.first) - 1
        if n == 0:
            return np.zeros(0), np.zeros((0, self.factor.shape[1]))
        vx = self.factor[x.slot] * x.value[:, None]
        s = np.add.reduceat(vx, x.first[:-1], axis=0)
        q = np.add.reduceat((vx * vx).sum(axis=1), x.first[:-1])
        linear = np.add.reduceat(self.weight[x.slot] * x.value, x.first[:-1])
        return self.bias + linear + 0.5 * ((s * s).sum(axis=1) - q), s

    def score(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(x)[0].astype(float), -30, 30)))


def _picked(x: Features, rows: np.ndarray) -> Features:
    per = np.diff(x.first)[rows]
    first = np.concatenate([[0], np.cumsum(per)])
    where = np.repeat(x.first[rows] - first[:-1], per) + np.arange(first[-1])
    return Features(first, x.slot[where], x.value[where])


def fit(x: Features, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 11) -> Machine:
    """A machine fitted to the features of labelled texts by adaptive gradient steps on the logistic loss."""
    rng = np.random.default_rng(seed)
    mean = float(labels.mean()) if len(labels) else 0.5
    m = Machine(float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), np.zeros(WIDTH, np.float32), rng.normal(0, 0.02, (WIDTH, FACTORS)).astype(np.float32))
    if len(labels) == 0 or labels.min() == labels.max():
        return Machine(m.bias, m.weight, np.zeros_like(m.factor))
    gw, gv, gb = np.full(WIDTH, 1e-3, np.float32), np.full((WIDTH, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            part = _picked(x, rows)
            raw, s = m.sums(part)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            per = np.diff(part.first)
            e = np.repeat(err, per).astype(np.float32)
            step = (e * part.value)[:, None] * (np.repeat(s, per, axis=0) - m.factor[part.slot] * part.value[:, None])
            used, where = np.unique(part.slot, return_inverse=True)
            dw = np.bincount(where, e * part.value, minlength=len(used)).astype(np.float32) + decay * m.weight[used]
            dv = np.stack([np.bincount(where, step[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1).astype(np.float32) + decay * m.factor[used]
            gw[used] += dw**2
            gv[used] += dv**2
            m.weight[used] -= rate * dw / np.sqrt(gw[used])
            m.factor[used] -= rate * dv / np.sqrt(gv[used])
            gb += err.sum() ** 2
            m.bias -= rate * err.sum() / np.sqrt(gb)
    return m


def _featured(batches):
    """(doc_id, quality, text) -> (doc_id, quality, slots, values)."""
    for batch in batches:
        for at, n in by_bytes(batch.column("text"), _SLICE):
            part = batch.slice(at, n)
            x = features(part.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(x.first, pa.int32()), pa.array(of, kind)) for of, kind in ((x.slot, pa.int16()), (x.value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *lists], names=["doc_id", "quality", "slots", "values"])


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Machine:
    """Fit on at most sample labelled rows among those that the condition on doc_id lets in."""
    known = only(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").where(usable)
    # half of the sample for each label, the least hashes first, so that rare labels are seen
    drawn = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for q in (0, 1)]
    ids = drawn[0].union(drawn[1]).select("doc_id", F.col("quality").cast("int").alias("quality"))  # sample rows at most
    texts = only(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "quality", "text")
    made = map_batches(texts, _featured, "doc_id long, quality int, slots array<short>, values array<float>")
    rows = made.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("slots", "values")).limit(sample).select("quality", "slots", "values").toArrow().combine_chunks()
    share = known.agg(F.avg("quality")).first()[0]
    truth = rows.column("quality").to_numpy().astype(float)
    slots, values = rows.column("slots").combine_chunks(), rows.column("values").combine_chunks()
    x = Features(np.concatenate([[0], np.cumsum(slots.value_lengths().to_numpy())]), slots.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy())
    machine = fit(x, truth)
    if len(truth) and 0 < share < 1:  # the sample is balanced; move the bias to the labels' own share
        drawn_share = min(max(truth.mean(), 1e-3), 1 - 1e-3)
        machine.bias += float(np.log(share / (1 - share)) - np.log(drawn_share / (1 - drawn_share)))
    return machine


def _score(machine: Machine, least: float | None):
    def run(batches):
        for batch in batches:
            rows = batch.column("carried")
            texts = rows.field("text") if batch.num_columns == 1 else batch.column("text")
            for at, n in by_bytes(texts, _SLICE):
                scores = pa.array(machine.score(features(texts.slice(at, n))), pa.float64())
                part = pa.RecordBatch.from_arrays([rows.slice(at, n), scores], names=["carried", "score"])
                yield part if least is None else part.filter(pc.greater_equal(scores, least))

    return run


def quality_scores(docs: DataFrame, machine: Machine, carry: tuple[str, ...] = ("doc_id",), least: float | None = None) -> DataFrame:
    """(text, carry...) -> (carried struct, score): how likely label 1 is, for every whole text; only scores from least on, if given."""
    # a text that is carried goes to the workers once
    more = [] if "text" in carry else ["text"]
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), *more)
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in carried.schema["carried"].dataType.fields)
    return map_batches(carried, _score(machine, least), f"carried struct<{kinds}>, score double")
