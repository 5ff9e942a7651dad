"""Repeated strings against a brute-force version, on drawn and given texts."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumenspark.llm.suffixes import repeated_spans, sort_by


def brute_force(rows, width):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            key = float("inf") if d is None else d
            first[w] = min(first.get(w, key), key)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (float("inf") if d is None else d):
                gone[i : i + width] = b"\1" * width
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                spans.append((i, j - i))
            i = j
        out.append((d, bytes(x for x, g in zip(b, gone) if not g), tuple(spans)))
    return sorted(out, key=str)


def found(spark, rows, width, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("part", F.lit(1))
    return sorted([(r.doc_id, bytes(r.kept), tuple((s.start, s.length) for s in r.spans)) for r in repeated_spans(df, width, **more).collect()], key=str)


def drawn_rows(seed, width):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcé ", k=rng.randint(width - 10, 3 * width))) for _ in range(6)]
    rows = []
    for d in range(40):
        text = "".join(rng.choice(pool)[rng.randint(0, 5) :] if rng.random() < 0.6 else "".join(rng.choices("abcdefg é", k=rng.randint(0, 80))) for _ in range(rng.randint(0, 5)))
        rows.append((rng.choice([d, d, d, 7, None]), text))
    rows += [(100, "Of " * 300), (101, "Of " * 200 + "x"), (102, None), (103, ""), (104, "short"), (105, "Of " * 300), (1, "a" * 49), (2, "a" * 50), (3, "a" * 51)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = drawn_rows(seed, 50)
    assert found(spark, rows, 50) == brute_force(rows, 50)


def test_other_width_and_tiny_chunks(spark):
    rows = drawn_rows(3, 30)
    assert found(spark, rows, 30, chunk_bytes=64) == brute_force(rows, 30)


@pytest.mark.parametrize("chunk_bytes", [64, 2 << 20])
def test_keys_with_many_segments(spark, chunk_bytes):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    phrase = "a common phrase of some forty bytes or so"  # amid other words, which repeat now and then
    rows = drawn_rows(4, 50) + [(i, f"{word()} {rng.choice('xyz')} {phrase} {rng.choice('uvw')} {word()}") for i in range(90)]
    for hot in (0, 3, 40):
        assert found(spark, rows, 50, chunk_bytes=chunk_bytes, hot=hot) == brute_force(rows, 50)


def passes(rows, width, monkeypatch, hash_bits):
    """The passes in this process, with hashes of so few bits that most strings collide."""
    import numpy as np
    import pyarrow as pa

    from lumenspark.llm import suffixes

    monkeypatch.setattr(suffixes, "PIECE", 1000)  # texts are cut at other places in each pass, for rows come in another order
    kept = np.uint64((1 << hash_bits) - 1)
    whole, every = suffixes.Spans.hash, suffixes.Spans.hash_all
    monkeypatch.setattr(suffixes.Spans, "hash", lambda self, a, b: whole(self, a, b) & kept)
    monkeypatch.setattr(suffixes.Spans, "hash_all", lambda self, w: every(self, w) & ~(~kept << np.uint64(32)) if hash_bits else every(self, w) * np.uint64(0))
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "carried": pa.nulls(len(rows))})
    chunks = {c: table.filter(pa.array([i % 3 == c for i in range(len(rows))])) for c in range(3)}
    key = lambda k: (pa.scalar(k),)
    cut = np.array([1 << 62, 1 << 63], np.uint64)

    def by(tables, column):
        joined = pa.concat_tables([t for t in tables if t.num_rows] or tables[:1])
        return {k: joined.filter(pa.compute.equal(joined.column(column), k)) for k in set(joined.column(column).to_pylist()) - {None}}

    nothing = suffixes._rows(None, [])
    sent = by([suffixes._send_keys(width, cut)(key(c), t) for c, t in chunks.items()], "part")
    answers = by([suffixes._compare_keys(1000)(key(p), t) for p, t in sent.items()] or [nothing], "chunk")
    sent = by([suffixes._send_segments(width, cut, 4)(key(c), t.take(pa.array(range(len(t)))[::-1]), answers.get(c, nothing)) for c, t in chunks.items()], "part")
    told = by([suffixes._compare_segments(width)(key(p), t) for p, t in sent.items()] or [nothing], "chunk")
    out = []
    for c, t in chunks.items():
        some = [answers.get(c, nothing).append_column("kind", pa.array([0] * answers.get(c, nothing).num_rows, pa.int32())), told.get(c, nothing).append_column("kind", pa.array([1] * told.get(c, nothing).num_rows, pa.int32()))]
        got = suffixes._remove(width, 0, b"", False, cut, 4)(key(c), t, pa.concat_tables(some)).to_pylist()
        out += [(r["doc_id"], r["kept"], tuple((s["start"], s["length"]) for s in r["spans"])) for r in got]
    return sorted(out, key=str)


@pytest.mark.parametrize("hash_bits", [0, 1, 4, 64 - 32])
def test_equal_hashes_of_unlike_strings_remove_nothing(monkeypatch, hash_bits):
    rows = drawn_rows(6, 50)
    assert passes(rows, 50, monkeypatch, hash_bits) == brute_force(rows, 50)


def test_strings_with_equal_polynomials_modulo_a_power_of_two(spark):
    pair = [(1, "ghnklaiefp icoovcnktejjfe ktssnnmvmozv laqtua imks"), (2, "mdaitoaewawpqoovcnktejjfe ktssnnmvmoznc cbhavo cd ")]
    assert found(spark, pair, 50) == brute_force(pair, 50) and all(not s for _, _, s in found(spark, pair, 50))


def test_whole_characters(spark):
    shared = "é" * 80
    df = spark.createDataFrame([(1, "x" + shared), (2, "\ufffd" + shared[:60] + "è")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in repeated_spans(df, 51, whole_characters=True).collect()}
    assert got == {1: "x" + shared, 2: "\ufffd"}


def test_long_text_crosses_pieces(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefghij klm", k=1_300_000))
    rows = [(1, long[500_000:540_000]), (2, long), (3, long[524_250:524_330]), (4, "z" + long[1_100_000:1_100_060])]
    got = found(spark, rows, 50)
    assert got[1][2] == ((500_000, 40_000),)
    assert got[1][1] == (long[:500_000] + long[540_000:]).encode()
    assert got[2][1] == b"" and got[3][1] == b"z"


def test_carried_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 60, "k"), (2, "x" * 60, None)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in repeated_spans(df, 50, carry=("kept",)).collect()}
    assert got[1].carried.kept == "k" and got[2].carried.kept is None and bytes(got[2].kept) == b""
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string"), 50).count() == 0


def test_rows_equal_in_id_and_text(spark):
    rows = drawn_rows(9, 50) + [(7, "Of " * 300)] * 60 + [(None, "Of " * 300 + "z")] * 50 + [(3, None)] * 40
    assert found(spark, rows, 50, least_copies=20) == found(spark, rows, 50) == brute_force(rows, 50)
    df = spark.createDataFrame([(d, t, str(i)) for i, (d, t) in enumerate(rows)], "doc_id long, text string, name string")
    for least in (20, 1000):
        got = {r.carried.name: (r.doc_id, bytes(r.kept)) for r in repeated_spans(df, 50, carry=("name",), least_copies=least).collect()}
        assert len(got) == len(rows) and [got[str(i)][0] for i in range(len(rows))] == [d for d, _ in rows]
        assert sorted(map(str, got.values())) == sorted(str(r[:2]) for r in brute_force(rows, 50))


def test_query_on_a_table(spark):
    from lumenspark.llm.op6 import op6_suffix_dedup

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, hashlib.sha256(k).hexdigest(), len(s), sum(n for _, n in s)) for d, k, s in brute_force(rows, 50)}
    assert {(r.doc_id, r.kept_sha256, r.n_spans, r.n_removed) for r in op6_suffix_dedup(spark, "/root/testdata/sf0.001").collect()} == want


def test_sort_by():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(0, 4, 500) for _ in range(3))
    order = sort_by(a, b, c)
    assert [tuple(x) for x in np.stack([a, b, c], 1)[order]] == sorted(map(tuple, np.stack([a, b, c], 1)))
