"""Near duplicates against brute force over all pairs, and the defined edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lumenspark.llm.components import components
from lumenspark.llm.near_dedup import near_duplicates, signature
from lumenspark.llm.textbytes import coded


def word_sets(rows, width):
    out = []
    for _, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0d]+", lowered)
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def brute_force(rows, width, percent):
    sets = word_sets(rows, width)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[y] = x
    return sorted([(d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(rows, sets, strict=True)], key=str)


def found(spark, rows, width, percent=80):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, members string")
    return sorted([tuple(r) for r in near_duplicates(df, width, percent).collect()], key=str)


def families(seed, n=60):
    """Families at the edge of the threshold, chains, copies, small and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, d = [], 0
    for _ in range(n // 6):
        base = rng.choices(vocabulary, k=rng.choice([6, 20, 60, 150]))
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((d, " ".join(text).upper() if rng.random() < 0.2 else "\t".join(text)))
            if rng.random() < 0.5:
                base = text
            d += 1
    return rows + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one two"), (1004, "One  two"), (1005, "one"), (None, rows[0][1]), (1006, rows[3][1]), (1006, rows[9][1]), (1007, "é È"), (1008, "é È"), (0, rows[0][1])]


@pytest.mark.parametrize("seed,width", [(1, 4), (2, 5)])
def test_against_brute_force(spark, seed, width):
    rows = families(seed)
    assert found(spark, rows, width) == brute_force(rows, width, 80)


def test_a_crowded_family_loses_no_link(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(120):  # most pairs below the threshold, some above
        text = list(base)
        for k in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            text[k] = f"x{d}_{k}" if rng.random() < 0.7 else f"y{k}"
        rows.append((d, " ".join(text)))
    assert found(spark, rows, 4) == brute_force(rows, 4, 80)


@pytest.mark.parametrize("block", [300, 2500])
def test_large_buckets_are_split_by_a_second_band(spark, monkeypatch, block):
    from lumenspark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PAIRS", 8)
    rng = random.Random(10)
    rows = []
    for d in range(150):
        text = [f"b{i}" for i in range(60)]
        for k in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
            text[k] = f"x{d}_{k}" if rng.random() < 0.7 else f"y{k}"
        rows.append((d, " ".join(text)))
    assert found(spark, rows, 4) == brute_force(rows, 4, 80)


def test_many_near_copies_and_copies(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(80)]
    rows = [(d, " ".join(base[:k] + [f"x{d}"] + base[k + 1 :])) for d, k in ((d, rng.randrange(80)) for d in range(2000))]
    rows += [(3000 + d, "the same text every time again") for d in range(1500)]
    got = found(spark, rows, 4)
    assert {r[2] for r in got} == {0, 3000} and len(got) == 3500 and sum(r[3] for r in got) == 2


def test_words_that_collide_under_polynomials_modulo_powers_of_two(spark):
    from tests.llm.test_tokens import thue_morse

    rows = [(i, thue_morse(n, *pair)) for i, (n, pair) in enumerate((n, pair) for n in (1024, 2048, 4096, 8192) for pair in ("ab", "ba"))]
    assert found(spark, rows, 4) == brute_force(rows, 4, 80) == sorted([(d, 1, d, True) for d, _ in rows], key=str)


def test_texts_with_equal_sums_of_word_names(spark):
    rows = [(1, "nfjhln azjjuu same words"), (2, "knjtfo nvllej same words"), (3, "azjjuu nfjhln same words"), (4, "NFJHLN azjjuu\tsame words")]
    assert found(spark, rows, 4) == brute_force(rows, 4, 80) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 3, True), (4, 1, 1, False)]


def test_shingles_are_numbered_by_their_words():
    rng = random.Random(5)
    texts = [[rng.choice([b"a", b"b", b"ab", b"", b"ba"]) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    for width in (1, 2, 4):
        sets = coded(texts, width)
        plain = [{tuple(t[i : i + width]) for i in range(len(t) - width + 1)} if len(t) >= width else {tuple(t)} if t else set() for t in texts]
        assert [len(s) for s in sets] == [len(p) for p in plain]
        for s, p in zip(sets, plain, strict=True):
            assert [len(np.intersect1d(s, x)) for x in sets] == [len(p & y) for y in plain]


def test_links_and_counts_when_all_hashes_collide(monkeypatch):
    import pyarrow as pa

    from lumenspark.llm import near_dedup

    whole = near_dedup.shingles
    monkeypatch.setattr(near_dedup, "shingles", lambda h, r, w: (whole(h, r, w)[0] * np.uint64(0), whole(h, r, w)[1]))
    texts = ["a b c d e", "a b c d a b c d", "v w x y z", "a b c d e"]
    sketch = next(near_dedup._sketch(4)(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": texts})])))
    assert sketch.column("n_shingles").to_pylist() == [2, 4, 2, 2]
    assert len({*zip(sketch.column("d1").to_pylist(), sketch.column("d2").to_pylist(), strict=True)}) == 3
    pairs = pa.RecordBatch.from_pydict({"u": [1, 1, 2], "v": [3, 4, 4], "a": [b"a b c d e", b"a b c d e", b"a b c d a b c d"], "b": [b"v w x y z", b"a b c d e", b"a b c d e"]})
    kept = next(near_dedup._confirm(4, 80)(iter([pairs])))
    assert kept.to_pylist() == [{"u": 1, "v": 4}]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 900):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[: max(1, int(0.9 * n))], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((signature(a) == signature(b)).mean() - true) < 0.25


def test_components_of_paths_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (5, 6)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_query_on_a_table(spark):
    from lumenspark.llm.op8 import op8_minhash_near_dedup

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in op8_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()], key=str) == brute_force(rows, 4, 80)
