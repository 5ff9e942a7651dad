"""Whitening against a plain eigensolver and sums in Python's whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lumenspark.llm.op12 import op12_embedding_whitening
from lumenspark.llm.whitening import eigen, polar, whitened

SF = "/root/testdata/sf0.001"


def brute(rows: list[tuple], most: int = 32):
    """Deviations by whole numbers, and whitened columns up to their sign."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    n, dim = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(dim)]
    deviations = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for _, x in kept])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    used = np.flatnonzero(values > 1e-12 * np.trace(v))[:most]
    return [i for i, _ in kept], n, deviations, centred @ vectors[:, used] / np.sqrt(values[used]), values[used] / np.trace(v)


def held(found, rows, most=32):
    ids, n, deviations, white, explained = brute(rows, most)
    k = white.shape[1]
    out = {(r.vec_id, r.component): r for r in found.collect()}
    assert len(out) == len(ids) * k
    for c in range(k):
        got = np.array([out[i, c + 1].whitened for i in ids])
        sign = np.sign(got @ white[:, c])
        np.testing.assert_allclose(sign * got, white[:, c], rtol=0, atol=1e-7)
        assert out[ids[0], c + 1].explained == pytest.approx(explained[c], rel=1e-9)
    for i in ids:
        r = out[i, 1]
        assert (r.n, r.deviation) == (n, deviations[i]) and r.identity_error < 1e-9


def test_query_agrees_with_a_plain_eigensolver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held(op12_embedding_whitening(spark, SF), rows)


def test_nulls_non_finite_entries_other_lengths_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)] + [(5, [0.5, 0.25, -1.0])]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 1.0]), (103, [float("inf"), 0.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0]), (None, [0.0, 0.125, 0.25])]
    schema = "vec_id long, embedding array<double>, n int, component string, whitened string"
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows[:-1] + odd], schema)
    out = whitened(frame).collect()
    assert {r.vec_id for r in out} == set(range(40)) | {None} and len(out) == 41 * 3
    assert {r.n for r in out} == {41}
    twice = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert len(whitened(twice).where("vec_id = 5").collect()) == 6


def test_no_variance_gives_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitened(spark.createDataFrame(rows, schema)).collect() == []
    line = [(i, [float(i), float(i), 0.0]) for i in range(8)]  # one direction alone varies
    out = whitened(spark.createDataFrame(line, schema)).collect()
    assert {r.component for r in out} == {1} and all(abs(r.explained - 1) < 1e-12 for r in out)


@pytest.mark.parametrize("kind", ["random", "close", "repeated", "graded", "zero_mean"])
def test_divide_and_conquer_finds_eigenpairs(kind):
    rng = np.random.default_rng(11)
    n = 24
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {
        "random": np.sort(rng.uniform(1, 100, n))[::-1],
        "close": 50 + 1e-6 * np.arange(n)[::-1],
        "repeated": np.repeat([9.0, 4.0, 1.0], 8),
        "graded": 10.0 ** -np.arange(0, n / 2, 0.5),
        "zero_mean": np.concatenate([np.arange(12, 0, -1), [0.0] * 0, -np.arange(1, 13)]),
    }[kind].astype(float)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = eigen(a)
    np.testing.assert_allclose(got, values, atol=1e-12 * np.abs(values).max())
    np.testing.assert_allclose(x.T @ x, np.eye(n), atol=1e-12)
    np.testing.assert_allclose(a @ x, x * got, atol=1e-12 * np.abs(values).max())
    u = polar(a - 3.3 * np.eye(n))
    np.testing.assert_allclose(u @ u, np.eye(n), atol=1e-8)
