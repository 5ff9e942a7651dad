"""Whitening of embeddings: spectral divide-and-conquer by QDWH polar decompositions, then whitening by broadcast.

Entries become integers x = floor(scale * c) + OFFSET.  Counts and sums of x are exact.  Covariances are
summed from x minus the rounded mean, in whole numbers, and corrected by what the rounding left, so that
the covariance of the fit list is exact until it is divided.

Components come from its polar decompositions.  With U the unitary factor of V - s I, (U + I) / 2 is the
projector on the space of the eigenvalues above s.  An orthonormal basis of it and of its complement
splits V into two smaller matrices; each is split again, at its mean eigenvalue, until one dimension or a
multiple of the identity is left.  A last step in extended precision takes off what the splits left
between components.  This is work on a dimension by dimension matrix, on the driver; rows stay on the
executors, which get the components with their task.

Rows: a vector that is null, empty, or holds a null or non-finite entry is dropped, as is one with an
entry so large that scaled it reaches 2**40 (its deviation would exceed a long).  Vectors of several
lengths have no common covariance: those of the commonest length (of equals, the longest) stay.  Repeated
rows and null ids are kept as they are; extra columns are ignored.  A component without variance (at most
1e-12 of the trace) is left out, so one row alone, or equal rows, give an empty table, as an empty one does.
A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import map_batches, only

OFFSET, LARGEST = 1_000_000, 1 << 40
#: Share of the trace below which a component has no variance.
FLAT = 1e-12
_EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary factor of a symmetric matrix, by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    least = min(0.9, max(np.linalg.svd(x, compute_uv=False)[-1] * 0.9, 1e-16))
    eye = np.eye(n)
    for _ in range(30):
        square = least * least
        gamma = (4 * (1 - square) / (square * square)) ** (1 / 3)
        root = np.sqrt(1 + gamma)
        p = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * gamma + 8 * (2 - square) / (square * root)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * (both[:n] @ both[n:].T)
        least = min(1 - _EPS, least * (p + q * square) / (1 + r * square))
        step = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        if step < (10 * _EPS) ** (1 / 3) and least > 0.99 or step < 10 * _EPS:
            break
    return x


def _bases(projector: np.ndarray, rank: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector and of its complement: subspace iteration on random vectors."""
    n = len(projector)
    whole = rng.standard_normal((n, n))
    for _ in range(3):
        first = projector @ whole[:, :rank]
        rest = whole[:, rank:] - projector @ whole[:, rank:]
        whole, _ = np.linalg.qr(np.hstack([first, rest]))
    return whole[:, :rank], whole[:, rank:]


def _split(a: np.ndarray, basis: np.ndarray, size: float, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Columns that span invariant spaces of a (in the given basis), each with one eigenvalue only."""
    n = len(a)
    mean = np.trace(a) / n
    if n == 1 or np.linalg.norm(a - mean * np.eye(n)) <= 4 * n * _EPS * size:
        yield basis
        return
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    # the mean lies between the least and greatest eigenvalue; where it hits one, a place beside it does
    for shift in (0.0, 0.05, -0.05, 0.11, -0.11, 0.23, -0.23, 0.47, -0.47):
        u = polar(a - (mean + shift * spread) * np.eye(n))
        rank = int(np.rint((np.trace(u) + n) / 2))
        if 0 < rank < n and np.linalg.norm(u @ u - np.eye(n)) < 1e-8:
            break
    else:  # eigenvalues closer than rounding can tell
        yield basis
        return
    for some in _bases((u + np.eye(n)) / 2, rank, rng):
        inner = some.T @ a @ some
        yield from _split((inner + inner.T) / 2, basis @ some, size, rng)


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    size = np.linalg.norm(v)
    found = np.hstack(list(_split(v, np.eye(len(v)), size, np.random.default_rng(7))))
    kind = np.longdouble if len(v) <= 128 else float
    x, wide = found.astype(kind), v.astype(kind)
    eye = np.eye(len(v), dtype=kind)
    for _ in range(3):  # first-order corrections of lengths and of what is left between components
        left, inner = eye - x.T @ x, x.T @ wide @ x
        value = np.diag(inner) / (1 - np.diag(left))
        apart = value[None, :] - value[:, None]
        limit = 2 * (np.linalg.norm((inner - np.diag(value)).astype(float)) + size * np.linalg.norm(left.astype(float)))
        far = np.abs(apart) > max(limit, size * _EPS)
        x = x + x @ np.where(far, (inner + value[None, :] * left) / np.where(far, apart, 1), left / 2)
    x = x + x @ (eye - x.T @ x) / 2
    value = np.einsum("ij,ij->j", x, wide @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-value, kind="stable")
    x = x[:, order] / np.sqrt(np.einsum("ij,ij->j", x, x))[order]
    return value[order].astype(float), x.astype(float)


def _integers(column, scale: float, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the usable vectors (or one length): their places in the batch, and x - OFFSET as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    # a null entry becomes NaN here; entries of null vectors are not in flat
    flat = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = flat * scale
        bad = ~(np.abs(scaled) < LARGEST)
    broken = np.concatenate([[0], np.cumsum(bad)])
    good = (size > 0) & (broken[begin + size] == broken[begin])
    for n in np.unique(size[good]).tolist() if dim is None else [dim]:
        rows = np.flatnonzero(good & (size == n))
        if len(rows):
            yield rows, np.floor(scaled[begin[rows][:, None] + np.arange(n)]).astype(np.int64)


def _sums(vector: str, scale: float):
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for rows, d in _integers(batch.column(vector), scale):
                n, total = held.setdefault(d.shape[1], [0, [0] * d.shape[1]])
                held[d.shape[1]] = [n + len(rows), [a + b for a, b in zip(total, d.sum(axis=0).tolist(), strict=True)]]
        for dim, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(total, pa.decimal128(38, 0))], names=["dim", "i", "n", "s"])

    return run


def _entries(values, kind) -> pa.RecordBatch:
    """A square of sums as rows (i, j, s), i <= j."""
    i, j = np.triu_indices(len(values))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([values[a][b] for a, b in zip(i.tolist(), j.tolist(), strict=True)], kind)], names=["i", "j", "s"])


def _products(vector: str, scale: float, centre: np.ndarray):
    """Sums of products of the entries minus the rounded mean, exact."""

    def run(batches):
        dim = len(centre)
        total = np.zeros((dim, dim), object)
        for batch in batches:
            for _, d in _integers(batch.column(vector), scale, dim):
                d = d - centre
                most = max(1, int(np.abs(d).max()))
                if most * most * len(d) < 1 << 53:
                    total += (d.T.astype(float) @ d.astype(float)).astype(np.int64).astype(object)
                else:
                    wide = d.astype(object)
                    total += wide.T @ wide
        yield _entries(total.tolist(), pa.decimal128(38, 0))

    return run


@dataclass(frozen=True)
class Whitener:
    """What the fit list gives: its size n, sums of x - OFFSET, and components as columns with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, d: np.ndarray) -> np.ndarray:
        """x minus its mean, rounded once: n * x - S is whole."""
        return (self.n * d - np.array(self.sums)) / self.n

    def whiten(self, d: np.ndarray) -> np.ndarray:
        return self.centred(d) @ self.components / np.sqrt(self.values)


def fit(rows: DataFrame, vector: str, scale: float, most: int) -> Whitener | None:
    """The whitener of all usable vectors, with up to most components; None if there is no variance."""
    rows = only(rows, vector)
    found = map_batches(rows, _sums(vector, scale), "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    dims = found.where("i = 0").orderBy(F.desc("n"), F.desc("dim")).limit(1).select("dim", F.col("n").alias("all"))
    sums = found.join(F.broadcast(dims), "dim").orderBy("i").collect()  # a row for each dimension
    if not sums:
        return None
    n, total = sums[0]["all"], [int(r.s) for r in sums]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    cells = map_batches(rows, _products(vector, scale, centre), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    dim = len(total)
    left = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    v = np.zeros((dim, dim))
    for r in cells:  # a row for each pair of dimensions; whole numbers of any size, divided once
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.s) - left[r.i] * left[r.j]) / (n * n)
    trace = float(np.trace(v))
    if trace <= 0:
        return None
    values, components = eigen(v)
    used = np.flatnonzero(values > FLAT * trace)[:most]
    return Whitener(n, tuple(total), values[used], components[:, used], trace)


def _spread(vector: str, scale: float, whitener: Whitener):
    """Sums of the whitened entries and of their products."""

    def run(batches):
        dim = len(whitener.values)
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            for _, d in _integers(batch.column(vector), scale, len(whitener.sums)):
                w = np.hstack([np.ones((len(d), 1)), whitener.whiten(d)])
                total += w.T @ w
        yield _entries(total.tolist(), pa.float64())

    return run


def identity_error(rows: DataFrame, vector: str, scale: float, whitener: Whitener) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    dim = len(whitener.values)
    total = np.zeros((dim + 1, dim + 1))
    for r in map_batches(only(rows, vector), _spread(vector, scale, whitener), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = total[r.j, r.i] = r.s
    # whitened rows are centred; what rounding leaves of their mean is taken off
    mean = total[0, 1:] / whitener.n
    return float(np.abs(total[1:, 1:] / whitener.n - np.outer(mean, mean) - np.eye(dim)).max())


def _apply(key: str, vector: str, scale: float, whitener: Whitener, error: float):
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        k, sums = len(whitener.values), np.array(whitener.sums)
        explained = whitener.values / whitener.trace
        for batch in batches:
            for rows, d in _integers(batch.column(vector), scale, len(sums)):
                apart = whitener.n * d - sums
                far = (apart.astype(float) ** 2).sum(axis=1) >= 9.2e18
                deviation = np.where(far, 0, (np.where(far[:, None], 0, apart) ** 2).sum(axis=1))
                white, m = whitener.whiten(d), len(rows) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(m, whitener.n, np.int64)),
                        pa.array(np.repeat(deviation, k), mask=np.repeat(far, k)),
                        pa.array(white.reshape(-1)),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(m, error)),
                    ],
                    names=names,
                )

    return run


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, most: int = 32) -> DataFrame:
    """(key, vector) -> a row for each usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whitener = fit(rows, vector, scale, most)
    if whitener is None or not len(whitener.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, vector, scale, whitener)
    return map_batches(only(rows, key, vector), _apply(key, vector, scale, whitener, error), schema)
