"""Linear stencils on pixel tables; a check of the array kernels, and the way for pixels that come as rows.

A pixel sends its value to the places that look at it, so a pass is one grouping with partial sums
and no join.  Pixels beyond an edge repeat the edge pixel ("edge"), mirror without it ("mirror"), or count nothing ("none").
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seen_at(at: Column, size: Column, reach: Column, mode: str) -> Column:
    """All places, also beyond the edges up to reach, that show the pixel at a place."""
    none = F.array().cast("array<int>")
    if mode == "edge":
        before = F.when((at == 0) & (reach > 0), F.sequence(-reach, F.lit(-1))).otherwise(none)
        after = F.when((at == size - 1) & (reach > 0), F.sequence(size, size - 1 + reach)).otherwise(none)
    elif mode == "mirror":
        before = F.when((at > 0) & (at <= reach), F.array(-at)).otherwise(none)
        mirrored = 2 * (size - 1) - at
        after = F.when((at < size - 1) & (mirrored <= size - 1 + reach), F.array(mirrored)).otherwise(none)
    elif mode == "none":
        return F.array(at)
    else:
        raise ValueError(f"mode must be edge, mirror or none, not {mode!r}")
    return F.concat(before, F.array(at), after)


def along_each(pixels: DataFrame, keys: list[str], axis: str, sums: dict[str, tuple[Column, str]], mode: str) -> DataFrame:
    """Pixels (keys, row, col, height, width, values, others) with values weighted along an axis (row or col) in one grouping.

    sums: for each result its taps, arrays of one odd length that are equal for all pixels of an image, and its value.
    Mirroring needs images larger than the reach.  Other columns are left out.
    """
    size = F.col("height" if axis == "row" else "width")
    taps = list({id(t): t for t, _ in sums.values()}.values())
    place = {id(t): f"w{i}" for i, t in enumerate(taps)}
    reach = F.floor(F.size(taps[0]) / 2).cast("int")
    values = list(dict.fromkeys(v for _, v in sums.values()))
    weights = F.transform(taps[0], lambda w, i: F.named_struct(F.lit("w0"), w, *[x for n, t in enumerate(taps[1:], 1) for x in (F.lit(f"w{n}"), t[i])]))
    sent = pixels.select(*keys, "row", "col", "height", "width", *values, weights.alias("_taps"), reach.alias("_reach"), F.explode(_seen_at(F.col(axis), size, reach, mode)).alias("_shown"))
    placed = sent.select("*", F.posexplode("_taps").alias("_i", "_weight")).withColumn(axis, F.col("_shown") - F.col("_i") + F.col("_reach"))
    inside = placed.where((F.col(axis) >= 0) & (F.col(axis) < size))
    return inside.groupBy(*keys, "row", "col", "height", "width").agg(*[F.sum(F.col("_weight")[place[id(t)]] * F.col(v)).alias(name) for name, (t, v) in sums.items()])


def along(pixels: DataFrame, keys: list[str], axis: str, taps: Column, value: str, mode: str) -> DataFrame:
    """The same for one value, which keeps its name."""
    return along_each(pixels, keys, axis, {value: (taps, value)}, mode)


def _once(value: Column, function: Callable[[Column], Column]) -> Column:
    """A function of a value that is computed once, however often the function names it."""
    return F.transform(F.array(value), function)[0]


def gaussian_taps(sigma: Column) -> Column:
    """The weights of a Gaussian within four sigma."""
    reach = F.floor(4 * sigma + 0.5).cast("int")
    raw = F.transform(F.sequence(-reach, reach), lambda k: F.exp(-(k * k) / (2 * sigma * sigma)))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, b: a + b)
    return _once(raw, lambda r: _once(total(r), lambda whole: F.transform(r, lambda t: t / whole)))


def gaussian(pixels: DataFrame, keys: list[str], sigma: Column, value: str = "v") -> DataFrame:
    """Separable Gaussian smoothing; edges repeat the last pixel."""
    weighted = pixels.withColumn("_sigma_taps", gaussian_taps(sigma))
    return along(along(weighted, [*keys, "_sigma_taps"], "row", F.col("_sigma_taps"), value, "edge"), keys, "col", F.col("_sigma_taps"), value, "edge")


def laplacian(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """The 3x3 Laplacian with diagonal weights 2 and centre -8; borders mirror without repeating the edge."""
    sides = F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0))
    corners = along(along(pixels, keys, "row", sides, value, "mirror"), keys, "col", sides, value, "mirror")
    own = pixels.select(*keys, "row", "col", "height", "width", (-8 * F.col(value)).alias(value))
    parts = corners.withColumn(value, 2 * F.col(value)).unionByName(own)
    return parts.groupBy(*keys, "row", "col", "height", "width").agg(F.sum(value).alias(value))
