"""Canny edges on pixel tables: for images that come as rows, or that no task can hold.

Smoothing and derivatives are stencils (see stencils.py).  A pixel sends its gradient to its eight
neighbours, which need it to tell whether they are on a ridge; parts of weak edges are connected by
links, whose ends give way to their neighbours in a mixed order until none is left, so that the rounds go with the
logarithm of a part's length, and each round is a table in the shared folder.  Tables of pixels meet by
shuffles alone: by the size of its files Spark would send a stored one through the driver, which has to hold
its rows, some fifty times as large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.operators.stencils import along_each, gaussian_taps
from lumenspark.sources.images import scratch_folder

_AROUND = [(v, u) for v in (-1, 0, 1) for u in (-1, 0, 1) if (v, u) != (0, 0)]


def _sent(pixels: DataFrame, ways: list[tuple[int, int]], *values: str) -> DataFrame:
    """Each pixel's values at the places some ways before it; v and u are the way to the sender."""
    shifts = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(u).alias("u")) for v, u in ways])
    kept = [c for c in pixels.columns if c not in ("row", "col", *values)]
    return pixels.select(*kept, *values, F.explode(shifts).alias("_s"), "row", "col").select(*kept, *values, (F.col("row") - F.col("_s.v")).alias("row"), (F.col("col") - F.col("_s.u")).alias("col"), F.col("_s.v").alias("v"), F.col("_s.u").alias("u"))


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by a shuffle, whatever the size of the files."""
    return left.join(right.hint("merge"), keys, how)


def _stored(df: DataFrame) -> DataFrame:
    path = f"{scratch_folder(df.sparkSession)}/pixels"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, row, col, width, others) of a mask with the part (the least place, row * width + col) of each, among 8 neighbours."""
    place = F.col("row").cast("long") * F.col("width") + F.col("col")
    own = pixels.withColumns({"part": place, "_place": place})
    places = own.select(*keys, "row", "col", F.col("part").alias("p"))
    # each pair of neighbours once
    ahead = _sent(places, _AROUND[4:], "p").select(*keys, "row", "col", F.col("p").alias("q"))
    links = _stored(_met(places, ahead, [*keys, "row", "col"]).select(*keys, "p", "q"))
    # the order in which ends give way is a mixed one: by their places, a line would give way pixel by pixel
    mixed = lambda at: F.struct(F.xxhash64(at).alias("mixed"), F.col(at).alias("at"))
    while not links.isEmpty():
        ends = links.select(*keys, "p", "q").union(links.select(*keys, "q", "p"))
        least = ends.groupBy(*keys, "p").agg(F.min(mixed("q")).alias("q")).select(*keys, "p", F.least(mixed("p"), "q")["at"].alias("to"))
        # the way of the place to which the way leads
        further = least.select(*keys, F.col("p").alias("to"), F.col("to").alias("last"))
        ways = _stored(_met(least, further, [*keys, "to"]).select(*keys, "p", "last"))
        own = _met(own, ways.withColumnRenamed("p", "part"), [*keys, "part"], "left").withColumn("part", F.coalesce("last", "part")).drop("last")
        moved = _met(links, ways, [*keys, "p"]).select(*keys, F.col("last").alias("p"), "q")
        moved = _met(moved, ways.withColumnRenamed("p", "q"), [*keys, "q"]).select(*keys, "p", F.col("last").alias("q"))
        links = _stored(moved.where("p <> q").distinct())
    own = _stored(own)
    first = own.groupBy(*keys, "part").agg(F.min("_place").alias("first"))
    return _met(own, first, [*keys, "part"]).select(*pixels.columns, F.col("first").alias("part"))


def gradients(pixels: DataFrame, keys: list[str], sigma: Column) -> DataFrame:
    """Pixels (keys, row, col, height, width, v) -> dy and dx, Sobel sums of the image smoothed among its own pixels."""
    rows = pixels.select(*keys, "row", "col", "height", "width", F.col("v").cast("double").alias("v"), F.lit(1.0).alias("one"), sigma.alias("_sigma"))
    gauss = gaussian_taps(F.col("_sigma"))
    both = {"v": (gauss, "v"), "one": (gauss, "one")}
    for axis in ("row", "col"):
        rows = along_each(rows, [*keys, "_sigma"], axis, both, "none")
    smooth = rows.withColumn("v", F.col("v") / (F.col("one") + F.lit(2.220446049250313e-16)))
    apart, mean = F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0))
    half = along_each(smooth, keys, "row", {"dy": (apart, "v"), "dx": (mean, "v")}, "edge")
    return along_each(half, keys, "col", {"dy": (mean, "dy"), "dx": (apart, "dx")}, "edge")


def canny(pixels: DataFrame, keys: list[str], sigma: Column, limits: DataFrame) -> DataFrame:
    """Edge pixels (keys, row, col, part): ridges of at least low in parts that reach high; limits has keys, low and high.

    As kernels.canny: a ridge is no less than what is ahead and behind, interpolated between the two neighbours that
    the direction passes between; the outermost pixels are no edges.
    """
    c = F.col
    steep = gradients(pixels, keys, sigma).withColumn("m", F.hypot("dy", "dx"))
    place = [*keys, "row", "col", "height", "width"]
    sender = lambda v, u: (c("v") == v) & (c("u") == u)
    name = lambda v, u: f"_m{v + 1}{u + 1}"
    ways = [*_AROUND, (0, 0)]
    # of each place its own values and the gradients around it, in one grouping
    around = _sent(steep, ways, "m", "dy", "dx").groupBy(*place).agg(*[F.max(F.when(sender(v, u), c("m"))).alias(name(v, u)) for v, u in ways], *[F.max(F.when(sender(0, 0), c(x))).alias(x) for x in ("dy", "dx")])
    inner = (c("row") > 0) & (c("col") > 0) & (c("row") < c("height") - 1) & (c("col") < c("width") - 1)
    ay, ax = F.abs("dy"), F.abs("dx")
    share = F.when(c("m") > 0, F.try_divide(F.least(ay, ax), F.greatest(ay, ax))).otherwise(0.0)
    turned = around.withColumnRenamed(name(0, 0), "m").where(inner & (c("m") > 0)).select("*", (ax >= ay).alias("flat"), share.alias("share"), F.when(c("dy") < 0, -1).otherwise(1).alias("dv"), F.when(c("dx") < 0, -1).otherwise(1).alias("du"))

    def at(v: Column, u: Column) -> Column:
        found = reduce(lambda chain, way: chain.when((v == way[0]) & (u == way[1]), c(name(*way))), _AROUND[1:], F.when((v == _AROUND[0][0]) & (u == _AROUND[0][1]), c(name(*_AROUND[0]))))
        return F.coalesce(found, F.lit(0.0))

    def ahead(way: int) -> Column:
        straight = at(F.when(c("flat"), 0).otherwise(way * c("dv")), F.when(c("flat"), way * c("du")).otherwise(0))
        return (1 - c("share")) * straight + c("share") * at(way * c("dv"), way * c("du"))

    ridges = turned.where((ahead(1) <= c("m") + 1e-9) & (ahead(-1) <= c("m") + 1e-9))
    weak = _stored(_met(ridges, limits.select(*keys, "low", "high"), keys).where(c("m") >= c("low")).select(*keys, "row", "col", "width", (c("m") >= c("high")).alias("strong")))
    parts = _stored(connected(weak, keys))
    reached = parts.where("strong").select(*keys, "part").distinct()
    return _met(parts, reached, [*keys, "part"], "left_semi").select(*keys, "row", "col", "part")
