"""Colour decision from pooled pixels.

Only counts, moments and 256 bins of each magnification are shuffled, never pixels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.functions import kernels
from lumenspark.sources.images import map_images

BINS = 256


def otsu(values: DataFrame, by: str = "magnification", v: str = "v") -> DataFrame:
    """(by, v) -> (by, threshold): Otsu's threshold over 256 bins; the value itself if all are equal."""
    span = values.groupBy(by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    bin_of = F.least(F.width_bucket(F.col(v), F.col("lo"), F.col("hi"), F.lit(BINS)), F.lit(BINS)).cast("int")
    counts = values.join(F.broadcast(span), by).where("lo < hi").groupBy(by, bin_of.alias("bin")).agg(F.count("*").alias("n"))  # a row for each magnification
    return otsu_of_counts(span, counts, by)


def otsu_of_counts(span: DataFrame, counts: DataFrame, by: str = "magnification") -> DataFrame:
    """(by, lo, hi) and (by, bin, n) -> (by, threshold)."""
    grid = span.where("lo < hi").select(by, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(BINS))).alias("bin"))
    full = grid.join(counts, [by, "bin"], "left").select(by, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("lo") + (F.col("bin") - 0.5) * (F.col("hi") - F.col("lo")) / BINS).alias("centre"))
    up = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(by).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    mass = F.col("n") * F.col("centre")
    sums = full.select(by, "bin", "centre", F.sum("n").over(up).alias("w1"), F.sum(mass).over(up).alias("s1"), F.sum("n").over(down).alias("w2"), F.sum(mass).over(down).alias("s2")).where("w2 is not null")
    between = F.when((F.col("w1") > 0) & (F.col("w2") > 0), F.col("w1") * F.col("w2") * F.pow(F.try_divide("s1", "w1") - F.try_divide("s2", "w2"), F.lit(2.0))).otherwise(0.0)
    # the first bin of the greatest separation; rounded, as sums differ in their last bits by their order
    best = sums.select(by, "centre", "bin", F.round(between, 3).alias("between")).groupBy(by).agg(F.min_by("centre", F.struct(-F.col("between"), F.col("bin"))).alias("threshold"))
    return best.union(span.where("lo = hi").select(by, F.col("lo").alias("threshold")))


def _half(low: Column, x: Column) -> tuple[Column, Column]:
    return F.when(low, x), F.when(~low, x)


def effect(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column, n_a: Column, n_b: Column) -> Column:
    """Cohen's d with the pooled sample variance; 0 without spread or with less than two values on a side."""
    pooled = F.sqrt(F.try_divide((n_a - 1) * var_a + (n_b - 1) * var_b, n_a + n_b - 2))
    return F.when((n_a < 2) | (n_b < 2) | pooled.isNull() | (pooled == 0), 0.0).otherwise(F.try_divide(mean_b - mean_a, pooled))


def circular_mean(cosine: Column, sine: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(sine, cosine)), F.lit(360.0))


def circular_spread(cosine: Column, sine: Column) -> Column:
    """Mardia's circular standard deviation in radians; infinite if the directions cancel."""
    r = F.hypot(cosine, sine)
    return F.when(r > 0, F.sqrt(F.greatest(-2.0 * F.ln(F.least(r, F.lit(1.0))), F.lit(0.0)))).otherwise(F.lit(float("inf")))


def wrapped_difference(a: Column, b: Column) -> Column:
    d = F.radians(b - a)
    return F.degrees(F.atan2(F.sin(d), F.cos(d)))


def circular_effect(a: Column, b: Column, spread_a: Column, spread_b: Column) -> Column:
    pooled = F.sqrt((spread_a * spread_a + spread_b * spread_b) / 2.0)
    return F.when((pooled == 0) | (pooled == float("inf")), 0.0).otherwise(F.abs(F.radians(wrapped_difference(a, b))) / F.when(pooled == 0, 1.0).otherwise(pooled))


def populations(pixels: DataFrame, thresholds: DataFrame, by: str = "magnification") -> DataFrame:
    """Pixels (by, h, s, v) with whether they are at most the threshold."""
    return pixels.join(F.broadcast(thresholds), by).withColumn("low", F.col("v") <= F.col("threshold"))  # a row for each magnification


def moments(pixels: DataFrame, by: str = "magnification") -> DataFrame:
    """Counts, means and variances of both populations, in one pass."""
    low = F.col("low")
    aggregates = [F.count("*").alias("n_pixels"), F.first("threshold").alias("threshold_v")]
    for name, of in (("low", low), ("high", ~low)):
        pick = lambda x, of=of: F.when(of, x)
        aggregates += [
            F.count(pick(F.lit(1))).alias(f"n_{name}"), F.avg(pick(F.col("s"))).alias(f"s_mean_{name}"), F.var_samp(pick(F.col("s"))).alias(f"s_var_{name}"),
            F.avg(pick(F.cos(F.radians("h")))).alias(f"cos_{name}"), F.avg(pick(F.sin(F.radians("h")))).alias(f"sin_{name}"),
        ]
    return pixels.groupBy(by).agg(*aggregates)


def decisions(moment: DataFrame, threshold: float = 0.2, by: str = "magnification") -> DataFrame:
    """(by, n_pixels, threshold_v, effect_size_h, hue_diff_deg, effect_size_s, decision, degenerate)."""
    c = F.col
    a, b = circular_mean(c("cos_low"), c("sin_low")), circular_mean(c("cos_high"), c("sin_high"))
    sa, sb = circular_spread(c("cos_low"), c("sin_low")), circular_spread(c("cos_high"), c("sin_high"))
    degenerate = (c("n_low") < 2) | (c("n_high") < 2)
    hue = F.when(degenerate, 0.0).otherwise(circular_effect(a, b, sa, sb))
    made = moment.select(by, "n_pixels", "threshold_v", hue.alias("effect_size_h"), F.when(degenerate, 0.0).otherwise(wrapped_difference(a, b)).alias("hue_diff_deg"), effect(c("s_mean_low"), c("s_mean_high"), c("s_var_low"), c("s_var_high"), c("n_low"), c("n_high")).alias("effect_size_s"), degenerate.alias("degenerate"))
    return made.withColumn("decision", F.when((c("effect_size_h") > threshold) | (F.abs("effect_size_s") > threshold), "colour").otherwise("grayscale"))


def consensus(decided: DataFrame) -> DataFrame:
    """One row: the decision that all magnifications share, or disagreement."""
    return decided.agg(F.when(F.count_distinct("decision") == 1, F.min("decision")).otherwise("disagreement").alias("decision"), F.count("*").alias("n_magnifications"))


def histograms(pixels: DataFrame, ranges: dict[str, tuple[float, float]], bins: int = 59, by: str = "magnification") -> DataFrame:
    """Densities of each channel in both populations: (by, channel, low, bin, count, density)."""
    stacked = pixels.select(by, "low", F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).alias("x"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, (a, b) in ranges.items()])).alias("c")).select(by, "low", "c.*")
    bin_of = F.least(F.width_bucket("x", "a", "b", F.lit(bins)), F.lit(bins)).cast("int")
    counted = stacked.groupBy(by, "channel", "low", "a", "b", bin_of.alias("bin")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(by, "channel", "low"))
    return counted.select(by, "channel", "low", "bin", "count", (F.col("count") / (total * (F.col("b") - F.col("a")) / bins)).alias("density"))


# The same from payloads: an image sends 256 counts and a row of sums, never its pixels.


def otsu_of_images(images: DataFrame, by: str = "magnification") -> DataFrame:
    """Payloads of unit-scaled colour images -> (by, threshold) of their brightness."""

    def ends(row, image):
        bright = image.max(axis=2)
        yield {"lo": float(bright.min()), "hi": float(bright.max())}

    span = map_images(images, (by,), ends, "lo double, hi double").groupBy(by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def binned(row, image):
        at = (BINS * (image.max(axis=2).ravel() - row.lo) / (row.hi - row.lo)).astype(int)
        counts = np.bincount(np.minimum(at, BINS - 1), minlength=BINS)
        for i in np.flatnonzero(counts).tolist():
            yield {"bin": i + 1, "n": int(counts[i])}

    ranged = images.join(F.broadcast(span.where("lo < hi")), by)  # a row for each magnification
    counts = map_images(ranged, (by,), binned, "bin int, n long", lo=F.col("lo"), hi=F.col("hi")).groupBy(by, "bin").agg(F.sum("n").alias("n"))
    return otsu_of_counts(span, counts, by)


def moments_of_images(images: DataFrame, thresholds: DataFrame, by: str = "magnification") -> DataFrame:
    """As moments, from payloads of unit-scaled colour images."""
    names = ("n", "s", "ss", "cos", "sin")

    def sums(row, image):
        h, s, v = kernels.hsv(image)
        out = {}
        for name, of in (("low", v <= row.threshold), ("high", v > row.threshold)):
            turn, some = np.radians(h[of]), s[of]
            out |= dict(zip((f"{x}_{name}" for x in names), (int(of.sum()), *map(float, (some.sum(), (some * some).sum(), np.cos(turn).sum(), np.sin(turn).sum()))), strict=True))
        yield out

    schema = ", ".join(f"{x}_{p} {'long' if x == 'n' else 'double'}" for p in ("low", "high") for x in names)
    told = images.join(F.broadcast(thresholds), by)  # a row for each magnification
    total = map_images(told, (by, "threshold"), sums, schema).groupBy(by, "threshold").agg(*[F.sum(f"{x}_{p}").alias(f"{x}_{p}") for p in ("low", "high") for x in names])
    made = [F.col(by), (F.col("n_low") + F.col("n_high")).alias("n_pixels"), F.col("threshold").alias("threshold_v")]
    for p in ("low", "high"):
        n, s, ss = (F.col(f"{x}_{p}") for x in ("n", "s", "ss"))
        mean = F.try_divide(s, n)
        spread = F.when(n > 1, F.greatest(ss - s * mean, F.lit(0.0)) / F.greatest(n - 1, F.lit(1)))
        made += [n.alias(f"n_{p}"), mean.alias(f"s_mean_{p}"), spread.alias(f"s_var_{p}"), F.try_divide(F.col(f"cos_{p}"), n).alias(f"cos_{p}"), F.try_divide(F.col(f"sin_{p}"), n).alias(f"sin_{p}")]
    return total.select(*made)


def decision_table(decided: DataFrame) -> DataFrame:
    """One row with the decision if all magnifications share it, and no row if they do not."""
    return consensus(decided).where(F.col("decision") != "disagreement")
