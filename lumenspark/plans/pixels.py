"""Queries over pixels: colour, borders, quality, gate, tiles, scoring.

Jobs run on payloads with NumPy helpers; the SQL states the same on pixel tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions import colour, kernels
from lumenspark.functions.params import Border, Enhance, Quality, scaled
from lumenspark.operators import colour_mode, quality, scoring, tiling
from lumenspark.plans import names
from lumenspark.plans.names import OVERLAP, SIZE, dims
from lumenspark.sources import proxies
from lumenspark.sources.images import PAYLOAD, in_small_batches, map_images, payload_of, scratch_folder, to_payload, to_pixels
from lumenspark.streaming.incremental import score_arrivals

QUERIES: dict = {}
SQL: dict[str, str] = {}
_KEYS = ["filename", "magnification"]


def query(sql: str | None = None):
    """Register a query, and the SQL that it must agree with."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _rgb() -> list[F.Column]:
    return [F.col(c) for c in "rgb"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_L = f"WITH {proxies.l_sql()}"


@query(f'{_L} SELECT filename, "row", col, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS luminance FROM l')
def luminance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(proxies.rgb_pixels(spark, d).select("filename", "row", "col", colour.luminance(*_rgb()).alias("luminance")), "luminance")


@query(f'{_L} SELECT filename, "row", col, CAST(round_even(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 9), 0) AS INT) AS gray FROM l')
def gray8(spark: SparkSession, d: str) -> DataFrame:
    return proxies.rgb_pixels(spark, d).select("filename", "row", "col", F.rint(F.round(colour.luminance(*_rgb()), 9)).cast("int").alias("gray"))


@query(f'{_L} SELECT filename, "row", col, round(r / 255.0::DOUBLE, 6) AS r, round(g / 255.0::DOUBLE, 6) AS g, round(b / 255.0::DOUBLE, 6) AS b FROM l')
def rgb_unit_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(proxies.rgb_pixels(spark, d).select("filename", "row", "col", *[colour.unit(F.col(c)).alias(c) for c in "rgb"]), "r", "g", "b")


_STRETCHED = "least(greatest(r / 200.0::DOUBLE - 0.1::DOUBLE, 0), 1)"


@query(f'{_L} SELECT filename, "row", col, CAST(round_even({_STRETCHED} * 255.0::DOUBLE, 0) AS INT) AS level FROM l')
def to_uint8(spark: SparkSession, d: str) -> DataFrame:
    return proxies.rgb_pixels(spark, d).select("filename", "row", "col", colour.to_level(F.col("r") / 200.0 - 0.1).alias("level"))


@query(f'{_L} SELECT filename, "row", col, CAST(round_even({_STRETCHED} * 65535.0::DOUBLE, 0) AS INT) AS level FROM l')
def to_uint16(spark: SparkSession, d: str) -> DataFrame:
    return proxies.rgb_pixels(spark, d).select("filename", "row", "col", colour.to_level(F.col("r") / 200.0 - 0.1, 16).alias("level"))


def _hsv(spark: SparkSession, d: str) -> DataFrame:
    unit = proxies.rgb_pixels(spark, d).withColumns({c: colour.unit(F.col(c)) for c in "rgb"})
    return unit.select(*_KEYS, "row", "col", colour.hue(*_rgb()).alias("h"), colour.saturation(*_rgb()).alias("s"), colour.value(*_rgb()).alias("v"))


_HSV = f"""{_L}, u AS (SELECT filename, magnification, "row", col, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM l),
x AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM u),
y AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN 60 * ((g - b) / (hi - lo)) WHEN hi = g THEN 60 * (2 + (b - r) / (hi - lo)) ELSE 60 * (4 + (r - g) / (hi - lo)) END AS h0 FROM x),
hsv AS (SELECT filename, magnification, "row", col, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS s, hi AS v FROM y)"""


@query(f'{_HSV} SELECT filename, "row", col, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v FROM hsv')
def hsv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_hsv(spark, d).drop("magnification"), "h", "s", "v")


_OTSU = f"""{_HSV}, span AS (SELECT magnification, min(v) AS lo, max(v) AS hi FROM hsv GROUP BY ALL),
c AS (SELECT magnification, least(CAST(floor(256.0::DOUBLE * (v - lo) / (hi - lo)) AS INT) + 1, 256) AS bin, count(*) AS n FROM hsv JOIN span USING (magnification) GROUP BY ALL),
grid AS (SELECT magnification, lo, hi, unnest(range(1, 257)) AS bin FROM span),
f AS (SELECT magnification, bin, coalesce(n, 0) AS n, lo + (bin - 0.5::DOUBLE) * (hi - lo) / 256 AS centre FROM grid LEFT JOIN c USING (magnification, bin)),
w AS (SELECT *, sum(n) OVER up AS w1, sum(n * centre) OVER up AS s1, sum(n) OVER down AS w2, sum(n * centre) OVER down AS s2 FROM f
      WINDOW up AS (PARTITION BY magnification ORDER BY bin ROWS UNBOUNDED PRECEDING), down AS (PARTITION BY magnification ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
t AS (SELECT magnification, arg_min(centre, (-round(CASE WHEN w1 > 0 AND w2 > 0 THEN CAST(w1 AS DOUBLE) * w2 * pow(s1 / w1 - s2 / w2, 2) ELSE 0 END, 3), bin)) AS threshold FROM w WHERE w2 IS NOT NULL GROUP BY magnification),
pop AS (SELECT hsv.*, threshold, v <= threshold AS low FROM hsv JOIN t USING (magnification)),
mo AS (SELECT magnification, count(*) AS n_pixels, any_value(threshold) AS threshold_v,
  count(*) FILTER (low) AS n_low, count(*) FILTER (NOT low) AS n_high, avg(s) FILTER (low) AS s_low, avg(s) FILTER (NOT low) AS s_high,
  var_samp(s) FILTER (low) AS vs_low, var_samp(s) FILTER (NOT low) AS vs_high,
  avg(cos(radians(h))) FILTER (low) AS c_low, avg(sin(radians(h))) FILTER (low) AS i_low, avg(cos(radians(h))) FILTER (NOT low) AS c_high, avg(sin(radians(h))) FILTER (NOT low) AS i_high
  FROM pop GROUP BY magnification),
ci AS (SELECT *, degrees(atan2(i_low, c_low)) AS a0, degrees(atan2(i_high, c_high)) AS b0, sqrt(-2 * ln(sqrt(c_low ** 2 + i_low ** 2))) AS sa, sqrt(-2 * ln(sqrt(c_high ** 2 + i_high ** 2))) AS sb FROM mo),
cj AS (SELECT *, CASE WHEN a0 < 0 THEN a0 + 360 ELSE a0 END AS a, CASE WHEN b0 < 0 THEN b0 + 360 ELSE b0 END AS b FROM ci),
ck AS (SELECT *, degrees(atan2(sin(radians(b - a)), cos(radians(b - a)))) AS diff FROM cj),
de AS (SELECT magnification, n_pixels, threshold_v, abs(radians(diff)) / sqrt((sa ** 2 + sb ** 2) / 2) AS eh, diff,
  (s_high - s_low) / sqrt(((n_low - 1) * vs_low + (n_high - 1) * vs_high) / (n_low + n_high - 2)) AS es, a, b, sa, sb FROM ck)"""


def _populations(spark: SparkSession, d: str) -> DataFrame:
    pixels = _hsv(spark, d)
    return colour_mode.populations(pixels, colour_mode.otsu(pixels))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return colour_mode.decisions(colour_mode.moments(_populations(spark, d)))


@query(f"{_OTSU} SELECT magnification, round(threshold, 6) AS threshold FROM t")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(colour_mode.otsu(_hsv(spark, d)), "threshold")


@query(f"{_OTSU} SELECT magnification, round(es, 6) AS d FROM de")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_decisions(spark, d).select("magnification", F.col("effect_size_s").alias("d")), "d")


@query(f"{_OTSU} SELECT magnification, round(a, 6) AS mean_low, round(b, 6) AS mean_high, round(sa, 6) AS spread_low, round(sb, 6) AS spread_high FROM de")
def circular_stats(spark: SparkSession, d: str) -> DataFrame:
    m = colour_mode.moments(_populations(spark, d))
    made = {f"{n}_{p}": f(F.col(f"cos_{p}"), F.col(f"sin_{p}")) for p in ("low", "high") for n, f in (("mean", colour_mode.circular_mean), ("spread", colour_mode.circular_spread))}
    return rounded(m.select("magnification", *[c.alias(n) for n, c in made.items()]), *made)


@query(f"{_OTSU} SELECT magnification, round(eh, 6) AS effect_size_h, round(diff, 6) AS hue_diff_deg FROM de")
def circular_effect(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_decisions(spark, d).select("magnification", "effect_size_h", "hue_diff_deg"), "effect_size_h", "hue_diff_deg")


_DECISION = "CASE WHEN eh > 0.2 OR abs(es) > 0.2 THEN 'colour' ELSE 'grayscale' END"


@query(f"{_OTSU} SELECT magnification, n_pixels, round(threshold_v, 6) AS threshold_v, round(eh, 6) AS effect_size_h, round(diff, 6) AS hue_diff_deg, round(es, 6) AS effect_size_s, {_DECISION} AS decision FROM de")
def colour_decision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_decisions(spark, d).drop("degenerate"), "threshold_v", "effect_size_h", "hue_diff_deg", "effect_size_s")


@query(f"{_OTSU}, k AS (SELECT {_DECISION} AS decision FROM de) SELECT CASE WHEN count(DISTINCT decision) = 1 THEN min(decision) ELSE 'disagreement' END AS decision, count(*) AS n_magnifications FROM k")
def colour_consensus(spark: SparkSession, d: str) -> DataFrame:
    return colour_mode.consensus(_decisions(spark, d))


@query(f"""{_OTSU}, st AS (SELECT magnification, low, 'h' AS channel, h / 360 AS x, 360.0::DOUBLE AS w FROM pop UNION ALL SELECT magnification, low, 's', s, 1 FROM pop UNION ALL SELECT magnification, low, 'v', v, 1 FROM pop),
hc AS (SELECT magnification, channel, low, w, least(CAST(floor(round(59.0::DOUBLE * x, 9)) AS INT) + 1, 59) AS bin, count(*) AS "count" FROM st GROUP BY ALL)
SELECT magnification, channel, low, bin, "count", round("count" / (sum("count") OVER (PARTITION BY magnification, channel, low) * w / 59), 6) AS density FROM hc""")
def hsv_histograms(spark: SparkSession, d: str) -> DataFrame:
    # values on a bin's edge are told apart alike in both engines after rounding the scaled value
    pixels = _populations(spark, d).withColumns({c: (F.floor(F.round(F.col(c) / top * 59, 9)) + 0.5) / 59 * top for c, top in (("h", 360.0), ("s", 1.0), ("v", 1.0))})
    return rounded(colour_mode.histograms(pixels, {"h": (0, 360), "s": (0, 1), "v": (0, 1)}), "density")


# Borders: the first two rows are painted.


def _painted(spark: SparkSession, d: str) -> DataFrame:
    return proxies.rgb_pixels(spark, d).withColumns({c: F.when(F.col("row") < 2, 12).otherwise(F.col(c)) for c in "rgb"})


def _painted_payload(spark: SparkSession, d: str) -> DataFrame:
    return to_payload(_painted(spark, d), _KEYS, ["r", "g", "b"], "uint8")


_PAINTED = f"""{_L}, q AS (SELECT filename, magnification, "row", col, CASE WHEN "row" < 2 THEN 12 ELSE r END AS r, CASE WHEN "row" < 2 THEN 12 ELSE g END AS g, CASE WHEN "row" < 2 THEN 12 ELSE b END AS b FROM l),
gr AS (SELECT *, round_even(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 9), 0) AS y, max("row") OVER (PARTITION BY filename) + 1 AS h FROM q),
va AS (SELECT filename, 'row' AS axis, "row" AS idx, var_pop(y) AS variance, any_value(h) AS n FROM gr GROUP BY filename, "row" UNION ALL SELECT filename, 'col', col, var_pop(y), 24 FROM gr GROUP BY filename, col),
th AS (SELECT filename, axis, median(variance) * 0.5 AS t FROM va GROUP BY ALL),
ru AS (SELECT filename, axis, any_value(n) AS n, least(CAST(floor(any_value(n) * 0.15::DOUBLE) AS INT), coalesce(min(idx) FILTER (variance > t), any_value(n))) AS ahead,
       least(CAST(floor(any_value(n) * 0.15::DOUBLE) AS INT), coalesce(min(n - 1 - idx) FILTER (variance > t), any_value(n))) AS behind, CAST(floor(any_value(n) * 0.15::DOUBLE) AS INT) AS cap
       FROM va JOIN th USING (filename, axis) GROUP BY filename, axis),
cr AS (SELECT a.filename, a.ahead AS crop_top_px, a.behind AS crop_bottom_px, b.ahead AS crop_left_px, b.behind AS crop_right_px,
       (a.cap > 0 AND greatest(a.ahead, a.behind) = a.cap) OR (b.cap > 0 AND greatest(b.ahead, b.behind) = b.cap) AS crop_capped, a.n AS original_height FROM ru a JOIN ru b USING (filename) WHERE a.axis = 'row' AND b.axis = 'col')"""
_BORDER = Border(variance_ratio=0.5)


@query(f"{_PAINTED} SELECT filename, axis, idx, round(variance, 6) AS variance FROM va")
def row_col_variance(spark: SparkSession, d: str) -> DataFrame:
    gray = _painted(spark, d).select("filename", "row", "col", F.rint(F.round(colour.luminance(*_rgb()), 9)).alias("y"))
    sides = [gray.groupBy("filename", F.lit(a).alias("axis"), F.col(a).alias("idx")).agg(F.var_pop("y").alias("variance")) for a in ("row", "col")]
    return rounded(sides[0].union(sides[1]), "variance")


@query(f"{_PAINTED} SELECT filename, crop_top_px, crop_bottom_px, crop_left_px, crop_right_px, crop_capped FROM cr")
def border_crop(spark: SparkSession, d: str) -> DataFrame:
    return quality.normalise(_painted_payload(spark, d), "colour", _BORDER).select("filename", "crop_top_px", "crop_bottom_px", "crop_left_px", "crop_right_px", "crop_capped")


@query(f"""{_PAINTED} SELECT filename, "row" - crop_top_px AS "row", col - crop_left_px AS col, round(CAST(CAST(r / 255.0::DOUBLE AS FLOAT) AS DOUBLE), 6) AS r, round(CAST(CAST(g / 255.0::DOUBLE AS FLOAT) AS DOUBLE), 6) AS g, round(CAST(CAST(b / 255.0::DOUBLE AS FLOAT) AS DOUBLE), 6) AS b
FROM gr JOIN cr USING (filename) WHERE "row" >= crop_top_px AND "row" < h - crop_bottom_px AND col >= crop_left_px AND col < 24 - crop_right_px""")
def normalised_pixels(spark: SparkSession, d: str) -> DataFrame:
    made = quality.normalise(_painted_payload(spark, d), "colour", _BORDER)
    return rounded(to_pixels(made, ("filename",), ("r", "g", "b")), "r", "g", "b")


# Quality of the gray images, in tiles of 5 that leave smaller ones at the edges.

_CONFIG = Quality(tile_size_px=5, noise_sigma_px=1.0, illumination_sigma_px=1.5)


def quality_sql(pixels: str) -> str:
    """Metrics at both scopes from a pixel table e(filename, magnification, row, col, v), as CTEs that end in q."""
    def smooth(source: str, keys: str, sigma: str, name: str) -> str:
        return f"""{name}k AS (SELECT m AS magnification, k, exp(-(k * k) / (2 * pow({sigma} * m / 100.0::DOUBLE, 2))) AS t FROM (SELECT unnest([100, 200]) AS m), (SELECT unnest(range(-16, 17)) AS k) WHERE abs(k) <= floor(4 * {sigma} * m / 100.0::DOUBLE + 0.5::DOUBLE)),
{name}w AS (SELECT magnification, k, t / sum(t) OVER (PARTITION BY magnification) AS t FROM {name}k),
{name}1 AS (SELECT {keys}, a.magnification, a.r, a.c, any_value(a.h) AS h, any_value(a.w) AS w, any_value(a.v) AS v, sum(t * b.v) AS y FROM {source} a JOIN {name}w USING (magnification) JOIN {source} b ON ({' AND '.join(f'a.{x} = b.{x}' for x in keys.split(', '))} AND b.c = a.c AND b.r = greatest(0, least(a.h - 1, a.r + k))) GROUP BY ALL),
{name} AS (SELECT {keys}, a.magnification, a.r, a.c, any_value(a.v) AS v, sum(t * b.y) AS f FROM {name}1 a JOIN {name}w USING (magnification) JOIN {name}1 b ON ({' AND '.join(f'a.{x} = b.{x}' for x in keys.split(', '))} AND b.r = a.r AND b.c = greatest(0, least(a.w - 1, a.c + k))) GROUP BY ALL)"""

    fit = smooth("im", "id", "1.5::DOUBLE", "fit").replace("SELECT id, a.", "SELECT a.id, a.")
    noise = smooth("re", "id, reg", "1.0::DOUBLE", "noi").replace("SELECT id, reg, a.", "SELECT a.id, a.reg, a.")
    return f"""{pixels},
im AS (SELECT filename AS id, magnification, "row" AS r, col AS c, v, 8 AS h, 8 AS w FROM e),
re AS (SELECT id, 'i' AS reg, magnification, r, c, v, h, w FROM im UNION ALL
       SELECT id, (r // 5) || '_' || (c // 5), magnification, r % 5, c % 5, v, least(5, 8 - 5 * (r // 5)), least(5, 8 - 5 * (c // 5)) FROM im),
{fit},
{noise},
nm AS (SELECT id, reg, 1.4826::DOUBLE * median(abs(v - f - m)) AS noise_mad_sigma FROM noi JOIN (SELECT id, reg, median(v - f) AS m FROM noi GROUP BY ALL) USING (id, reg) GROUP BY ALL),
st AS (SELECT unnest([-1, -1, 1, 1]) AS dr, unnest([-1, 1, -1, 1]) AS dc),
la AS (SELECT a.id, a.reg, a.r, a.c, 2 * sum(b.v) - 8 * any_value(a.v) AS y FROM re a, st JOIN re b ON (a.id = b.id AND a.reg = b.reg
       AND b.r = CASE WHEN a.r + dr < 0 THEN 1 WHEN a.r + dr > a.h - 1 THEN a.h - 2 ELSE a.r + dr END AND b.c = CASE WHEN a.c + dc < 0 THEN 1 WHEN a.c + dc > a.w - 1 THEN a.w - 2 ELSE a.c + dc END) GROUP BY ALL),
fo AS (SELECT id, reg, var_pop(y) AS focus_variance_of_laplacian FROM la GROUP BY ALL),
co AS (SELECT id, reg, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS contrast_spread FROM re GROUP BY ALL),
en AS (SELECT id, reg, abs(-sum(n / t * log2(n / t))) AS entropy FROM (SELECT id, reg, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY id, reg) AS t FROM re GROUP BY id, reg, v) GROUP BY ALL),
ra AS (SELECT id, max(v) - min(v) AS span FROM im GROUP BY id),
fr AS (SELECT id, 'i' AS reg, f FROM fit UNION ALL SELECT id, (r // 5) || '_' || (c // 5), f FROM fit),
il AS (SELECT id, reg, avg(f) AS illumination_level, CASE WHEN any_value(span) > 0 THEN (max(f) - min(f)) / any_value(span) ELSE 0 END AS illumination_range_frac FROM fr JOIN ra USING (id) GROUP BY ALL),
q AS (SELECT id AS filename, any_value(magnification) AS magnification, CASE WHEN reg = 'i' THEN 'image' ELSE 'tile' END AS scope,
      CASE WHEN reg = 'i' THEN -1 ELSE CAST(split_part(reg, '_', 1) AS INT) END AS tile_row, CASE WHEN reg = 'i' THEN -1 ELSE CAST(split_part(reg, '_', 2) AS INT) END AS tile_col,
      any_value(h) AS tile_height_px, any_value(w) AS tile_width_px, any_value(focus_variance_of_laplacian) AS focus_variance_of_laplacian, any_value(noise_mad_sigma) AS noise_mad_sigma, any_value(contrast_spread) AS contrast_spread,
      any_value(entropy) AS entropy, any_value(illumination_level) AS illumination_level, any_value(illumination_range_frac) AS illumination_range_frac
      FROM re JOIN nm USING (id, reg) JOIN fo USING (id, reg) JOIN co USING (id, reg) JOIN en USING (id, reg) JOIN il USING (id, reg) GROUP BY id, reg)"""


_Q = quality_sql(f"WITH {proxies.E_SQL}")
_WHERE = "filename, scope, tile_row, tile_col"


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(proxies.gray_payload(spark, d), _CONFIG)


def _one_metric(*names: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(_quality(spark, d).select("filename", "scope", "tile_row", "tile_col", *names), *names)

    return run


for _name, _columns in (("focus_laplacian", ["focus_variance_of_laplacian"]), ("noise_mad", ["noise_mad_sigma"]), ("contrast_spread", ["contrast_spread"]), ("entropy", ["entropy"]), ("illumination_metrics", ["illumination_level", "illumination_range_frac"])):
    QUERIES[_name] = _one_metric(*_columns)
    SQL[_name] = f"{_Q} SELECT {_WHERE}, {', '.join(f'round({c}, 6) AS {c}' for c in _columns)} FROM q"

_ALL = ["focus_variance_of_laplacian", "noise_mad_sigma", "contrast_spread", "entropy", "illumination_level", "illumination_range_frac"]


@query(f"""{_Q} SELECT filename, magnification, scope, tile_row, tile_col, greatest(tile_row, 0) * 5 AS tile_top_px, greatest(tile_col, 0) * 5 AS tile_left_px, tile_height_px, tile_width_px,
{', '.join(f'round({c}, 6) AS {c}' for c in _ALL)}, illumination_range_frac > 0.1 AS illumination_flag FROM q""")
def quality_all_scopes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_quality(spark, d), *_ALL)


@query(f'{_Q} SELECT id AS filename, r AS "row", c AS col, round(f, 6) AS fit FROM fit')
def illumination_fit(spark: SparkSession, d: str) -> DataFrame:
    def one(row, image):
        yield payload_of(kernels.gaussian(image, row.sigma))

    made = map_images(proxies.gray_payload(spark, d), ("filename",), one, PAYLOAD, sigma=scaled(1.5))
    return rounded(to_pixels(made, ("filename",), ("fit",)), "fit")


@query(f"{_Q} SELECT filename, tile_row, round(max(contrast_spread) FILTER (tile_col = 0), 6) AS col_0, round(max(contrast_spread) FILTER (tile_col = 1), 6) AS col_1 FROM q WHERE scope = 'tile' GROUP BY ALL")
def heatmap_grid(spark: SparkSession, d: str) -> DataFrame:
    wide = quality.heatmap(_quality(spark, d), "contrast_spread", [0, 1])
    return wide.select("filename", "tile_row", F.round("0", 6).alias("col_0"), F.round("1", 6).alias("col_1"))


# Gate: after is a fixed change of each pixel.


def _before(spark: SparkSession, d: str) -> DataFrame:
    return quality.gate_metrics(proxies.gray_payload(spark, d), _CONFIG)


def _after(spark: SparkSession, d: str) -> DataFrame:
    changed = proxies.gray_pixels(spark, d).withColumn("v", F.col("v") * 0.9 + (F.col("col") % 3) * 0.01 + F.col("row") * 0.002)
    return quality.gate_metrics(to_payload(changed, _KEYS, ["v"]), _CONFIG)


_CHANGED = quality_sql(f"WITH {proxies.E_SQL.replace('e AS (', 'e9 AS (')}, e AS (SELECT filename, magnification, \"row\", col, v * 0.9::DOUBLE + (col % 3) * 0.01::DOUBLE + \"row\" * 0.002::DOUBLE AS v FROM e9)").removeprefix("WITH ")
_GATE = f"""WITH before AS ({_Q} SELECT * FROM q WHERE scope = 'image'), after AS (WITH {_CHANGED} SELECT * FROM q WHERE scope = 'image'),
j AS (SELECT a.filename, a.magnification, b.illumination_range_frac AS ib, a.illumination_range_frac AS ia, b.noise_mad_sigma AS nb, a.noise_mad_sigma AS na, b.focus_variance_of_laplacian AS fb, a.focus_variance_of_laplacian AS fa FROM after a JOIN before b USING (filename)),
v AS (SELECT *, CASE WHEN ib = 0 THEN CASE WHEN ia <= 0 THEN 0 ELSE '-inf'::DOUBLE END ELSE (ib - ia) / ib END AS di, CASE WHEN nb = 0 THEN CASE WHEN na <= 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE (na - nb) / nb END AS dn,
      CASE WHEN fb = 0 THEN CASE WHEN fa >= 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE (fb - fa) / fb END AS df FROM j),
k AS (SELECT *, di >= 0.5 AS illumination_pass, dn <= 0 AS noise_pass, df <= 0 AS focus_pass FROM v)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return quality.verdicts(quality.gate_join(_before(spark, d), _after(spark, d)))


@query(f"{_GATE} SELECT filename, magnification, round(ib, 6) AS illumination_range_frac_before, round(ia, 6) AS illumination_range_frac_after, round(nb, 6) AS noise_mad_sigma_before, round(na, 6) AS noise_mad_sigma_after, round(fb, 6) AS focus_variance_of_laplacian_before, round(fa, 6) AS focus_variance_of_laplacian_after FROM j")
def gate_join(spark: SparkSession, d: str) -> DataFrame:
    joined = quality.gate_join(_before(spark, d), _after(spark, d))
    return rounded(joined, *[f"{c}_{w}" for c in quality.GATED for w in ("before", "after")])


@query(f"{_Q} SELECT filename FROM q WHERE scope = 'image' AND NOT illumination_range_frac > 0.3")
def gate_missing(spark: SparkSession, d: str) -> DataFrame:
    metrics = _before(spark, d)
    return quality.gate_missing(metrics.where("illumination_range_frac > 0.3"), metrics)


@query(f"{_GATE} SELECT filename, round(di, 6) AS illumination_relative_decrease, round(dn, 6) AS noise_relative_increase, round(df, 6) AS focus_relative_decrease, illumination_pass, noise_pass, focus_pass, illumination_pass AND noise_pass AND focus_pass AS gate_pass FROM k")
def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    names = ["illumination_relative_decrease", "noise_relative_increase", "focus_relative_decrease"]
    return rounded(_gated(spark, d).select("filename", *names, "illumination_pass", "noise_pass", "focus_pass", "gate_pass"), *names)


@query(f"{_GATE} SELECT magnification, count(*) FILTER (illumination_pass AND noise_pass AND focus_pass) AS passed, count(*) AS total FROM k GROUP BY magnification")
def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.gate_summary(_gated(spark, d), "magnification")


# Tiles of the colour images, masks and labels from their red levels.

_TILE = f"""{_L}, di AS (SELECT filename, max("row") + 1 AS height FROM l GROUP BY filename),
o AS (SELECT filename, list_distinct(list_append(range(0, height - 8 + 1, 4), (height - 8)::BIGINT)) AS rs, list_distinct(list_append(range(0, 17, 4), 16::BIGINT)) AS cs FROM di),
gr AS (SELECT filename, row0, unnest(cs) AS col0 FROM (SELECT filename, cs, unnest(rs) AS row0 FROM o)),
tp AS (SELECT l.filename, row0, col0, "row" - row0 AS local_row, col - col0 AS local_col, r, g, b FROM l JOIN gr ON (l.filename = gr.filename AND "row" >= row0 AND "row" < row0 + 8 AND col >= col0 AND col < col0 + 8))"""


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return tiling.cut_tiles(to_payload(proxies.rgb_pixels(spark, d), _KEYS, ["r", "g", "b"]), SIZE, OVERLAP)


# Of each tile the number of pixels, and sums in which each place has its own weight: whole numbers.
_DIGEST = "count(*) AS n, sum(CAST(r AS BIGINT) * (8 * local_row + local_col + 1))::BIGINT AS red, sum(CAST(g AS BIGINT) * (8 * local_row + local_col + 1))::BIGINT AS green, sum(CAST(b AS BIGINT) * (8 * local_row + local_col + 1))::BIGINT AS blue"


def _digests(pixels: DataFrame) -> DataFrame:
    weight = 8 * F.col("local_row") + F.col("local_col") + 1
    return pixels.groupBy("filename", "row0", "col0").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long") * weight).alias(name) for c, name in (("r", "red"), ("g", "green"), ("b", "blue"))])


@query(f"{_TILE} SELECT filename, row0, col0, local_row, local_col, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM tp")
def tile_pixels(spark: SparkSession, d: str) -> DataFrame:
    in_small_batches(spark)
    tiles = to_pixels(_cut(spark, d), ("source_filename", "row0", "col0"), ("r", "g", "b"))
    return tiles.select(F.col("source_filename").alias("filename"), "row0", "col0", F.col("row").alias("local_row"), F.col("col").alias("local_col"), "r", "g", "b")


@query(f"{_TILE} SELECT filename, row0, col0, {_DIGEST} FROM tp GROUP BY filename, row0, col0")
def tile_pixel_join(spark: SparkSession, d: str) -> DataFrame:
    return _digests(tiling.pixels_in_tiles(proxies.rgb_pixels(spark, d), dims(spark, d).drop("magnification"), SIZE, OVERLAP))


@query(f'{_L} SELECT filename, "row", col, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM l')
def reassemble(spark: SparkSession, d: str) -> DataFrame:
    sized = _cut(spark, d).join(dims(spark, d).select(F.col("filename").alias("source_filename"), F.col("height").alias("source_height_px"), F.col("width").alias("source_width_px")), "source_filename")
    return to_pixels(tiling.reassemble(sized, OVERLAP), ("source_filename",), ("r", "g", "b")).withColumnRenamed("source_filename", "filename")


@query(f'{_TILE} SELECT filename, row0 + local_row AS "row", col0 + local_col AS col, any_value(r) AS r, count(*) AS n_tiles FROM tp GROUP BY ALL')
def reassemble_table(spark: SparkSession, d: str) -> DataFrame:
    placed = tiling.pixels_in_tiles(proxies.rgb_pixels(spark, d), dims(spark, d).drop("magnification"), SIZE, OVERLAP)
    return tiling.reassemble_pixels(placed, "r")


@query(f"""{_L}, c AS (SELECT filename AS tile, k AS mask_id, "row", col FROM l, (SELECT unnest(range(1, 5)) AS k) WHERE r >= 50 * k), a AS (SELECT tile, mask_id, count(*) AS area FROM c GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY area DESC, mask_id) AS rank FROM a) SELECT tile, "row", col, max(rank) AS label FROM c JOIN rk USING (tile, mask_id) GROUP BY ALL""")
def mask_flatten(spark: SparkSession, d: str) -> DataFrame:
    covered = proxies.rgb_pixels(spark, d).withColumn("mask_id", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("r >= 50 * mask_id").select(F.col("filename").alias("tile"), "mask_id", "row", "col")
    return scoring.flatten_masks(covered.groupBy("tile", "mask_id").agg(F.count("*").alias("area")), covered)


@query(f"""{_L}, s AS (SELECT unnest([0, 1, -1, 0, 0]) AS a, unnest([0, 0, 0, 1, -1]) AS b), n AS (SELECT filename, "row" + s.a AS "row", col + s.b AS col, r // 50 AS x, s.a = 0 AND s.b = 0 AS own FROM l, s)
SELECT filename, "row", col, max(x) <> min(x) AS boundary FROM n GROUP BY ALL HAVING bool_or(own)""")
def label_boundaries(spark: SparkSession, d: str) -> DataFrame:
    labels = proxies.rgb_pixels(spark, d).withColumn("label", F.floor(F.col("r") / 50))
    return scoring.thick_boundaries(labels, ["filename"])


# Jobs that SQL can't express; the tests hold them against their invariants.

_SMALL = Enhance(flat_field_radius_px=4.0, flat_field_working_radius_px=4.0, denoise_patch_distance_px=2, clahe_kernel_px=8)


def _summary(df: DataFrame, *keys: str) -> DataFrame:
    """The least, mean and greatest value of each payload."""

    def one(row, image):
        yield {"low": float(image.min()), "mean": float(image.mean(dtype=np.float64)), "high": float(image.max())}

    return map_images(df, keys, one, "low double, mean double, high double")


def _stage(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = scoring.enhance(proxies.rgb_payload(spark, d), _SMALL)
        return rounded(_summary(made.where(F.col("stage") == name), "filename", "denoise_sigma_est", "denoise_h"), "denoise_sigma_est", "denoise_h", "low", "mean", "high")

    return run


QUERIES |= {"flat_field": _stage("flat_field"), "denoise": _stage("denoised"), "clahe": _stage("clahe")}

# The reduced copy by area weights (of the same size at magnification 100), the ball of 4 px under it, cubic weights back, and the noise of what comes out.
SQL["flat_field"] = f"""{_L}, im AS (SELECT filename, any_value(magnification) / 100.0::DOUBLE AS s, CAST(max("row") + 1 AS INT) AS h FROM l GROUP BY filename),
dm AS (SELECT *, CAST(greatest(1, round_even(h / s, 0)) AS INT) AS hs, CAST(greatest(1, round_even(24 / s, 0)) AS INT) AS ws FROM im),
ch AS (SELECT filename, "row" AS y, col AS x, unnest([0, 1, 2]) AS c, unnest([r, g, b]) / 255.0::DOUBLE AS v FROM l),
ny AS (SELECT filename, h, hs, i, CAST(unnest(range(h)) AS INT) AS y FROM (SELECT *, CAST(unnest(range(hs)) AS INT) AS i FROM dm)), nx AS (SELECT filename, ws, j, CAST(unnest(range(24)) AS INT) AS x FROM (SELECT *, CAST(unnest(range(ws)) AS INT) AS j FROM dm)),
oy AS (SELECT *, greatest(least((i + 1) * (h::DOUBLE / hs), y + 1) - greatest(i * (h::DOUBLE / hs), y), 0) AS w FROM ny), ox AS (SELECT *, greatest(least((j + 1) * (24::DOUBLE / ws), x + 1) - greatest(j * (24::DOUBLE / ws), x), 0) AS w FROM nx),
wy AS (SELECT filename, i, y, w / sum(w) OVER (PARTITION BY filename, i) AS w FROM oy WHERE w > 0), wx AS (SELECT filename, j, x, w / sum(w) OVER (PARTITION BY filename, j) AS w FROM ox WHERE w > 0),
s1 AS (SELECT filename, c, i, x, sum(w * v) AS v FROM ch JOIN wy USING (filename, y) GROUP BY ALL), s2 AS (SELECT filename, c, i, j, sum(w * v) AS v FROM s1 JOIN wx USING (filename, x) GROUP BY ALL),
o AS (SELECT dy, dx, 4 - sqrt(16.0::DOUBLE - dy * dy - dx * dx) AS lift FROM (SELECT CAST(unnest(range(-4, 5)) AS INT) AS dy), (SELECT CAST(unnest(range(-4, 5)) AS INT) AS dx) WHERE dy * dy + dx * dx <= 16),
un AS (SELECT a.filename, a.c, a.i, a.j, min(b.v + lift) AS v FROM (SELECT *, i + dy AS ib, j + dx AS jb FROM s2, o) a JOIN s2 b ON (b.filename = a.filename AND b.c = a.c AND b.i = a.ib AND b.j = a.jb) GROUP BY ALL),
cu AS (SELECT filename, 'y' AS axis, h AS n, hs AS m FROM dm UNION ALL SELECT filename, 'x', 24, ws FROM dm), cp AS (SELECT *, (p + 0.5::DOUBLE) * m / n - 0.5::DOUBLE AS place FROM (SELECT *, CAST(unnest(range(n)) AS INT) AS p FROM cu)),
cd AS (SELECT *, floor(place) + k AS spot, abs(place - floor(place) - k) AS d FROM (SELECT *, unnest(range(-1, 3)) AS k FROM cp)),
cw AS (SELECT filename, axis, p, CAST(least(greatest(spot, 0), m - 1) AS INT) AS q, CASE WHEN d <= 1 THEN 1.25::DOUBLE * d * d * d - 2.25::DOUBLE * d * d + 1 WHEN d < 2 THEN -0.75::DOUBLE * d * d * d + 3.75::DOUBLE * d * d - 6 * d + 3 ELSE 0 END AS w FROM cd),
e1 AS (SELECT u.filename, c, p AS y, j, sum(w * v) AS v FROM un u JOIN cw ON (cw.filename = u.filename AND axis = 'y' AND q = i) GROUP BY ALL), e2 AS (SELECT e.filename, c, y, p AS x, sum(w * v) AS u FROM e1 e JOIN cw ON (cw.filename = e.filename AND axis = 'x' AND q = j) GROUP BY ALL),
ot AS (SELECT filename, c, y, x, v / (u + 1e-6::DOUBLE) * avg(u) OVER (PARTITION BY filename, c) AS o FROM ch JOIN e2 USING (filename, c, y, x)),
mm AS (SELECT *, min(o) OVER (PARTITION BY filename, c) AS low, max(o) OVER (PARTITION BY filename, c) AS high FROM ot), fl AS (SELECT filename, c, y, x, CASE WHEN high > low THEN (o - low) / (high - low) ELSE 0 END AS f FROM mm),
lu AS (SELECT filename, y, x, sum(f * CASE c WHEN 0 THEN 0.299::DOUBLE WHEN 1 THEN 0.587::DOUBLE ELSE 0.114::DOUBLE END) AS v FROM fl GROUP BY ALL),
ta AS (SELECT s, k, exp(-(k * k) / (2 * s * s)) / sum(exp(-(k * k) / (2 * s * s))) OVER (PARTITION BY s) AS w FROM (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS s), (SELECT CAST(unnest(range(-8, 9)) AS INT) AS k) WHERE abs(k) <= floor(4 * s + 0.5::DOUBLE)),
g1 AS (SELECT a.filename, a.y, a.x, sum(w * b.v) AS v FROM (SELECT *, least(greatest(y + k, 0), h - 1) AS yb FROM lu JOIN dm USING (filename) JOIN ta USING (s)) a JOIN lu b ON (b.filename = a.filename AND b.y = a.yb AND b.x = a.x) GROUP BY ALL),
g2 AS (SELECT a.filename, a.y, a.x, sum(w * b.v) AS g FROM (SELECT *, least(greatest(x + k, 0), 23) AS xb FROM g1 JOIN dm USING (filename) JOIN ta USING (s)) a JOIN g1 b ON (b.filename = a.filename AND b.y = a.y AND b.x = a.xb) GROUP BY ALL),
re AS (SELECT filename, v - g AS r FROM lu JOIN g2 USING (filename, y, x)), md AS (SELECT *, median(r) OVER (PARTITION BY filename) AS m FROM re), sg AS (SELECT filename, 1.4826::DOUBLE * median(abs(r - m)) AS sigma FROM md GROUP BY filename)
SELECT filename, round(any_value(sigma), 6) AS denoise_sigma_est, round(any_value(0.8::DOUBLE * sigma), 6) AS denoise_h, round(min(CAST(CAST(f AS FLOAT) AS DOUBLE)), 6) AS low, round(avg(CAST(CAST(f AS FLOAT) AS DOUBLE)), 6) AS mean, round(max(CAST(CAST(f AS FLOAT) AS DOUBLE)), 6) AS high FROM fl JOIN sg USING (filename) GROUP BY filename"""


def _unit_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiling.cut_tiles(proxies.rgb_payload(spark, d), SIZE, OVERLAP)


def _scored(*models: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = scoring.score(scoring.pairs(_unit_tiles(spark, d), list(models)))
        return rounded(_summary(found.where("status = 'ok'"), "model", "source_filename", "tile_filename"), "low", "mean", "high")

    return run


QUERIES |= {"score_canny": _scored("canny"), "score_watershed": _scored("watershed")}

_CANNY_KEYS = "filename, row0, col0"


def _cell(values: str, y: str, x: str) -> str:
    """A place of an 8 x 8 list, where places outside count as the nearest inside."""
    return f"{values}[8 * least(greatest({y}, 0), 7) + least(greatest({x}, 0), 7) + 1]"


def _ahead(y: str, x: str) -> str:
    """A place of the gradients, 0 outside."""
    return f"CASE WHEN {y} BETWEEN 0 AND 7 AND {x} BETWEEN 0 AND 7 THEN st[8 * ({y}) + ({x}) + 1] ELSE 0 END"


_SOBEL = " + ".join(f"{weight} * ({_cell('sm', 'y + 1', f'x + ({b})')} - {_cell('sm', 'y - 1', f'x + ({b})')})" for weight, b in ((1, -1), (2, 0), (1, 1)))
_SOBEL_X = " + ".join(f"{weight} * ({_cell('sm', f'y + ({a})', 'x + 1')} - {_cell('sm', f'y + ({a})', 'x - 1')})" for weight, a in ((1, -1), (2, 0), (1, 1)))

# Gradients of the smoothed luminance, ridges, parts that reach the upper threshold by a recursive walk, and smoothing.
_EDGES = f"""th AS (SELECT {_CANNY_KEYS}, any_value(s) AS s, quantile_cont(v, 0.6) AS lo, quantile_cont(v, 0.9) AS hi, list(v ORDER BY y, x) AS v FROM px GROUP BY ALL),
pl AS (SELECT CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x FROM (SELECT unnest(range(64)) AS i)), k AS (SELECT CAST(unnest(range(-8, 9)) AS INT) AS k), ss AS (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS s),
ta AS (SELECT s, k, exp(-(k * k) / (2 * s * s)) / sum(exp(-(k * k) / (2 * s * s))) OVER (PARTITION BY s) AS w FROM ss, k WHERE abs(k) <= floor(4 * s + 0.5::DOUBLE)),
nm AS (SELECT s, y, sum(w) AS n FROM ta, (SELECT DISTINCT y FROM pl) WHERE y + k BETWEEN 0 AND 7 GROUP BY ALL),
b1 AS (SELECT a.filename, a.row0, a.col0, a.s, a.y, a.x, sum(w * b.v) AS v FROM px a JOIN px b ON (a.filename = b.filename AND a.row0 = b.row0 AND a.col0 = b.col0 AND a.x = b.x) JOIN ta ON (ta.s = a.s AND ta.k = b.y - a.y) GROUP BY ALL),
b2 AS (SELECT a.filename, a.row0, a.col0, a.s, a.y, a.x, sum(w * b.v) AS v FROM b1 a JOIN b1 b ON (a.filename = b.filename AND a.row0 = b.row0 AND a.col0 = b.col0 AND a.y = b.y) JOIN ta ON (ta.s = a.s AND ta.k = b.x - a.x) GROUP BY ALL),
b3 AS (SELECT {_CANNY_KEYS}, list(v / (u.n * w.n + 2.220446049250313e-16::DOUBLE) ORDER BY b2.y, b2.x) AS sm FROM b2 JOIN nm u ON (u.s = b2.s AND u.y = b2.y) JOIN nm w ON (w.s = b2.s AND w.y = b2.x) GROUP BY ALL),
gr2 AS (SELECT {_CANNY_KEYS}, y, x, {_SOBEL} AS dy, {_SOBEL_X} AS dx FROM b3, pl),
gm AS (SELECT *, sqrt(dy * dy + dx * dx) AS m, abs(dx) >= abs(dy) AS flat, CASE WHEN dy < 0 THEN -1 ELSE 1 END AS dv, CASE WHEN dx < 0 THEN -1 ELSE 1 END AS du, CASE WHEN dy = 0 AND dx = 0 THEN 0 ELSE least(abs(dy), abs(dx)) / greatest(abs(dy), abs(dx)) END AS share FROM gr2),
gl AS (SELECT {_CANNY_KEYS}, list(m ORDER BY y, x) AS st FROM gm GROUP BY ALL),
rd AS (SELECT {_CANNY_KEYS}, y, x, m, lo, hi, y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6
  AND (1 - share) * {_ahead("y + CASE WHEN flat THEN 0 ELSE dv END", "x + CASE WHEN flat THEN du ELSE 0 END")} + share * {_ahead("y + dv", "x + du")} <= m + 1e-9::DOUBLE
  AND (1 - share) * {_ahead("y - CASE WHEN flat THEN 0 ELSE dv END", "x - CASE WHEN flat THEN du ELSE 0 END")} + share * {_ahead("y - dv", "x - du")} <= m + 1e-9::DOUBLE AND m >= lo AND m > 0 AS weak FROM gm JOIN gl USING ({_CANNY_KEYS}) JOIN th USING ({_CANNY_KEYS})),
wk AS MATERIALIZED (SELECT * FROM rd WHERE weak),
rc AS (SELECT {_CANNY_KEYS}, y, x FROM wk WHERE m >= hi UNION SELECT b.filename, b.row0, b.col0, b.y, b.x FROM rc a JOIN wk b ON (a.filename = b.filename AND a.row0 = b.row0 AND a.col0 = b.col0 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1))"""
SQL["score_canny"] = f"""{_TILE.replace("WITH ", "WITH RECURSIVE ", 1)}, mg AS (SELECT DISTINCT filename, magnification FROM l),
px AS (SELECT {_CANNY_KEYS}, local_row AS y, local_col AS x, magnification / 100.0::DOUBLE AS s, 0.299::DOUBLE * (r / 255.0::DOUBLE) + 0.587::DOUBLE * (g / 255.0::DOUBLE) + 0.114::DOUBLE * (b / 255.0::DOUBLE) AS v FROM tp JOIN mg USING (filename)),
{_EDGES},
ed AS (SELECT t.filename, t.row0, t.col0, list(CASE WHEN rc.y IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ORDER BY pl.y, pl.x) AS e FROM th t CROSS JOIN pl LEFT JOIN rc ON (rc.filename = t.filename AND rc.row0 = t.row0 AND rc.col0 = t.col0 AND rc.y = pl.y AND rc.x = pl.x) GROUP BY ALL),
f1 AS (SELECT {_CANNY_KEYS}, list(z ORDER BY y, x) AS e FROM (SELECT {_CANNY_KEYS}, y, x, sum(w * {_cell("e", "y + k", "x")}) AS z FROM ed, pl, ta WHERE ta.s = 1 GROUP BY ALL) GROUP BY ALL),
f2 AS (SELECT {_CANNY_KEYS}, y, x, sum(w * {_cell("e", "y", "x + k")}) AS z FROM f1, pl, ta WHERE ta.s = 1 GROUP BY ALL),
f3 AS (SELECT *, max(z) OVER (PARTITION BY {_CANNY_KEYS}) AS top FROM f2), f4 AS (SELECT {_CANNY_KEYS}, CAST(CAST(least(greatest(CASE WHEN top > 0 THEN z / top ELSE z END, 0), 1) AS FLOAT) AS DOUBLE) AS z FROM f3)
SELECT 'canny' AS model, filename AS source_filename, printf('%s_r%05d_c%05d.npy', regexp_replace(filename, '\\.[^.]+$', ''), row0, col0) AS tile_filename, round(min(z), 6) AS low, round(avg(z), 6) AS mean, round(max(z), 6) AS high FROM f4 GROUP BY {_CANNY_KEYS}"""
# The same edges of the gray images, as places.
EDGES_SQL = f"""WITH RECURSIVE {proxies.E_SQL}, px AS (SELECT filename, 0 AS row0, 0 AS col0, "row" AS y, col AS x, magnification / 100.0::DOUBLE AS s, v FROM e),
{_EDGES.replace("quantile_cont(v, 0.6)", "0.1::DOUBLE * quantile_cont(v, 0.6)").replace("quantile_cont(v, 0.9)", "0.3::DOUBLE * quantile_cont(v, 0.9)")} SELECT filename, y AS "row", x AS col FROM rc"""


@query(f"{names._GRID} SELECT model, count(*) AS ran, count(*) AS ok, 0::BIGINT AS failed FROM tiles, (SELECT unnest(['canny', 'watershed']) AS model) GROUP BY model")
def score_all(spark: SparkSession, d: str) -> DataFrame:
    in_small_batches(spark)
    return scoring.run_summary(scoring.score(scoring.pairs(_unit_tiles(spark, d), ["canny", "watershed"]))).drop("elapsed_seconds")


@query(f"{names._GRID} SELECT 'canny' AS model, filename AS source_filename, tile_filename, 'ok' AS status FROM tiles")
def stream_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that arrive as files are scored once each; the same as score_all for one model."""
    in_small_batches(spark)
    folder = scratch_folder(spark)
    _unit_tiles(spark, d).write.parquet(f"{folder}/arrivals")
    score_arrivals(spark, f"{folder}/arrivals", ["canny"], f"{folder}/scored", f"{folder}/progress")
    return scoring.scoring_log(spark, f"{folder}/scored").select("model", "source_filename", "tile_filename", "status")
