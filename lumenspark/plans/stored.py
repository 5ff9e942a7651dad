"""Queries of what is stored and read again: decoded files, ordered logs, bucketed tables, strips; and edges of pixel tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions import kernels
from lumenspark.functions.params import Enhance, Tiling, scaled
from lumenspark.operators import edges, jobs, scoring, strips
from lumenspark.plans import jobs as job_queries
from lumenspark.plans import names, pixels
from lumenspark.plans.names import OVERLAP, SIZE, dims
from lumenspark.plans.pixels import rounded
from lumenspark.sources import decoding, images, ordered, proxies

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query, and the SQL that it must agree with."""

    def add(function):
        QUERIES[function.__name__], SQL[function.__name__] = function, sql
        return function

    return add


# Files of 16 bits: gray and alpha, of which each row has another filter.


def png_files(spark: SparkSession, d: str) -> DataFrame:
    """(filename, content) of PNG files with 16 bits from the embeddings; in every seventh file a byte is flipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = []
            for vec_id, v in zip(batch["vec_id"], batch["embedding"], strict=True):
                level = np.rint((np.asarray(v, np.float64) + 1) / 2 * 65535).astype(np.uint16).reshape(8, 8)
                made = bytearray(decoding.encode_png(np.stack([level, 65535 - level], axis=-1)))
                if vec_id % 7 == 0:
                    made[50] ^= 255
                content.append(bytes(made))
            yield pd.DataFrame({"filename": [f"{i:08d}.png" for i in batch["vec_id"]], "content": content})

    return proxies.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "filename string, content binary")


_LEVELS = "SELECT printf('%08d.png', vec_id) AS filename, vec_id % 7 = 0 AS broken, i // 8 AS \"row\", i % 8 AS col, round_even((CAST(embedding[i + 1] AS DOUBLE) + 1) / 2 * 65535, 0) AS gray FROM embeddings, (SELECT unnest(range(64)) AS i)"


@query(f'SELECT filename, "row", col, gray, 65535 - gray AS alpha FROM ({_LEVELS}) WHERE NOT broken')
def decoded_levels(spark: SparkSession, d: str) -> DataFrame:
    whole = decoding.decode_files(png_files(spark, d)).where("error IS NULL")
    return images.to_pixels(whole, ("filename",), ("gray", "alpha"))


@query("SELECT printf('%08d.png', vec_id) AS filename, 'damaged PNG chunk' AS error FROM embeddings WHERE vec_id % 7 = 0")
def undecodable_files(spark: SparkSession, d: str) -> DataFrame:
    return decoding.decode_files(png_files(spark, d), pixels=False).where("error IS NOT NULL").select("filename", "error")


# Tables in the order of names.


@query(f"{names._SPLIT} SELECT row_number() OVER (ORDER BY filename) AS position, filename, sample_id, magnification, split FROM s")
def ordered_manifest(spark: SparkSession, d: str) -> DataFrame:
    path = f"{images.scratch_folder(spark)}/manifest"
    ordered.write_ordered(job_queries._manifest(spark, d), path, "filename", files=7)
    return ordered.read_ordered(spark, path).select("position", "filename", "sample_id", "magnification", "split")


_CROPPED = pixels._PAINTED.replace("gr AS (", "mags AS (SELECT DISTINCT filename, magnification FROM l),\ngr AS (", 1)


@query(f"""{_CROPPED} SELECT row_number() OVER (ORDER BY filename) AS position, filename, magnification, 'colour' AS colour_mode, CAST(original_height AS INT) AS original_height, 24 AS original_width, crop_top_px, crop_bottom_px, crop_left_px, crop_right_px, crop_capped,
CAST(original_height - crop_top_px - crop_bottom_px AS INT) AS output_height, 24 - crop_left_px - crop_right_px AS output_width, regexp_replace(filename, '\\.[^.]+$', '') || '.npy' AS output_path FROM cr JOIN mags USING (filename)""")
def crop_log(spark: SparkSession, d: str) -> DataFrame:
    folder = images.scratch_folder(spark)
    jobs.normalise_job(pixels._painted_payload(spark, d), "colour", f"{folder}/normalised", f"{folder}/log", pixels._BORDER)
    return ordered.read_ordered(spark, f"{folder}/log")


@query(f"""WITH {proxies.E_SQL}, f AS (SELECT DISTINCT filename, magnification, magnification / 100.0::DOUBLE AS k, regexp_replace(filename, '\\.[^.]+$', '') AS stem FROM e), n AS (SELECT *, CAST(greatest(round_even(3.0::DOUBLE * k, 0), 1) AS INT) AS patch FROM f)
SELECT row_number() OVER (ORDER BY filename) AS position, filename, magnification, 4.0::DOUBLE * k AS flat_field_radius_px, 4.0::DOUBLE AS flat_field_working_radius_px, patch + CASE WHEN patch % 2 = 0 THEN 1 ELSE 0 END AS denoise_patch_size_px,
CAST(greatest(round_even(2.0::DOUBLE * k, 0), 1) AS INT) AS denoise_patch_distance_px, 2.0::DOUBLE * k AS denoise_boundary_limit_px, CAST(greatest(round_even(8.0::DOUBLE * k, 0), 1) AS INT) AS clahe_kernel_size_px, 0.01::DOUBLE AS clahe_clip_limit,
stem || '/flat_field.npy' AS flat_field_output_path, stem || '/denoised.npy' AS denoised_output_path, stem || '/clahe.npy' AS clahe_output_path FROM n""")
def enhance_log(spark: SparkSession, d: str) -> DataFrame:
    folder = images.scratch_folder(spark)
    jobs.enhance_job(proxies.gray_payload(spark, d), f"{folder}/enhanced", f"{folder}/log", pixels._SMALL)
    return ordered.read_ordered(spark, f"{folder}/log").drop("denoise_sigma_est", "denoise_h")


@query(f"""{names._GRID} SELECT row_number() OVER (ORDER BY filename, row0, col0) AS position, tile_filename, filename AS source_filename, magnification, tile_row_idx, tile_col_idx, row0, col0, 8 AS tile_size_px, height AS source_height_px, width AS source_width_px,
regexp_replace(filename, '\\.[^.]+$', '') || '/' || tile_filename AS tile_path FROM tiles""")
def tile_log(spark: SparkSession, d: str) -> DataFrame:
    folder = images.scratch_folder(spark)
    jobs.tile_job(proxies.rgb_payload(spark, d), f"{folder}/tiles", f"{folder}/log", Tiling(SIZE, OVERLAP))
    return ordered.read_ordered(spark, f"{folder}/log")


# Tables by buckets.


@query(job_queries.SQL["payload_lookup"])
def bucketed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a tile log fetch their payloads where both are bucketed by the tile: neither side moves."""
    folder, keys = images.scratch_folder(spark), ["source_filename", "tile_filename"]
    tables = [f"{n}_{uuid.uuid4().hex}" for n in ("tile_payloads", "tile_rows")]
    images.write_bucketed(pixels._cut(spark, d), tables[0], f"{folder}/payloads", keys, 8)
    images.write_bucketed(names._tiles(spark, d).where("row0 % 8 = 0").select(*keys), tables[1], f"{folder}/log", keys, 8)
    chosen = scoring.payloads_of(spark.table(tables[1]), spark.table(tables[0]), keys)

    def ends(row, image):
        yield {"low": float(image.min()), "high": float(image.max())}

    return images.map_images(chosen, ("source_filename", "row0", "col0"), ends, "low double, high double")


# Strips of rows.


@query(f"""WITH {proxies.E_SQL}, g AS (SELECT *, 0.25::DOUBLE * magnification / 100 AS s FROM e),
k AS (SELECT magnification, k, exp(-(k * k) / (2 * s * s)) AS w FROM (SELECT DISTINCT magnification, s FROM g), (SELECT unnest(range(-2, 3)) AS k) WHERE abs(k) <= floor(4 * s + 0.5::DOUBLE)),
t AS (SELECT magnification, k, w / sum(w) OVER (PARTITION BY magnification) AS w FROM k),
u AS (SELECT a.filename, a.magnification, a."row", a.col, sum(w * b.v) AS v FROM g a JOIN t USING (magnification) JOIN g b ON (b.filename = a.filename AND b.col = a.col AND b."row" = least(greatest(a."row" + k, 0), 7)) GROUP BY ALL)
SELECT a.filename, a."row", a.col, round(sum(w * b.v), 6) AS v FROM u a JOIN t USING (magnification) JOIN u b ON (b.filename = a.filename AND b."row" = a."row" AND b.col = least(greatest(a.col + k, 0), 7)) GROUP BY ALL""")
def gaussian_in_strips(spark: SparkSession, d: str) -> DataFrame:
    """Smoothing in strips of three rows, or as many as the kernel reaches and one."""
    sigma = scaled(0.25)
    reach = F.floor(4 * sigma + 0.5).cast("int")
    cut = strips.cut_strips(proxies.gray_payload(spark, d), ("filename", "magnification"), 3, reach)
    made = strips.map_strips(cut, ("filename", "magnification"), lambda row, strip: kernels.gaussian(strip, row.sigma), sigma=sigma)
    return rounded(images.to_pixels(strips.join_strips(made, ("filename",)), ("filename",), ("v",)), "v")


@query(pixels.SQL["reassemble"])
def reassembled_strips(spark: SparkSession, d: str) -> DataFrame:
    sized = pixels._cut(spark, d).join(dims(spark, d).select(F.col("filename").alias("source_filename"), F.col("height").alias("source_height_px"), F.col("width").alias("source_width_px")), "source_filename")
    made = strips.reassemble_in_strips(sized, 5, OVERLAP)
    shown = images.to_pixels(made, ("source_filename", "strip_row0"), ("r", "g", "b"))
    return shown.select(F.col("source_filename").alias("filename"), (F.col("row") + F.col("strip_row0")).alias("row"), "col", "r", "g", "b")


# Edges of pixel tables.


@query(pixels.EDGES_SQL)
def canny_table(spark: SparkSession, d: str) -> DataFrame:
    gray = proxies.gray_pixels(spark, d, spread=True).withColumns({"height": F.lit(8), "width": F.lit(8)})
    limits = gray.groupBy("filename").agg((0.1 * F.percentile("v", F.lit(0.6))).alias("low"), (0.3 * F.percentile("v", F.lit(0.9))).alias("high"))
    return edges.canny(gray, ["filename"], scaled(1.0), limits).select("filename", "row", "col")


# The chain of enhancement stages on the gray images: flat field, noise, denoising by that noise, local equalisation.

_CHAIN = Enhance(flat_field_radius_px=4.0, flat_field_working_radius_px=4.0, denoise_patch_distance_px=1, clahe_kernel_px=4)


def _cubic(n: str, m: str) -> str:
    """Weights (filename, p, q, w) of a side of n places in a copy of m."""
    return f"""(SELECT filename, p, CAST(least(greatest(floor(place) + k, 0), {m} - 1) AS INT) AS q, CASE WHEN d <= 1 THEN 1.25::DOUBLE * d * d * d - 2.25::DOUBLE * d * d + 1 WHEN d < 2 THEN -0.75::DOUBLE * d * d * d + 3.75::DOUBLE * d * d - 6 * d + 3 ELSE 0 END AS w
FROM (SELECT *, abs(place - floor(place) - k) AS d FROM (SELECT *, (p + 0.5::DOUBLE) * {m} / {n} - 0.5::DOUBLE AS place, unnest(range(-1, 3)) AS k FROM (SELECT *, CAST(unnest(range({n})) AS INT) AS p FROM dm))))"""


_PLACE = job_queries._mirrored
_APART = f"v[8 * ({_PLACE('y + a')}) + ({_PLACE('x + b')}) + 1] - v[8 * ({_PLACE('y + dy + a')}) + ({_PLACE('x + dx + b')}) + 1]"


@query(f"""WITH {proxies.E_SQL}, dm AS (SELECT filename, any_value(magnification) / 100.0::DOUBLE AS s, CAST(8 / (any_value(magnification) / 100) AS INT) AS m FROM e GROUP BY filename),
s2 AS (SELECT filename, CAST(floor("row" / s) AS INT) AS i, CAST(floor(col / s) AS INT) AS j, avg(v) AS v FROM e JOIN dm USING (filename) GROUP BY ALL),
o AS (SELECT dy, dx, 4 - sqrt(16.0::DOUBLE - dy * dy - dx * dx) AS lift FROM (SELECT CAST(unnest(range(-4, 5)) AS INT) AS dy), (SELECT CAST(unnest(range(-4, 5)) AS INT) AS dx) WHERE dy * dy + dx * dx <= 16),
un AS (SELECT a.filename, a.i, a.j, min(b.v + lift) AS v FROM (SELECT *, i + dy AS ib, j + dx AS jb FROM s2, o) a JOIN s2 b ON (b.filename = a.filename AND b.i = a.ib AND b.j = a.jb) GROUP BY ALL),
cw AS {_cubic("8", "m")},
e1 AS (SELECT filename, p AS y, j, sum(w * v) AS v FROM un JOIN cw USING (filename) WHERE q = i GROUP BY ALL), e2 AS (SELECT filename, y, p AS x, sum(w * v) AS u FROM e1 JOIN cw USING (filename) WHERE q = j GROUP BY ALL),
ot AS (SELECT e.filename, y, x, v / (u + 1e-6::DOUBLE) * avg(u) OVER (PARTITION BY e.filename) AS o FROM e JOIN e2 ON (e2.filename = e.filename AND y = e."row" AND x = e.col)),
mm AS (SELECT *, min(o) OVER (PARTITION BY filename) AS low, max(o) OVER (PARTITION BY filename) AS high FROM ot), fl AS MATERIALIZED (SELECT filename, y, x, CASE WHEN high > low THEN (o - low) / (high - low) ELSE 0 END AS f FROM mm),
ta AS (SELECT s, k, exp(-(k * k) / (2 * s * s)) / sum(exp(-(k * k) / (2 * s * s))) OVER (PARTITION BY s) AS w FROM (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS s), (SELECT CAST(unnest(range(-8, 9)) AS INT) AS k) WHERE abs(k) <= floor(4 * s + 0.5::DOUBLE)),
g1 AS (SELECT a.filename, a.y, a.x, sum(w * b.f) AS v FROM (SELECT *, least(greatest(y + k, 0), 7) AS yb FROM fl JOIN dm USING (filename) JOIN ta USING (s)) a JOIN fl b ON (b.filename = a.filename AND b.y = a.yb AND b.x = a.x) GROUP BY ALL),
g2 AS (SELECT a.filename, a.y, a.x, sum(w * b.v) AS g FROM (SELECT *, least(greatest(x + k, 0), 7) AS xb FROM g1 JOIN dm USING (filename) JOIN ta USING (s)) a JOIN g1 b ON (b.filename = a.filename AND b.y = a.y AND b.x = a.xb) GROUP BY ALL),
re AS (SELECT filename, f - g AS r FROM fl JOIN g2 USING (filename, y, x)), md AS (SELECT *, median(r) OVER (PARTITION BY filename) AS m FROM re), sg AS (SELECT filename, 0.8::DOUBLE * 1.4826::DOUBLE * median(abs(r - m)) AS h FROM md GROUP BY filename),
im AS (SELECT filename, s, h, list(f ORDER BY y, x) AS v FROM fl JOIN dm USING (filename) JOIN sg USING (filename) GROUP BY ALL),
po AS (SELECT y, x FROM (SELECT CAST(unnest(range(8)) AS INT) AS y), (SELECT CAST(unnest(range(8)) AS INT) AS x)),
sh AS (SELECT s, dy, dx, a, b FROM (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS s), (SELECT CAST(unnest(range(-2, 3)) AS INT) AS dy), (SELECT CAST(unnest(range(-2, 3)) AS INT) AS dx), (SELECT CAST(unnest(range(-3, 4)) AS INT) AS a), (SELECT CAST(unnest(range(-3, 4)) AS INT) AS b)
       WHERE greatest(abs(dy), abs(dx)) <= s AND greatest(abs(a), abs(b)) <= CASE WHEN s = 1 THEN 1 ELSE 3 END),
w AS (SELECT filename, y, x, dy, dx, exp(-avg(pow({_APART}, 2)) / nullif(any_value(h) * any_value(h), 0)) AS w, any_value(v[8 * ({_PLACE('y + dy')}) + ({_PLACE('x + dx')}) + 1]) AS u, any_value(v[8 * y + x + 1]) AS own
      FROM im JOIN sh USING (s), po GROUP BY filename, y, x, dy, dx),
ca AS (SELECT filename, y AS "row", x AS col, coalesce(least(greatest(sum(w * u) / sum(w), 0), 1), any_value(own)) AS v FROM w GROUP BY filename, y, x),
t AS (SELECT ca.*, CASE WHEN s = 1 THEN 2 ELSE 1 END AS k, least(CAST(floor(v * 256) AS INT), 255) AS level FROM ca JOIN dm USING (filename)),
c AS (SELECT filename, k, "row" * k // 8 AS i, col * k // 8 AS j, level, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT *, 64.0::DOUBLE / (k * k) AS size, greatest(0.01::DOUBLE * 64 / (k * k), 1) AS most FROM c),
z AS (SELECT filename, i, j, any_value(size) AS size, sum(greatest(n - most, 0)) AS extra, list(struct_pack(l := level, n := least(n, most))) AS bins FROM g GROUP BY ALL),
y AS (SELECT filename, "row", col, k, level, least(greatest(("row" + 0.5::DOUBLE) * k / 8 - 0.5::DOUBLE, 0), k - 1) AS y, least(greatest((col + 0.5::DOUBLE) * k / 8 - 0.5::DOUBLE, 0), k - 1) AS x FROM t),
q AS (SELECT *, CAST(floor(y) AS INT) AS y0, CAST(floor(x) AS INT) AS x0, unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b FROM y),
m AS (SELECT filename, "row", col, level, CASE WHEN a = 1 THEN y - y0 ELSE 1 - (y - y0) END * CASE WHEN b = 1 THEN x - x0 ELSE 1 - (x - x0) END AS share, least(y0 + a, k - 1) AS i, least(x0 + b, k - 1) AS j FROM q),
ev AS (SELECT filename, "row", col, sum(share * (coalesce(list_sum([s.n for s in bins if s.l <= level]), 0) + extra * (level + 1) / 256) / size) AS v FROM m JOIN z USING (filename, i, j) GROUP BY ALL),
al AS (SELECT 'flat_field' AS stage, filename, y AS "row", x AS col, f AS v FROM fl UNION ALL SELECT 'denoised', filename, "row", col, v FROM ca UNION ALL SELECT 'clahe', filename, "row", col, v FROM ev)
SELECT stage, filename, round(min(v), 3) AS low, round(sum(v * ("row" * 8 + col + 1)), 3) AS weighted, round(max(v), 3) AS high FROM (SELECT stage, filename, "row", col, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM al) GROUP BY stage, filename""")
def enhanced_gray(spark: SparkSession, d: str) -> DataFrame:
    """All three stages of each gray image: the least and greatest value, and a sum in which each place has its weight."""
    made = scoring.enhance(proxies.gray_payload(spark, d), _CHAIN)
    weight = np.arange(1, 65, dtype=np.float64).reshape(8, 8)

    def told(row, image):
        yield {"low": float(image.min()), "weighted": float((image.astype(np.float64) * weight).sum()), "high": float(image.max())}

    return images.map_images(made, ("stage", "filename"), told, "low double, weighted double, high double").withColumns({n: F.round(n, 3) for n in ("low", "weighted", "high")})
