"""Queries of whole jobs, guards and kernels on small images, with their SQL.

A guard that stops a job with an error is registered as the query of the rows that it refuses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions import kernels
from lumenspark.functions.params import file_fingerprint, round_positive, scaled
from lumenspark.operators import colour_mode, manifest, scoring, stencils, tiling
from lumenspark.plans import names, pixels
from lumenspark.plans.names import OVERLAP, SIZE, dims
from lumenspark.plans.pixels import rounded
from lumenspark.sources import images, proxies

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query, and the SQL that it must agree with."""

    def add(function):
        QUERIES[function.__name__], SQL[function.__name__] = function, sql
        return function

    return add


# Sources and sinks: what is written is read again.

_SIZED = "512 + length(filename) AS height, 600 AS width"
_MANIFEST = f"{names._SPLIT} SELECT filename, sample_id, magnification, {_SIZED}, split, split_note FROM s"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    good, _ = manifest.parse_names(proxies.raw_names(spark, d))
    return manifest.build_manifest(good.select("filename", (F.length("filename") + 512).alias("height"), F.lit(600).alias("width")))


@query(_MANIFEST)
def manifest_job(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d)


@query(_MANIFEST)
def manifest_csv(spark: SparkSession, d: str) -> DataFrame:
    path = f"{images.scratch_folder(spark)}/manifest"
    images.write_csv(_manifest(spark, d), path)
    return images.read_csv(spark, path, images.MANIFEST).fillna("", ["split_note"])


@query(f"WITH {proxies.R_SQL} SELECT model, tile_filename, source_filename, magnification, status, elapsed_seconds FROM r")
def appended_log(spark: SparkSession, d: str) -> DataFrame:
    """A log that two micro-batches have filled."""
    path, log = f"{images.scratch_folder(spark)}/log", proxies.run_log(spark, d)
    for status in ("ok", "failed"):
        images.append_log(log.where(F.col("status") == status), path)
    return spark.read.parquet(path).select("model", "tile_filename", "source_filename", "magnification", "status", "elapsed_seconds")


@query(f'WITH {proxies.E_SQL} SELECT filename, magnification, "row", col, round(v, 6) AS v FROM e')
def stage_tables(spark: SparkSession, d: str) -> DataFrame:
    """Payloads as a stage's table by magnification, read again as pixels."""
    path = f"{images.scratch_folder(spark)}/payloads"
    images.write_table(proxies.gray_payload(spark, d), path, partition_by=("magnification",))
    return rounded(images.to_pixels(spark.read.parquet(path), ("filename", "magnification"), ("v",)), "v")


@query("SELECT page_id, substr(sha256(html), 1, 12) AS fingerprint FROM pages")
def content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return proxies.table(spark, d, "pages").select("page_id", file_fingerprint(F.encode("html", "UTF-8")).alias("fingerprint"))


# Guards.


@query(f"{names._DIMS} SELECT filename, height, width FROM dims WHERE height < 24 OR width < 24")
def too_small_images(spark: SparkSession, d: str) -> DataFrame:
    return tiling.too_small(dims(spark, d), 24).select("filename", "height", "width")


@query(f"{names._SPLIT} SELECT filename FROM s WHERE split = 'test'")
def held_out_requests(spark: SparkSession, d: str) -> DataFrame:
    good, _ = manifest.parse_names(proxies.raw_names(spark, d))
    return manifest.held_out(good.select("filename"), manifest.stratified_split(good, 42))


@query(f"WITH {proxies.R_SQL} SELECT model, tile_filename FROM r WHERE model NOT IN ('click', 'view')")
def unknown_models(spark: SparkSession, d: str) -> DataFrame:
    return scoring.unknown_models(proxies.run_log(spark, d), ["click", "view"]).select("model", "tile_filename")


@query(f"WITH {proxies.R_SQL}, k AS (SELECT *, source_filename || '/' || model AS stage FROM r) SELECT DISTINCT stage FROM k WHERE stage NOT IN (SELECT stage FROM k WHERE elapsed_seconds > 95)")
def empty_stages(spark: SparkSession, d: str) -> DataFrame:
    """Runs by source and model of which no row takes over 95 seconds: their tables of such rows are empty."""
    log = proxies.run_log(spark, d).withColumn("stage", F.concat_ws("/", "source_filename", "model"))
    return images.empty_tables(log, log.where(F.col("elapsed_seconds") > 95), "stage")


# Scorers that hold to the contract of boundary maps, or break it.


@dataclass(frozen=True)
class Red:
    """The red channel; a tile whose first level is odd fails."""

    magnification: float

    def predict(self, tile: np.ndarray) -> np.ndarray:
        if int(np.rint(tile[0, 0, 0] * 255)) % 2:
            raise ValueError("odd corner")
        return tile[..., 0].astype(np.float32)


@dataclass(frozen=True)
class Loud:
    magnification: float

    def predict(self, tile: np.ndarray) -> np.ndarray:
        return np.full(tile.shape[:2], 2, np.float32)


@dataclass(frozen=True)
class Narrow:
    magnification: float

    def predict(self, tile: np.ndarray) -> np.ndarray:
        return np.zeros((1, 1), np.float32)


@dataclass(frozen=True)
class Wide:
    magnification: float

    def predict(self, tile: np.ndarray) -> np.ndarray:
        return np.zeros(tile.shape[:2], np.float64)


def absent(magnification: float):
    raise RuntimeError("no weights")


TRIED = {"red": Red, "loud": Loud, "narrow": Narrow, "wide": Wide, "absent": absent}

_TRIED = f"""{names._GRID}, tried AS (SELECT t.filename AS source_filename, t.tile_filename, t.magnification, r % 2 = 1 AS odd, unnest(['red', 'loud', 'narrow', 'wide', 'absent']) AS model
FROM tiles t JOIN l ON (l.filename = t.filename AND l."row" = t.row0 AND l.col = t.col0)),
told AS (SELECT model, source_filename, tile_filename, magnification, CASE WHEN model = 'red' AND NOT odd THEN 'ok' ELSE 'failed' END AS status, model <> 'absent' AS loaded,
CASE model WHEN 'red' THEN CASE WHEN odd THEN 'ValueError: odd corner' ELSE '' END WHEN 'loud' THEN 'ValueError: values outside 0 to 1' WHEN 'narrow' THEN 'ValueError: shape (1, 1) is not (8, 8)'
WHEN 'wide' THEN 'ValueError: dtype float64 is not float32' ELSE 'RuntimeError: no weights' END AS detail FROM tried)"""


@query(f"{_TRIED} SELECT model, source_filename, tile_filename, magnification, status, loaded, detail FROM told")
def scorer_failures(spark: SparkSession, d: str) -> DataFrame:
    images.in_small_batches(spark)
    made = scoring.score(scoring.pairs(pixels._unit_tiles(spark, d), list(TRIED), TRIED), TRIED)
    return made.select("model", "source_filename", "tile_filename", "magnification", "status", "loaded", "detail")


@query(f"""{_TRIED}, k AS (SELECT tile_filename, row_number() OVER (PARTITION BY magnification ORDER BY md5((42 + magnification) || '|' || tile_filename), tile_filename) AS rank FROM tiles)
SELECT model, source_filename, tile_filename, magnification, CASE WHEN status = 'ok' THEN 'ok' WHEN loaded THEN 'predict_failed' ELSE 'load_failed' END AS status, regexp_replace(detail, '^\\w+: ', '') AS detail, status = 'ok' AS timed
FROM told JOIN k USING (tile_filename) WHERE rank <= 2""")
def timed_comparison(spark: SparkSession, d: str) -> DataFrame:
    made = scoring.compare(pixels._unit_tiles(spark, d), list(TRIED), 2, 42, TRIED)
    return made.select("model", "source_filename", "tile_filename", "magnification", "status", "detail", F.col("elapsed_seconds").isNotNull().alias("timed"))


@query(f"{_TRIED} SELECT model, count(*) AS total, count(*) FILTER (status = 'ok') AS already_done, count(*) FILTER (status <> 'ok') AS remaining FROM told WHERE model IN ('red', 'absent') GROUP BY model")
def resumed_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Some tiles are scored, then all; what a scorer fails on remains."""
    folder = images.scratch_folder(spark)
    pixels._unit_tiles(spark, d).write.parquet(f"{folder}/tiles")
    tiles = spark.read.parquet(f"{folder}/tiles")
    scoring.run_scoring(tiles.where("row0 % 8 = 0"), ["red", "absent"], f"{folder}/scored", TRIED)
    return scoring.run_scoring(tiles, ["red", "absent"], f"{folder}/scored", TRIED)


@query(f"{pixels._TILE} SELECT filename AS source_filename, row0, col0, least(min(r), min(g), min(b))::DOUBLE AS low, greatest(max(r), max(g), max(b))::DOUBLE AS high FROM tp WHERE row0 % 8 = 0 GROUP BY ALL")
def payload_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a tile log fetch their payloads from a table by magnification."""
    path = f"{images.scratch_folder(spark)}/tiles"
    images.write_table(pixels._cut(spark, d), path, partition_by=("magnification",))
    log = names._tiles(spark, d).where("row0 % 8 = 0")
    chosen = scoring.payloads_of(log, spark.read.parquet(path), ["magnification", "source_filename", "tile_filename"])

    def ends(row, image):
        yield {"low": float(image.min()), "high": float(image.max())}

    return images.map_images(chosen, ("source_filename", "row0", "col0"), ends, "low double, high double")


# Colour mode from payloads.


def _decided(spark: SparkSession, d: str) -> DataFrame:
    unit = proxies.rgb_payload(spark, d)
    return colour_mode.decisions(colour_mode.moments_of_images(unit, colour_mode.otsu_of_images(unit)))


@query(pixels.SQL["colour_decision"])
def colour_decision_of_images(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_decided(spark, d).drop("degenerate"), "threshold_v", "effect_size_h", "hue_diff_deg", "effect_size_s")


@query(f"SELECT * FROM ({pixels.SQL['colour_consensus']}) WHERE decision <> 'disagreement'")
def colour_decision_table(spark: SparkSession, d: str) -> DataFrame:
    return colour_mode.decision_table(_decided(spark, d))


# Stencils on pixel tables.


def _gray(spark: SparkSession, d: str) -> DataFrame:
    return proxies.gray_pixels(spark, d).withColumns({"height": F.lit(8), "width": F.lit(8)})


@query(f'{pixels._Q} SELECT id AS filename, r AS "row", c AS col, round(f, 6) AS v FROM fit')
def gaussian_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencils.gaussian(_gray(spark, d), ["filename"], scaled(1.5)).select("filename", "row", "col", "v"), "v")


@query(f"{pixels._Q} SELECT id AS filename, r AS \"row\", c AS col, round(y, 6) + 0 AS v FROM la WHERE reg = 'i'")
def laplacian_table(spark: SparkSession, d: str) -> DataFrame:
    # a sum of 0 has either sign
    return rounded(stencils.laplacian(_gray(spark, d), ["filename"]).select("filename", "row", "col", "v"), "v").withColumn("v", F.col("v") + F.lit(0.0))


# Kernels of the enhancement on the gray images, pixel by pixel.


def _mapped(spark: SparkSession, d: str, function, **columns) -> DataFrame:
    def one(row, image):
        yield images.payload_of(function(row, image))

    made = images.map_images(proxies.gray_payload(spark, d), ("filename",), one, images.PAYLOAD, **columns)
    return rounded(images.to_pixels(made, ("filename",), ("v",)), "v")


@query(f"""WITH {proxies.E_SQL}, w AS (SELECT *, 2.0::DOUBLE * magnification / 100 AS ball FROM e), s AS (SELECT y, x FROM (SELECT unnest(range(-4, 5)) AS y), (SELECT unnest(range(-4, 5)) AS x)),
u AS (SELECT a.filename, a."row", a.col, any_value(a.v) AS v, min(b.v + a.ball - sqrt(a.ball * a.ball - (y * y + x * x))) AS under
      FROM w a JOIN s ON (y * y + x * x <= a.ball * a.ball) JOIN w b ON (b.filename = a.filename AND b."row" = a."row" + y AND b.col = a.col + x) GROUP BY ALL),
o AS (SELECT filename, "row", col, v / (under + 1e-6::DOUBLE) * avg(under) OVER (PARTITION BY filename) AS o FROM u),
z AS (SELECT *, min(o) OVER (PARTITION BY filename) AS low, max(o) OVER (PARTITION BY filename) AS high FROM o)
SELECT filename, "row", col, round(CASE WHEN high > low THEN (o - low) / (high - low) ELSE 0 END, 6) AS v FROM z""")
def flat_field_gray(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, lambda row, image: kernels.flat_field(image, row.radius, 4.0), radius=scaled(2.0))


def _mirrored(place: str) -> str:
    return f"CASE WHEN {place} < 0 THEN -({place}) WHEN {place} > 7 THEN 14 - ({place}) ELSE {place} END"


_APART = f"v[8 * ({_mirrored('y + a')}) + ({_mirrored('x + b')}) + 1] - v[8 * ({_mirrored('y + dy + a')}) + ({_mirrored('x + dx + b')}) + 1]"


@query(f"""WITH {proxies.E_SQL}, i AS (SELECT filename, list(v ORDER BY "row", col) AS v FROM e GROUP BY filename),
p AS (SELECT y, x, dy, dx FROM (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)),
n AS (SELECT a, b FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)),
w AS (SELECT filename, y, x, dy, dx, exp(-(sum(pow({_APART}, 2)) / 9) / (0.3::DOUBLE * 0.3::DOUBLE)) AS w, any_value(v[8 * ({_mirrored('y + dy')}) + ({_mirrored('x + dx')}) + 1]) AS u FROM i, p, n GROUP BY ALL)
SELECT filename, y AS "row", x AS col, round(least(greatest(sum(w * u) / sum(w), 0), 1), 6) AS v FROM w GROUP BY ALL""")
def denoise_gray(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d, lambda row, image: kernels.denoise(image, 3, 2, 0.3))


@query(f"""WITH {proxies.E_SQL}, t AS (SELECT *, CASE WHEN magnification = 100 THEN 2 ELSE 1 END AS k, least(CAST(floor(v * 256) AS INT), 255) AS level FROM e),
c AS (SELECT filename, k, "row" * k // 8 AS i, col * k // 8 AS j, level, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT *, 64.0::DOUBLE / (k * k) AS size, greatest(0.02::DOUBLE * 64 / (k * k), 1) AS most FROM c),
x AS (SELECT filename, i, j, any_value(size) AS size, sum(greatest(n - most, 0)) AS extra, list(struct_pack(l := level, n := least(n, most))) AS bins FROM g GROUP BY ALL),
y AS (SELECT filename, "row", col, k, level, least(greatest(("row" + 0.5::DOUBLE) * k / 8 - 0.5::DOUBLE, 0), k - 1) AS y, least(greatest((col + 0.5::DOUBLE) * k / 8 - 0.5::DOUBLE, 0), k - 1) AS x FROM t),
q AS (SELECT *, CAST(floor(y) AS INT) AS y0, CAST(floor(x) AS INT) AS x0, unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b FROM y),
m AS (SELECT filename, "row", col, level, CASE WHEN a = 1 THEN y - y0 ELSE 1 - (y - y0) END * CASE WHEN b = 1 THEN x - x0 ELSE 1 - (x - x0) END AS share, least(y0 + a, k - 1) AS i, least(x0 + b, k - 1) AS j FROM q)
SELECT filename, "row", col, round(sum(share * (coalesce(list_sum([s.n for s in bins if s.l <= level]), 0) + extra * (level + 1) / 256) / size) + 3e-8::DOUBLE, 6) AS v FROM m JOIN x USING (filename, i, j) GROUP BY ALL""")
def clahe_gray(spark: SparkSession, d: str) -> DataFrame:
    # shares of 2**18 may lie halfway between two rounded values; 3e-8 more, they do not
    return _mapped(spark, d, lambda row, image: kernels.clahe(image, row.kernel, 0.02) + 3e-8, kernel=round_positive(scaled(4.0)))
