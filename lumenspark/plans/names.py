"""Queries over names, parameters, grids, runs: tables without pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions.params import boundary_limit, denoise_keeps_boundaries, round_odd, round_positive, scaled
from lumenspark.operators import manifest, scoring, stages, tiling
from lumenspark.sources import proxies
from lumenspark.sources.images import scratch_folder

SIZE, OVERLAP = 8, 0.5
MODELS = ["canny", "watershed"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, and the SQL that it must agree with."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return manifest.parse_names(proxies.raw_names(spark, d))[0]


_P = f"WITH {proxies.M_SQL}"


@query(f"{_P} SELECT filename, sample_id, position, magnification FROM p")
def parse_names(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d)


@query(f"{_P} SELECT filename FROM m WHERE filename NOT IN (SELECT filename FROM p)")
def rejected_names(spark: SparkSession, d: str) -> DataFrame:
    return manifest.parse_names(proxies.raw_names(spark, d))[1]


@query(f"{_P} SELECT filename, 200.0::DOUBLE * (magnification / 100.0::DOUBLE) AS illumination_sigma_px, 1.0::DOUBLE * (magnification / 100.0::DOUBLE) AS noise_sigma_px, 40.0::DOUBLE * (magnification / 100.0::DOUBLE) AS diameter_px FROM p")
def scale_params(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("filename", scaled(200.0).alias("illumination_sigma_px"), scaled(1.0).alias("noise_sigma_px"), scaled(40.0).alias("diameter_px"))


_PATCH = "CAST(greatest(round_even(3.0::DOUBLE * (magnification / 100.0::DOUBLE), 0), 1) AS INT)"


@query(f"{_P} SELECT filename, {_PATCH} + CASE WHEN {_PATCH} % 2 = 0 THEN 1 ELSE 0 END AS patch_px, CAST(greatest(round_even(6.0::DOUBLE * (magnification / 100.0::DOUBLE), 0), 1) AS INT) AS distance_px FROM p")
def round_odd_params(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("filename", round_odd(scaled(3.0)).alias("patch_px"), round_positive(scaled(6.0)).alias("distance_px"))


@query(f"{_P}, q AS (SELECT filename, {_PATCH} + CASE WHEN {_PATCH} % 2 = 0 THEN 1 ELSE 0 END AS patch_px, 2.0::DOUBLE * (magnification / 100.0::DOUBLE) AS limit_px FROM p) SELECT *, patch_px / 2 <= limit_px AS allowed FROM q")
def denoise_guard(spark: SparkSession, d: str) -> DataFrame:
    patch, limit = round_odd(scaled(3.0)), boundary_limit(2.0)
    return _parsed(spark, d).select("filename", patch.alias("patch_px"), limit.alias("limit_px"), denoise_keeps_boundaries(patch, limit).alias("allowed"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return manifest.stratified_split(_parsed(spark, d), 42)


_SPLIT = f"""{_P},
k AS (SELECT *, row_number() OVER (PARTITION BY magnification ORDER BY md5('42|' || filename), filename) AS rank, count(*) OVER (PARTITION BY magnification) AS n FROM p),
s AS (SELECT filename, sample_id, position, magnification,
        CASE WHEN rank <= least(greatest(1, CAST(round_even(n / 3.0, 0) AS BIGINT)), n - 1) THEN 'test' ELSE 'dev' END AS split,
        CASE WHEN n = 1 THEN 'only image at this magnification' ELSE '' END AS split_note FROM k)"""


@query(f"{_SPLIT} SELECT * FROM s")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


@query(f"{_SPLIT} SELECT magnification, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test FROM s GROUP BY magnification")
def split_counts_pivot(spark: SparkSession, d: str) -> DataFrame:
    return manifest.split_counts(_split(spark, d))


@query(f"{_SPLIT} SELECT filename, magnification FROM s WHERE split = 'dev'")
def holdout_filter(spark: SparkSession, d: str) -> DataFrame:
    return manifest.development(_split(spark, d)).select("filename", "magnification")


@query(f"{_SPLIT} SELECT filename, magnification, split FROM s")
def manifest_lookup(spark: SparkSession, d: str) -> DataFrame:
    return manifest.look_up(_parsed(spark, d).select("filename"), _split(spark, d), allow_test=True).select("filename", "magnification", "split")


@query(f"{_SPLIT} SELECT filename FROM m WHERE filename NOT IN (SELECT filename FROM s)")
def manifest_unknown(spark: SparkSession, d: str) -> DataFrame:
    return manifest.unknown(proxies.raw_names(spark, d), _split(spark, d))


@query(f"{_P} SELECT DISTINCT magnification FROM p")
def magnifications(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("magnification").distinct()


# Grids over the colour images.


def dims(spark: SparkSession, d: str) -> DataFrame:
    return proxies.rgb_pixels(spark, d).groupBy("filename", "magnification").agg((F.max("row") + 1).alias("height"), F.lit(proxies.WIDTH_L).alias("width"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return tiling.tile_grid(dims(spark, d), SIZE, OVERLAP)


_DIMS = f"WITH {proxies.l_sql()}, dims AS (SELECT filename, magnification, max(\"row\") + 1 AS height, 24 AS width FROM l GROUP BY ALL)"
_ORIGINS = "list_sort(list_distinct(list_append(range(0, {0} - 8 + 1, 4), ({0} - 8)::BIGINT)))"
_GRID = f"""{_DIMS}, ro AS (SELECT *, {_ORIGINS.format('height')} AS rs, {_ORIGINS.format('width')} AS cs FROM dims),
g1 AS (SELECT filename, magnification, height, width, cs, unnest(rs) AS row0, generate_subscripts(rs, 1) - 1 AS tile_row_idx FROM ro),
grid AS (SELECT filename, magnification, height, width, row0, tile_row_idx, unnest(cs) AS col0, generate_subscripts(cs, 1) - 1 AS tile_col_idx, 8 AS tile_size_px FROM g1),
tiles AS (SELECT *, printf('%s_r%05d_c%05d.npy', regexp_replace(filename, '\\.[^.]+$', ''), row0, col0) AS tile_filename FROM grid)"""


@query(f"{_GRID} SELECT filename, unnest(rs) AS origin FROM ro")
def tile_origins(spark: SparkSession, d: str) -> DataFrame:
    return dims(spark, d).select("filename", F.explode(tiling.origins(F.col("height"), SIZE, tiling.stride(SIZE, OVERLAP))).alias("origin"))


@query(f"{_GRID} SELECT filename, magnification, height, width, tile_row_idx, row0, tile_col_idx, col0, tile_size_px FROM grid")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


@query(f"""{_DIMS}, a AS (SELECT *, unnest(range(0, height, 16)) AS tile_top_px FROM dims), b AS (SELECT *, unnest(range(0, width, 16)) AS tile_left_px FROM a)
SELECT filename, tile_top_px // 16 AS tile_row, tile_left_px // 16 AS tile_col, tile_top_px, tile_left_px, least(16, height - tile_top_px) AS tile_height_px, least(16, width - tile_left_px) AS tile_width_px FROM b""")
def quality_grid(spark: SparkSession, d: str) -> DataFrame:
    return tiling.quality_grid(dims(spark, d), 16)


def _with_tile_names(grid: DataFrame) -> DataFrame:
    return grid.withColumn("tile_filename", tiling.tile_name(F.col("filename"), F.col("row0"), F.col("col0")))


def _named(spark: SparkSession, d: str) -> DataFrame:
    return _with_tile_names(_grid(spark, d))


@query(f"{_GRID} SELECT filename, tile_filename, 'canny/' || regexp_replace(filename, '\\.[^.]+$', '') || '/' || tile_filename AS prediction FROM tiles")
def tile_names(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("filename", "tile_filename", tiling.prediction_key(F.lit("canny"), F.col("filename"), F.col("tile_filename")).alias("prediction"))


@query(f"{_GRID} SELECT filename, row0, col0, row0 AS top, row0 + 8 AS bottom, col0 AS \"left\", col0 + 8 AS \"right\", row0 + 3 AS global_row, col0 + 5 AS global_col FROM grid")
def tile_boxes(spark: SparkSession, d: str) -> DataFrame:
    row, col = tiling.local_to_global(F.col("row0"), F.col("col0"), F.lit(3), F.lit(5))
    return _grid(spark, d).select("filename", "row0", "col0", *tiling.tile_box(F.col("row0"), F.col("col0"), F.col("tile_size_px")), row.alias("global_row"), col.alias("global_col"))


@query(f"""{_DIMS}, z AS (SELECT *, least(greatest(16, CAST(round_even(2.5::DOUBLE * (magnification / 100.0::DOUBLE) * 8, 0) AS INT)), height, width) AS side FROM dims)
SELECT filename, (height - side) // 2 AS row0, (height - side) // 2 + side AS row1, (width - side) // 2 AS col0, (width - side) // 2 + side AS col1 FROM z""")
def zoom_boxes(spark: SparkSession, d: str) -> DataFrame:
    return dims(spark, d).select("filename", *tiling.zoom_box(F.col("height"), F.col("width"), scaled(2.5), 8.0))


@query(f"{_DIMS} SELECT filename, round(64.0 / (pi() / 4 * pow(2.5::DOUBLE * (magnification / 100.0::DOUBLE), 2)), 6) AS features FROM dims")
def features_per_tile(spark: SparkSession, d: str) -> DataFrame:
    return dims(spark, d).select("filename", F.round(tiling.features_per_tile(8.0, scaled(2.5)), 6).alias("features"))


@query(f"{_GRID} SELECT filename, count(*) AS n_tiles, max(tile_row_idx) + 1 AS n_rows, max(tile_col_idx) + 1 AS n_cols FROM grid GROUP BY filename")
def tile_counts(spark: SparkSession, d: str) -> DataFrame:
    return tiling.tile_counts(_grid(spark, d))


@query(f"""{_GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY magnification ORDER BY md5((42 + magnification) || '|' || tile_filename), tile_filename) AS rank FROM tiles)
SELECT filename, tile_filename, magnification FROM k WHERE rank <= 2""")
def tile_sample(spark: SparkSession, d: str) -> DataFrame:
    return manifest.sample_tiles(_named(spark, d).select("filename", "tile_filename", "magnification"), 2, 42)


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select(F.col("filename").alias("source_filename"), "tile_filename", "magnification", "row0", "col0")


_PAIRS = f"{_GRID}, pairs AS (SELECT filename AS source_filename, tile_filename, magnification, row0, col0, unnest(['canny', 'watershed']) AS model FROM tiles), done AS (SELECT * FROM pairs WHERE model = 'canny' AND (row0 + col0) % 3 = 0)"


@query(f"{_PAIRS} SELECT model, source_filename, tile_filename FROM pairs")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    return scoring.pairs(_tiles(spark, d), MODELS).select("model", "source_filename", "tile_filename")


def _done(wanted: DataFrame) -> DataFrame:
    return wanted.where((F.col("model") == "canny") & ((F.col("row0") + F.col("col0")) % 3 == 0))


@query(f"{_PAIRS} SELECT model, source_filename, tile_filename FROM pairs EXCEPT ALL SELECT model, source_filename, tile_filename FROM done")
def pending_pairs(spark: SparkSession, d: str) -> DataFrame:
    wanted = scoring.pairs(_tiles(spark, d), MODELS)
    return scoring.pending(wanted, _done(wanted)).select("model", "source_filename", "tile_filename")


@query(f"{_PAIRS} SELECT p.model, count(*) AS total, count(q.model) AS already_done, count(*) - count(q.model) AS remaining FROM pairs p LEFT JOIN done q USING (model, source_filename, tile_filename) GROUP BY p.model")
def resume_counts(spark: SparkSession, d: str) -> DataFrame:
    wanted = scoring.pairs(_tiles(spark, d), MODELS)
    return scoring.done_and_left(wanted, _done(wanted))


@query(f"""{_GRID}, log AS (SELECT tile_filename, filename FROM tiles), kept AS (SELECT tile_filename AS key FROM tiles WHERE row0 % 8 = 0 UNION SELECT filename FROM tiles WHERE col0 = 4 AND magnification = 100)
SELECT 'tile_filename' AS "column", tile_filename AS key FROM log WHERE tile_filename NOT IN (SELECT key FROM kept)
UNION ALL SELECT 'filename', filename FROM log WHERE filename NOT IN (SELECT key FROM kept)""")
def stage_complete(spark: SparkSession, d: str) -> DataFrame:
    named = _named(spark, d)
    stored = named.where("row0 % 8 = 0").select(F.col("tile_filename").alias("key")).union(named.where("col0 = 4 and magnification = 100").select("filename"))
    return scoring.incomplete(named, ["tile_filename", "filename"], stored)


def _chain(spark: SparkSession, d: str, folder: str) -> list[stages.Stage]:
    """Images, their tiles and the tiles' scores as three stages, each made from the one before."""
    images = stages.Stage("images", f"{folder}/images", ("filename",), lambda s: dims(s, d), lambda keys: dims(spark, d).join(keys, "filename", "left_semi"))

    def tiles_of(s: SparkSession) -> DataFrame:
        return _with_tile_names(tiling.tile_grid(s.read.parquet(images.path), SIZE, OVERLAP))

    tiles = stages.Stage("tiles", f"{folder}/tiles", ("filename", "tile_filename"), tiles_of, lambda keys: tiles_of(spark).join(keys, ["filename", "tile_filename"], "left_semi"))
    scores = stages.Stage("scores", f"{folder}/scores", ("tile_filename",), lambda s: s.read.parquet(tiles.path), lambda keys: keys.withColumn("status", F.lit("ok")))
    return [images, tiles, scores]


@query(f"""{_GRID}, had AS (SELECT 1 AS position, count(DISTINCT filename) AS n_wanted, count(DISTINCT filename) FILTER (magnification <> 100) AS n_made FROM tiles
UNION ALL SELECT 2, count(*), count(*) FILTER (magnification <> 100 OR row0 <> 0) FROM tiles UNION ALL SELECT 3, count(DISTINCT tile_filename), 0 FROM tiles)
SELECT position, ['images', 'tiles', 'scores'][position] AS stage, CASE WHEN n_made > 0 THEN 'regenerated' ELSE 'found' END AS status, n_wanted, n_made FROM had""")
def stage_restart(spark: SparkSession, d: str) -> DataFrame:
    """A chain of which some images, some of their tiles and all scores are there."""
    chain = _chain(spark, d, scratch_folder(spark))
    dims(spark, d).where("magnification = 100").write.parquet(chain[0].path)
    chain[1].wanted(spark).where("row0 = 0").write.parquet(chain[1].path)
    _named(spark, d).select("tile_filename").write.parquet(chain[2].path)
    return stages.restart(spark, chain)


# The run log.

_R = f"WITH {proxies.R_SQL}"


@query(f"{_R} SELECT model, count(*) AS ran, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, round(sum(elapsed_seconds), 3) AS elapsed_seconds FROM r GROUP BY model")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return scoring.run_summary(proxies.run_log(spark, d)).withColumn("elapsed_seconds", F.round("elapsed_seconds", 3))


@query(f"{_R} SELECT model, source_filename, tile_filename, magnification, status, elapsed_seconds FROM r WHERE status = 'failed' ORDER BY model, source_filename, tile_filename LIMIT 10")
def top_failures(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_failures(proxies.run_log(spark, d)).select("model", "source_filename", "tile_filename", "magnification", "status", "elapsed_seconds")


@query(f"{_R} SELECT magnification, " + ", ".join(f"round(avg(elapsed_seconds) FILTER (status = 'ok' AND model = '{m}'), 6) AS {m}" for m in EVENT_TYPES) + " FROM r GROUP BY magnification")
def timing_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = scoring.timing_pivot(proxies.run_log(spark, d), EVENT_TYPES)
    return wide.select("magnification", *[F.round(m, 6).alias(m) for m in EVENT_TYPES])
