"""Enhancement, boundary scorers, resumable scoring, and the tables around it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspark.functions import kernels
from lumenspark.functions.params import Enhance, assert_denoise_keeps_boundaries, boundary_limit, round_odd, round_positive, scaled
from lumenspark.sources.images import PAYLOAD, array_of, map_images, payload_of

TILE_KEYS = ["model", "source_filename", "tile_filename"]


def enhance(images: DataFrame, config: Enhance = Enhance(), keys: tuple[str, ...] = ("filename", "magnification")) -> DataFrame:
    """Flat field, then denoising, then local equalisation: a row for each image and stage, with the resolved parameters."""
    patch, limit = round_odd(scaled(config.denoise_patch_size_px)), boundary_limit(config.boundary_width_px)

    def one(row, image):
        flat = kernels.flat_field(image, row.radius, config.flat_field_working_radius_px)
        sigma = kernels.noise_sigma(kernels.luminance(flat), row.noise_sigma)
        h = config.denoise_strength * sigma
        calm = kernels.denoise(flat, row.patch, row.distance, h)
        even = kernels.clahe(calm, row.kernel, config.clahe_clip_limit)
        resolved = {"flat_field_radius_px": row.radius, "flat_field_working_radius_px": config.flat_field_working_radius_px, "denoise_patch_size_px": row.patch, "denoise_patch_distance_px": row.distance, "denoise_boundary_limit_px": row.limit, "denoise_sigma_est": sigma, "denoise_h": h, "clahe_kernel_size_px": row.kernel, "clahe_clip_limit": config.clahe_clip_limit}
        for stage, made in (("flat_field", flat), ("denoised", calm), ("clahe", even)):
            yield {"stage": stage, **resolved, **payload_of(made.astype(np.float32))}

    schema = "stage string, flat_field_radius_px double, flat_field_working_radius_px double, denoise_patch_size_px int, denoise_patch_distance_px int, denoise_boundary_limit_px double, denoise_sigma_est double, denoise_h double, clahe_kernel_size_px int, clahe_clip_limit double, " + PAYLOAD
    return map_images(images, keys, one, schema, radius=scaled(config.flat_field_radius_px), patch=patch, distance=round_positive(scaled(config.denoise_patch_distance_px)), limit=assert_denoise_keeps_boundaries(patch, limit), noise_sigma=scaled(1.0), kernel=round_positive(scaled(config.clahe_kernel_px)))


# Scorers: a factory for each name, called once for each magnification in a task.  A scorer whose predict_many takes a
# stack of tiles of one shape gets them together.


@dataclass(frozen=True)
class WatershedScorer:
    """Boundaries of watershed regions; smoothing, depth and least area grow with the magnification."""

    magnification: float
    sigma_px: float = 1.0
    depth: float = 0.02
    diameter_px: float = 40.0
    least_share: float = 0.1

    def predict(self, tile: np.ndarray) -> np.ndarray:
        return self.predict_many(tile[None])[0]

    def predict_many(self, tiles: np.ndarray) -> np.ndarray:
        k = self.magnification / 100
        least = int(np.rint(self.least_share * np.pi / 4 * (self.diameter_px * k) ** 2))
        return kernels.score_watershed_many(tiles, self.sigma_px * k, self.depth * k, least)


@dataclass(frozen=True)
class CannyScorer:
    """Soft edges between percentiles of the luminance."""

    magnification: float
    sigma_px: float = 1.0
    low: float = 60.0
    high: float = 90.0

    def predict(self, tile: np.ndarray) -> np.ndarray:
        return self.predict_many(tile[None])[0]

    def predict_many(self, tiles: np.ndarray) -> np.ndarray:
        return kernels.score_canny_many(tiles, self.sigma_px * self.magnification / 100, self.low, self.high)


SCORERS: dict[str, Callable] = {"canny": CannyScorer, "watershed": WatershedScorer}


def check_map(tile: np.ndarray, found: np.ndarray) -> None:
    """A boundary map has the tile's size, is float32 and lies in 0 to 1."""
    if not isinstance(found, np.ndarray) or found.shape != tile.shape[:2]:
        raise ValueError(f"shape {getattr(found, 'shape', None)} is not {tile.shape[:2]}")
    if found.dtype != np.float32:
        raise ValueError(f"dtype {found.dtype} is not float32")
    if not (np.isfinite(found).all() and found.min() >= 0 and found.max() <= 1):
        raise ValueError("values outside 0 to 1")


def check_models(models: list[str], known: dict[str, Callable]) -> None:
    """An unknown model is an error."""
    for m in models:
        if m not in known:
            raise ValueError(f"unknown model {m!r}; known are {sorted(known)}")


def pairs(tiles: DataFrame, models: list[str], known: dict[str, Callable] | None = None) -> DataFrame:
    """Every tile with every model, in the models' order; an unknown model is an error."""
    check_models(models, known or SCORERS)
    return tiles.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def unknown_models(log: DataFrame, known: list[str]) -> DataFrame:
    """Rows of a log whose model is none of the known ones; a null model is none."""
    return log.where(~F.coalesce(F.col("model").isin(*known), F.lit(False)))


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that have no prediction yet; what exists is left alone."""
    return wanted.join(done.select(*TILE_KEYS).distinct(), TILE_KEYS, "left_anti")


RESULT = f"model string, source_filename string, tile_filename string, magnification int, status string, loaded boolean, elapsed_seconds double, detail string, {PAYLOAD}"
SCORED = [f.split()[0] for f in RESULT.split(", ")]


#: Pixels of a stack of tiles.
STACK_PIXELS = 1 << 18


def _built(built: dict, scorers: dict[str, Callable], model: str, magnification: int):
    """The scorer of a task, or the error that building it gave."""
    key = (model, magnification)
    if key not in built:
        try:
            built[key] = scorers[model](magnification)
        except Exception as e:  # noqa: BLE001
            built[key] = e
    return built[key]


def score_row(built: dict, scorers: dict[str, Callable], model: str, row) -> dict:
    """One tile by one model; built keeps the scorers of a task, or the errors that building them gave."""
    begun = time.perf_counter()
    scorer = _built(built, scorers, model, row.magnification)
    made = {"height": None, "width": None, "channels": None, "dtype": None, "pixels": None}
    loaded = not isinstance(scorer, Exception)
    try:
        if not loaded:
            raise scorer
        tile = array_of(row)
        found = scorer.predict(tile)
        check_map(tile, found)
        made, status, detail = payload_of(found), "ok", ""
    except Exception as e:  # noqa: BLE001
        status, detail = "failed", f"{type(e).__name__}: {e}"
    return {"model": model, "source_filename": row.source_filename, "tile_filename": row.tile_filename, "magnification": row.magnification, "status": status, "loaded": loaded, "elapsed_seconds": time.perf_counter() - begun, "detail": detail, **made}


def _score_stack(scorer, model: str, rows: list) -> list[dict] | None:
    """Tiles of one shape by one scorer, each with its share of the seconds; None if any of them fails."""
    begun = time.perf_counter()
    try:
        first = array_of(rows[0])
        stack = np.frombuffer(b"".join(r.pixels for r in rows), first.dtype).reshape(len(rows), *first.shape)
        found = scorer.predict_many(stack)
        if len(found) != len(rows):
            return None
        check_map(stack.reshape(-1, *first.shape[1:]), found.reshape(-1, *found.shape[2:]))
        if found.shape[1:] != first.shape[:2]:
            return None
        made = [payload_of(f) for f in found]
    except Exception:  # noqa: BLE001
        return None
    seconds = (time.perf_counter() - begun) / len(rows)
    return [{"model": model, "source_filename": r.source_filename, "tile_filename": r.tile_filename, "magnification": r.magnification, "status": "ok", "loaded": True, "elapsed_seconds": seconds, "detail": "", **m} for r, m in zip(rows, made, strict=True)]


def score_rows(built: dict, scorers: dict[str, Callable], rows: list, models: list[str]) -> pd.DataFrame:
    """Each tile by the model of its place: tiles of one kind together where the scorer takes stacks, and alone where one of them fails."""
    made: list = [None] * len(rows)
    kinds: dict[tuple, list[int]] = {}
    for i, (row, model) in enumerate(zip(rows, models, strict=True)):
        if hasattr(_built(built, scorers, model, row.magnification), "predict_many"):
            kinds.setdefault((model, row.magnification, row.height, row.width, row.channels, row.dtype), []).append(i)
    for (model, magnification, height, width, *_), at in kinds.items():
        size = max(1, int(STACK_PIXELS // max(1, (height or 1) * (width or 1))))
        for some in (at[i : i + size] for i in range(0, len(at), size)):
            for i, one in zip(some, _score_stack(built[model, magnification], model, [rows[i] for i in some]) or (), strict=False):
                made[i] = one
    return pd.DataFrame([m or score_row(built, scorers, model, row) for m, row, model in zip(made, rows, models, strict=True)], columns=SCORED)


def score(tiles: DataFrame, scorers: dict[str, Callable] | None = None) -> DataFrame:
    """Payloads of tiles with a model -> predictions with status, seconds and detail.

    A scorer is built once for each (model, magnification) of a task; if that fails, the error is
    kept and told for each of its tiles.  A tile that fails is told alone.  Nothing is fatal.  Of tiles
    scored together each is told its share of the seconds.
    """
    scorers = scorers or SCORERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict = {}
        for batch in batches:
            rows = list(batch.itertuples(index=False))
            yield score_rows(built, scorers, rows, [row.model for row in rows])

    columns = tiles.select(*TILE_KEYS, "magnification", "height", "width", "channels", "dtype", "pixels")
    return columns.mapInPandas(run, RESULT)


def timing(scored: DataFrame) -> DataFrame:
    """The timing table of a comparison: no seconds where a run failed, and which part failed."""
    status = F.when(F.col("status") == "ok", "ok").when(F.col("loaded"), "predict_failed").otherwise("load_failed")
    return scored.select("tile_filename", "source_filename", "magnification", "model", F.when(F.col("status") == "ok", F.col("elapsed_seconds")).alias("elapsed_seconds"), status.alias("status"), F.regexp_replace("detail", r"^\w+: ", "").alias("detail"))


def timing_pivot(timings: DataFrame, models: list[str]) -> DataFrame:
    return timings.where(F.col("status") == "ok").groupBy("magnification").pivot("model", models).agg(F.avg("elapsed_seconds"))


def compare(tiles: DataFrame, models: list[str], n: int = 2, seed: int = 42, scorers: dict[str, Callable] | None = None) -> DataFrame:
    """Timings of all models on a seeded sample of tiles: sampling reads no pixels, the sample's keys go to the payload."""
    from lumenspark.operators.manifest import sample_tiles

    chosen = sample_tiles(tiles.select("source_filename", "tile_filename", "magnification"), n, seed).select("source_filename", "tile_filename")
    return timing(score(pairs(tiles.join(chosen, ["source_filename", "tile_filename"]), models, scorers), scorers))


def run_summary(log: DataFrame, by: str = "model") -> DataFrame:
    return log.groupBy(by).agg(F.count("*").alias("ran"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("elapsed_seconds").alias("elapsed_seconds"))


def done_and_left(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """For each model: all pairs, those already done, those left."""
    marked = wanted.join(done.select(*TILE_KEYS).distinct().withColumn("_done", F.lit(1)), TILE_KEYS, "left")
    return marked.groupBy("model").agg(F.count("*").alias("total"), F.count("_done").alias("already_done"), F.count_if(F.col("_done").isNull()).alias("remaining"))


def top_failures(log: DataFrame, n: int = 10) -> DataFrame:
    """The first n failures by key."""
    return log.where(F.col("status") == "failed").orderBy("model", "source_filename", "tile_filename").limit(n)


def failures(log: DataFrame, n: int = 10) -> tuple[DataFrame, int]:
    """The first n failures by key, and how many more there are."""
    return top_failures(log, n), max(0, log.where(F.col("status") == "failed").count() - n)


def run_scoring(tiles: DataFrame, models: list[str], folder: str, scorers: dict[str, Callable] | None = None, run: str | None = None) -> DataFrame:
    """Score what is pending, model by model, and give the summary.

    Keys are compared without pixels; then pending keys go to the payload.  Each model's results are one batch
    of the folder, predictions and log rows together, so that none is there without the other; a run of
    the same name replaces what it left unfinished.
    """
    from lumenspark.sources.commits import write_batch
    from lumenspark.sources.images import require_rows

    keys = require_rows(tiles.select("source_filename", "tile_filename", "magnification"), "the tile log")
    wanted = pairs(keys, models, scorers)
    run = run or f"{time.time_ns():020d}"
    for n, model in enumerate(models):
        left = pending(wanted.where(F.col("model") == model), predictions(tiles.sparkSession, folder)).select("model", "source_filename", "tile_filename")
        made = score(tiles.join(left, ["source_filename", "tile_filename"]), scorers)
        write_batch(made.withColumn("timestamp", F.current_timestamp()), folder, f"{run}-{n:03d}")
    return done_and_left(wanted, predictions(tiles.sparkSession, folder))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    from lumenspark.sources.commits import read_committed

    return read_committed(spark, folder, f"{RESULT}, timestamp timestamp")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The boundary maps of a scoring folder, by model and tile."""
    return _results(spark, folder).where(F.col("status") == "ok").select(*TILE_KEYS, "magnification", "height", "width", "channels", "dtype", "pixels")


def scoring_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log of a scoring folder: each run of each model on each tile; it reads no pixels."""
    from lumenspark.sources.images import INFERENCE_LOG

    return _results(spark, folder).select(*[f.split()[0] for f in INFERENCE_LOG.split(", ")])


def payloads_of(log: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The stored payloads of a log's rows, which are chosen without pixels; a row without a payload is left out."""
    return stored.join(log.select(*keys).distinct(), keys, "left_semi")


def incomplete(log: DataFrame, columns: list[str], stored: DataFrame) -> DataFrame:
    """Keys in any of the columns of a stage's log that are not stored; a stage is complete if there are none and the log has rows."""
    keys = log.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in columns])).alias("x")).select("x.*")
    return keys.join(stored.select("key").distinct(), "key", "left_anti")


def flatten_masks(masks: DataFrame, covered: DataFrame) -> DataFrame:
    """Masks (tile, mask_id, area) and covered pixels (tile, mask_id, row, col) -> the label of each covered pixel.

    Larger masks are painted first, so the smallest that covers a pixel wins; of equal areas the later.
    """
    rank = F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("area"), F.asc("mask_id")))
    return covered.join(masks.withColumn("rank", rank), ["tile", "mask_id"]).groupBy("tile", "row", "col").agg(F.max("rank").alias("label"))


def thick_boundaries(labels: DataFrame, keys: list[str], label: Column | str = "label") -> DataFrame:
    """Pixels (keys, row, col, label) with whether their cross-shaped neighbourhood has several labels."""
    lab = F.col(label) if isinstance(label, str) else label
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    sent = labels.select(*keys, "row", "col", lab.alias("x"), F.explode(shifts).alias("s")).select(*keys, (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), "x", (F.col("s.a") == 0).__and__(F.col("s.b") == 0).alias("own"))
    return sent.groupBy(*keys, "row", "col").agg((F.max("x") != F.min("x")).alias("boundary"), F.max("own").alias("own")).where("own").drop("own")
