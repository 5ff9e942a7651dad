"""Sources and sinks: image files, payload tables, pixel tables, and the logs of the jobs.

A payload row is one image: key columns, ``height, width, channels`` INT, ``dtype`` STRING and
``pixels`` BINARY (row by row, channel last, little-endian).  Payload and metadata are separate
tables, so that a scan of metadata never reads pixels.  A pixel table has a row for each pixel and is
for small images and checks; jobs keep to payloads.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings of raw images.
EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")

PAYLOAD = "height int, width int, channels int, dtype string, pixels binary"

MANIFEST = "filename string, sample_id string, magnification int, height int, width int, split string, split_note string"
CROP_LOG = "filename string, magnification int, colour_mode string, original_height int, original_width int, crop_top_px int, crop_bottom_px int, crop_left_px int, crop_right_px int, crop_capped boolean, output_height int, output_width int, output_path string"
ENHANCE_LOG = "filename string, magnification int, flat_field_radius_px double, flat_field_working_radius_px double, denoise_patch_size_px int, denoise_patch_distance_px int, denoise_boundary_limit_px double, denoise_sigma_est double, denoise_h double, clahe_kernel_size_px int, clahe_clip_limit double, flat_field_output_path string, denoised_output_path string, clahe_output_path string"
TILE_LOG = "tile_filename string, source_filename string, magnification int, tile_row_idx int, tile_col_idx int, row0 int, col0 int, tile_size_px int, source_height_px int, source_width_px int, tile_path string"
QUALITY = "focus_variance_of_laplacian double, noise_mad_sigma double, contrast_spread double, entropy double, filename string, magnification int, scope string, tile_row int, tile_col int, tile_top_px int, tile_left_px int, tile_height_px int, tile_width_px int, illumination_level double, illumination_range_frac double, illumination_flag boolean"
TIMING = "tile_filename string, source_filename string, magnification int, model string, elapsed_seconds double, status string, detail string"
INFERENCE_LOG = "timestamp timestamp, model string, tile_filename string, source_filename string, magnification int, status string, elapsed_seconds double, detail string"


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The table, or an error if it is empty; for small metadata tables."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def empty_tables(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Of the wanted names, those of which a log has no row: the stages that require_rows refuses."""
    return wanted.select(key).distinct().join(rows.select(key), key, "left_anti")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, path, length) of the image files of a folder, subfolders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    return files.select(name.alias("filename"), "path", "length").where(ending.isin(*EXTENSIONS) & name.contains("."))


#: Bytes of a frame of output, and of a row of it without its pixels, about.
FRAME_BYTES, ROW_BYTES = 8 << 20, 500


#: Bytes of a batch that a Python worker gets at once, unless the session says less; the text operators, which may be absent, have the same.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """Let the session cut the batches for Python workers by bytes: a chain of them holds one batch each."""
    if int(str(spark.conf.get(_BATCH)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def array_of(row) -> np.ndarray:
    """The image of a payload row."""
    shape = (row.height, row.width) if row.channels == 1 else (row.height, row.width, row.channels)
    return np.frombuffer(row.pixels, row.dtype).reshape(shape)


def payload_of(image: np.ndarray) -> dict:
    """The payload columns of an image."""
    return {"height": image.shape[0], "width": image.shape[1], "channels": 1 if image.ndim == 2 else image.shape[2], "dtype": image.dtype.name, "pixels": np.ascontiguousarray(image).tobytes()}


def map_images(images: DataFrame, keys: tuple[str, ...], function: Callable, schema: str, **columns: F.Column) -> DataFrame:
    """Apply function(row, image) -> rows (dicts without the keys) to each payload row; rows leave in frames of about FRAME_BYTES.

    columns: parameters of each image, computed by Spark and seen as attributes of row.
    """
    names = [f.split()[0] for f in schema.split(",")]
    key_types = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, size = [], 0
            for row in batch.itertuples(index=False):
                own = {k: getattr(row, k) for k in keys}
                for r in function(row, array_of(row)):
                    made.append(own | r)
                    size += len(r.get("pixels", b"")) + ROW_BYTES
                    if size >= FRAME_BYTES:
                        yield pd.DataFrame(made, columns=[*keys, *names])
                        made, size = [], 0
            if made:
                yield pd.DataFrame(made, columns=[*keys, *names])

    chosen = images.select(*keys, "height", "width", "channels", "dtype", "pixels", *[c.alias(n) for n, c in columns.items()])
    return chosen.mapInPandas(run, f"{key_types}, {schema}")


def to_payload(pixels: DataFrame, keys: list[str], channels: list[str], dtype: str = "float64", dealt: tuple[str, ...] = ()) -> DataFrame:
    """A pixel table (keys, row, col, channels...) as payloads; images are expected to be small here.

    dealt: columns equal in all rows of an image, by which the rows are dealt already: they need no other shuffle.
    """
    cell = F.struct("row", "col", F.array(*[F.col(c).cast("double") for c in channels]).alias("v"))
    grouped = pixels.groupBy(*keys, *dealt).agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"), F.flatten(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"])).alias("values"))
    return arrays_to_payload(grouped, keys, len(channels), dtype)


def arrays_to_payload(rows: DataFrame, keys: list[str], channels: int, dtype: str = "float64") -> DataFrame:
    """(keys, height, width, values array) as payloads of a NumPy dtype."""
    key_types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*keys, "height", "width"]].copy()
            out["channels"], out["dtype"] = np.int32(channels), dtype
            out["pixels"] = [np.asarray(v).astype(dtype).tobytes() for v in batch["values"]]
            yield out

    return rows.select(*keys, "height", "width", "values").mapInPandas(run, f"{key_types}, {PAYLOAD}")


def to_pixels(images: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """Payloads as a pixel table (keys, row, col, names...)."""
    kinds = ", ".join(f"{n} double" for n in names)
    key_types = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)

    def frame(rows: list) -> pd.DataFrame:
        size = np.array([r.height * r.width for r in rows])
        columns = {k: np.repeat(np.array([getattr(r, k) for r in rows], object if isinstance(getattr(rows[0], k), str) else None), size) for k in keys}
        columns["row"] = np.concatenate([np.repeat(np.arange(r.height), r.width) for r in rows])
        columns["col"] = np.concatenate([np.tile(np.arange(r.width), r.height) for r in rows])
        values = np.concatenate([array_of(r).reshape(r.height * r.width, r.channels).astype(float) for r in rows])
        return pd.DataFrame(columns | {n: values[:, i] for i, n in enumerate(names)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some, size = [], 0
            for row in batch.itertuples(index=False):
                some.append(row)
                size += row.height * row.width * (16 + 8 * len(names))
                if size >= FRAME_BYTES:
                    yield frame(some)
                    some, size = [], 0
            if some:
                yield frame(some)

    chosen = images.select(*keys, "height", "width", "channels", "dtype", "pixels")
    return chosen.mapInPandas(run, f"{key_types}, row int, col int, {kinds}")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """A stage's metadata or payload table as Parquet; payloads are partitioned by magnification or model."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> None:
    """A table by buckets of its keys, sorted in them, a file for each: tables with equal keys and buckets join without a shuffle."""
    df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


def append_log(df: DataFrame, path: str) -> None:
    """One append for a job or micro-batch."""
    write_table(df, path, mode="append")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; in local mode a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
