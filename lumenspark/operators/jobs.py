"""Whole stages from a folder or a table to stored payloads and a log in the order of names.

A stage writes its payloads once, and its log from what it wrote, without pixels.  Logs name each payload
by its key, a path of name parts, as a path column would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions.params import Border, Enhance, Tiling
from lumenspark.operators import manifest, quality, scoring, tiling
from lumenspark.sources import images
from lumenspark.sources.decoding import read_images
from lumenspark.sources.ordered import write_ordered


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _log(df: DataFrame, schema: str, path: str, *keys: str) -> DataFrame:
    """A log with the columns of its schema, written in order and read again."""
    fields = [F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")]
    write_ordered(df.select(*fields), path, *keys)
    return df.sparkSession.read.schema(schema).parquet(path)


def _key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def manifest_of_folder(spark: SparkSession, folder: str, path: str, seed: int = 42) -> DataFrame:
    """List, decode, parse, split: the manifest of a folder of image files, written as CSV in the order of names.

    An empty folder is an error, and so is a file that can't be decoded or whose name doesn't fit.
    """
    files = images.require_rows(read_images(spark, folder, pixels=False), f"{folder}: the list of image files")
    told = F.concat(F.lit("not decoded: "), "filename", F.lit(": "), "error")
    whole = files.withColumn("filename", F.when(F.col("error").isNull(), F.col("filename")).otherwise(F.raise_error(told).cast("string")))
    made = manifest.build_manifest(whole.select("filename", "height", "width"), seed)
    write_ordered(made.select(*_names(images.MANIFEST)), path, "filename", form="csv")
    return images.read_csv(spark, path, images.MANIFEST).fillna("", ["split_note"])


def _stored(made: DataFrame, path: str) -> DataFrame:
    images.write_table(made, path, partition_by=("magnification",))
    return made.sparkSession.read.parquet(path)


def normalise_job(raw: DataFrame, colour_mode: str, payloads: str, log: str, config: Border = Border()) -> DataFrame:
    """Cropped, unit-scaled images and the crop log; raw has filename, magnification and a payload."""
    raw = images.require_rows(raw, "the images to normalise")
    made = _stored(quality.normalise(raw, colour_mode, config), payloads)
    full = made.withColumns({"colour_mode": F.lit(colour_mode), "output_height": F.col("height"), "output_width": F.col("width"), "output_path": _key(F.concat(tiling.stem(F.col("filename")), F.lit(".npy")))})
    return _log(full, images.CROP_LOG, log, "filename")


def enhance_job(normalised: DataFrame, payloads: str, log: str, config: Enhance = Enhance()) -> DataFrame:
    """The three stages of each image, and the enhance log, a row for each image."""
    normalised = images.require_rows(normalised, "the images to enhance")
    made = _stored(scoring.enhance(normalised, config), payloads)
    resolved = [n for n in _names(images.ENHANCE_LOG) if n not in ("filename", "magnification") and not n.endswith("_path")]
    where = {f"{s}_output_path": F.max(F.when(F.col("stage") == s, _key(tiling.stem(F.col("filename")), F.concat(F.lit(s), F.lit(".npy"))))) for s in ("flat_field", "denoised", "clahe")}
    rows = made.groupBy("filename", "magnification").agg(*[F.first(n).alias(n) for n in resolved], *[c.alias(n) for n, c in where.items()])
    return _log(rows, images.ENHANCE_LOG, log, "filename")


def tile_job(enhanced: DataFrame, payloads: str, log: str, config: Tiling = Tiling()) -> DataFrame:
    """Overlapping tiles of each image and the tile log."""
    enhanced = images.require_rows(enhanced, "the images to tile")
    made = _stored(tiling.cut_tiles(enhanced, config.tile_size_px, config.overlap), payloads)
    sized = enhanced.select(F.col("filename").alias("source_filename"), F.col("height").alias("source_height_px"), F.col("width").alias("source_width_px"))
    rows = made.select("tile_filename", "source_filename", "magnification", "tile_row_idx", "tile_col_idx", "row0", "col0", F.lit(config.tile_size_px).alias("tile_size_px")).join(sized, "source_filename")
    return _log(rows.withColumn("tile_path", _key(tiling.stem(F.col("source_filename")), F.col("tile_filename"))), images.TILE_LOG, log, "source_filename", "row0", "col0")
