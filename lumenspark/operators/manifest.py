"""Manifest: names, splits, look-ups and the hold-out guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: <sample>-<letter>-<magnification>X.<ending>.
NAME = r"^([A-Za-z0-9]+)-([A-Za-z])-([0-9]+)[xX]\.([A-Za-z]+)$"


def parse_names(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filename, ...) -> rows with sample_id, position and magnification, and the rows whose name does not fit."""
    fits = F.col("filename").rlike(NAME)
    part = lambda i: F.regexp_extract("filename", NAME, i)
    good = files.where(fits).select("*", part(1).alias("sample_id"), part(2).alias("position"), part(3).cast("int").alias("magnification"))
    return good, files.where(~F.coalesce(fits, F.lit(False)))


def parse_names_strictly(files: DataFrame) -> DataFrame:
    """As parse_names, but a name that does not fit is an error."""
    part = lambda i: F.when(F.col("filename").rlike(NAME), F.regexp_extract("filename", NAME, i)).otherwise(F.raise_error(F.concat(F.lit("no image name: "), "filename")))
    return files.select("*", part(1).alias("sample_id"), part(2).alias("position"), part(3).cast("int").alias("magnification"))


def seeded(seed: int | Column, name: str = "filename") -> Column:
    """A fixed random order of names."""
    return F.md5(F.concat(F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), F.lit("|"), F.col(name)))


def _ranked(rows: DataFrame, by: list[str], seed: int | Column, name: str) -> DataFrame:
    """Rows with their rank in the seeded order and their group's size.

    A group is ranked in buckets of the order's leading digits, whose sizes are added up, so no task
    sorts a whole group.
    """
    keyed = rows.withColumn("_order", seeded(seed, name)).withColumn("_bucket", F.substring("_order", 1, 2))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(*by)).alias("_n"))
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_order", name))
    return keyed.withColumn("_within", within).join(offsets, [*by, "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_within"))


def stratified_split(images: DataFrame, seed: int = 42) -> DataFrame:
    """Split by magnification: a third of each, one at least and not all, is test; a single image is dev, with a note."""
    ranked = _ranked(images, ["magnification"], seed, "filename")
    tests = F.least(F.greatest(F.lit(1), F.rint(F.col("_n") / 3).cast("long")), F.col("_n") - 1)
    split = F.when(F.col("_rank") <= tests, "test").otherwise("dev")
    note = F.when(F.col("_n") == 1, "only image at this magnification").otherwise("")
    return ranked.select(*images.columns, split.alias("split"), note.alias("split_note"))


def split_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("magnification").pivot("split", ["dev", "test"]).count().fillna(0, ["dev", "test"])


def development(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("split") == "dev")


def look_up(requested: DataFrame, manifest: DataFrame, allow_test: bool = False) -> DataFrame:
    """Requested file names with their manifest rows.

    An unknown name is an error, and so is a test image unless allow_test is given; the split is
    looked up, never taken from the caller.
    """
    split = F.col("split")
    checked = F.when(split.isNull(), F.raise_error(F.concat(F.lit("not in the manifest: "), "filename")).cast("string"))
    if not allow_test:
        checked = checked.when(split == "test", F.raise_error(F.concat(F.lit("a test image: "), "filename")).cast("string"))
    return requested.join(manifest, "filename", "left").withColumn("split", checked.otherwise(split))


def held_out(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    """Requested names that look_up refuses without allow_test: those of test images."""
    return requested.join(manifest.where(F.col("split") == "test").select("filename"), "filename", "left_semi")


def unknown(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    return requested.join(manifest, "filename", "left_anti")


def sample_tiles(tiles: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n tiles of each magnification in a seeded order, or all if there are fewer."""
    ranked = _ranked(tiles, ["magnification"], F.lit(seed) + F.col("magnification"), "tile_filename")
    return ranked.where(F.col("_rank") <= n).select(*tiles.columns)


def build_manifest(files: DataFrame, seed: int = 42) -> DataFrame:
    """The manifest of decoded files (filename, height, width, ...)."""
    split = stratified_split(parse_names_strictly(files), seed)
    return split.select("filename", "sample_id", "magnification", "height", "width", "split", "split_note")
