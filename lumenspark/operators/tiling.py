"""Tiles: grids, cutting, names, reassembly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.sources.images import PAYLOAD, map_images, payload_of


def stride(size: int, overlap: float) -> int:
    if not 0 <= overlap < 1:
        raise ValueError("the overlap must be from 0 to below 1")
    return max(1, int(np.rint(size * (1 - overlap))))


def origins(dim: Column, size: int, step: int) -> Column:
    """Starts of full tiles along one side: every step, and one flush with the edge; an error if the side is too short."""
    last = F.when(dim >= size, dim - size).otherwise(F.raise_error(F.concat(F.lit(f"smaller than a tile of {size} px: "), dim.cast("string"))).cast("int"))
    return F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(step)), last))


def too_small(images: DataFrame, size: int) -> DataFrame:
    """Images that hold no full tile, which origins refuses; a null side counts as too small."""
    return images.where(~F.coalesce((F.col("height") >= size) & (F.col("width") >= size), F.lit(False)))


def tile_grid(images: DataFrame, size: int, overlap: float) -> DataFrame:
    """(filename, magnification, height, width) -> a row for each overlapping tile."""
    step = stride(size, overlap)
    rows = images.select("filename", "magnification", "height", "width", F.posexplode(origins(F.col("height"), size, step)).alias("tile_row_idx", "row0"))
    return rows.select("*", F.posexplode(origins(F.col("width"), size, step)).alias("tile_col_idx", "col0")).withColumn("tile_size_px", F.lit(size))


def quality_grid(images: DataFrame, size: int) -> DataFrame:
    """The non-overlapping grid; the last row and column of tiles may be smaller."""
    rows = images.select("filename", "height", "width", F.posexplode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(size))).alias("tile_row", "tile_top_px"))
    tiles = rows.select("*", F.posexplode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(size))).alias("tile_col", "tile_left_px"))
    return tiles.select("filename", "tile_row", "tile_col", "tile_top_px", "tile_left_px", F.least(F.lit(size), F.col("height") - F.col("tile_top_px")).alias("tile_height_px"), F.least(F.lit(size), F.col("width") - F.col("tile_left_px")).alias("tile_width_px"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def tile_name(source: Column, row0: Column, col0: Column) -> Column:
    return F.format_string("%s_r%05d_c%05d.npy", stem(source), row0, col0)


def prediction_key(model: Column, source: Column, tile: Column) -> Column:
    return F.concat_ws("/", model, stem(source), tile)


def tile_box(row0: Column, col0: Column, size: Column) -> list[Column]:
    return [row0.alias("top"), (row0 + size).alias("bottom"), col0.alias("left"), (col0 + size).alias("right")]


def local_to_global(row0: Column, col0: Column, row: Column, col: Column) -> tuple[Column, Column]:
    return row0 + row, col0 + col


def features_per_tile(size: float | Column, diameter: Column) -> Column:
    """How many round features of a diameter a tile holds by area."""
    size = F.lit(float(size)) if not isinstance(size, Column) else size
    return size * size / (F.lit(np.pi / 4) * diameter * diameter)


def zoom_box(height: Column, width: Column, diameter: Column, diameters: float = 8.0) -> list[Column]:
    """A centred square of so many feature diameters, 16 px at least, within the image."""
    side = F.least(F.greatest(F.lit(16), F.rint(diameter * diameters).cast("int")), height, width)
    top, left = F.floor((height - side) / 2).cast("int"), F.floor((width - side) / 2).cast("int")
    return [top.alias("row0"), (top + side).alias("row1"), left.alias("col0"), (left + side).alias("col1")]


def crop_pixels(pixels: DataFrame, top: Column, bottom: Column, left: Column, right: Column) -> DataFrame:
    inside = (F.col("row") >= top) & (F.col("row") < bottom) & (F.col("col") >= left) & (F.col("col") < right)
    return pixels.where(inside).withColumns({"row": F.col("row") - top, "col": F.col("col") - left})


def cut_tiles(images: DataFrame, size: int, overlap: float) -> DataFrame:
    """Payloads of all tiles of payload images; a task holds one image and gives its tiles one by one."""
    step = stride(size, overlap)

    def starts(n: int) -> list[int]:
        if n < size:
            raise ValueError(f"{n} px is smaller than a tile of {size} px")
        return sorted({*range(0, n - size + 1, step), n - size})

    def one(row, image):
        for i, top in enumerate(starts(row.height)):
            for j, left in enumerate(starts(row.width)):
                yield {"tile_row_idx": i, "tile_col_idx": j, "row0": top, "col0": left, **payload_of(image[top : top + size, left : left + size])}

    cut = map_images(images, ("filename", "magnification"), one, f"tile_row_idx int, tile_col_idx int, row0 int, col0 int, {PAYLOAD}")
    return cut.withColumnRenamed("filename", "source_filename").withColumn("tile_filename", tile_name(F.col("source_filename"), F.col("row0"), F.col("col0")))


def pixels_in_tiles(pixels: DataFrame, dims: DataFrame, size: int, overlap: float) -> DataFrame:
    """A pixel table dealt to the overlapping tiles that hold each pixel.

    The candidates of a pixel follow from its place by arithmetic: no range join.
    """
    step = stride(size, overlap)

    def holding(at: str, dim: str) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / step).cast("int")) * step
        last = F.least(F.floor(F.col(at) / step).cast("int") * step, F.floor((F.col(dim) - size) / step).cast("int") * step)
        regular = F.when(first <= last, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
        flush = F.when(F.col(at) >= F.col(dim) - size, F.array(F.col(dim) - size)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.concat(regular, flush))

    placed = pixels.join(dims, "filename")
    rows = placed.withColumn("row0", F.explode(holding("row", "height")))
    both = rows.withColumn("col0", F.explode(holding("col", "width")))
    return both.withColumns({"local_row": F.col("row") - F.col("row0"), "local_col": F.col("col") - F.col("col0")}).drop("height", "width")


def tile_counts(grid: DataFrame) -> DataFrame:
    return grid.groupBy("filename").agg(F.count("*").alias("n_tiles"), (F.max("tile_row_idx") + 1).alias("n_rows"), (F.max("tile_col_idx") + 1).alias("n_cols"))


def reassemble_pixels(tile_pixels: DataFrame, *values: str) -> DataFrame:
    """Pixels of the source from overlapping tile pixels: each is taken from the first tile that holds it."""
    at = F.struct("row0", "col0")
    return tile_pixels.groupBy("filename", (F.col("row0") + F.col("local_row")).alias("row"), (F.col("col0") + F.col("local_col")).alias("col")).agg(*[F.min_by(v, at).alias(v) for v in values], F.count("*").alias("n_tiles"))


def keep_of_tiles(overlap: float, height: str, width: str) -> tuple[Column, Column]:
    """How many rows and columns of a tile come before the next tile."""
    step = lambda own: F.greatest(F.rint(F.col(own) * (1 - overlap)).cast("int"), F.lit(1))
    keep = lambda at, dim, own: F.when(F.col(at) + F.col(own) >= F.col(dim), F.col(own)).otherwise(F.least(step(own), F.col(dim) - F.col(own) - F.col(at)))
    return keep("row0", height, "height"), keep("col0", width, "width")


def reassemble(tiles: DataFrame, overlap: float = 0.5, height: str = "source_height_px", width: str = "source_width_px") -> DataFrame:
    """Payloads of the sources from payloads of their tiles (source_filename, row0, col0, source size).

    Before tiles of one source meet, each gives up the rows and columns that the next tile also has, so
    that every pixel moves once.  Where the next tile begins follows from a tile's size and the overlap.
    """
    keep_h, keep_w = keep_of_tiles(overlap, height, width)

    def trim(row, image):
        yield payload_of(np.ascontiguousarray(image[: row.keep_h, : row.keep_w]))

    keys = ("source_filename", "row0", "col0", height, width)
    trimmed = map_images(tiles, keys, trim, PAYLOAD, keep_h=keep_h, keep_w=keep_w)

    def join(pdf):
        import pandas as pd

        first = pdf.iloc[0]
        shape = (first[height], first[width]) if first["channels"] == 1 else (first[height], first[width], first["channels"])
        out = np.zeros(shape, first["dtype"])
        for r in pdf.itertuples():
            part = np.frombuffer(r.pixels, r.dtype).reshape((r.height, r.width) if r.channels == 1 else (r.height, r.width, r.channels))
            out[r.row0 : r.row0 + r.height, r.col0 : r.col0 + r.width] = part
        return pd.DataFrame([{"source_filename": first["source_filename"], **payload_of(out)}])

    return trimmed.groupBy("source_filename").applyInPandas(join, f"source_filename string, {PAYLOAD}")
