"""Images too large for one task: strips of rows, kernels on strips with margins, reassembly by strip.

A strip carries, besides its own rows, as many rows above and below as a kernel reaches, where the image
has them.  The kernel sees each of its rows as in the whole image, and the margins are cut again.  At
the image's own edges a strip has no margin, so the kernel's rule for edges applies there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.operators.tiling import keep_of_tiles
from lumenspark.sources.images import PAYLOAD, map_images, payload_of

STRIP = "strip int, strip_row0 int, image_height int, above int, below int"
_COLUMNS = [f.split()[0] for f in STRIP.split(", ")]


def cut_strips(images: DataFrame, keys: tuple[str, ...], rows: int, reach: Column | int = 0) -> DataFrame:
    """Payload images as strips of rows, with margins of reach rows; a strip has more rows than a kernel reaches."""

    def one(row, image):
        own = max(rows, int(row.reach) + 1)
        for i, top in enumerate(range(0, row.height, own)):
            bottom = min(top + own, row.height)
            above, below = min(int(row.reach), top), min(int(row.reach), row.height - bottom)
            yield {"strip": i, "strip_row0": top, "image_height": row.height, "above": above, "below": below, **payload_of(image[top - above : bottom + below])}

    return map_images(images, keys, one, f"{STRIP}, {PAYLOAD}", reach=reach if isinstance(reach, Column) else F.lit(reach))


def map_strips(strips: DataFrame, keys: tuple[str, ...], function: Callable, **columns: Column) -> DataFrame:
    """Apply function(row, strip) -> array of the same rows to each strip, and cut the margins."""

    def one(row, image):
        made = function(row, image)
        yield {"above": 0, "below": 0, **payload_of(np.ascontiguousarray(made[row.above : made.shape[0] - row.below]))}

    carried = (*keys, "strip", "strip_row0", "image_height")
    # the strip's margins are seen by the function, and are gone after it
    return map_images(strips, carried, one, f"above int, below int, {PAYLOAD}", above=F.col("above"), below=F.col("below"), **columns).select(*keys, *_COLUMNS, *[f.split()[0] for f in PAYLOAD.split(", ")])


def join_strips(strips: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Payload images from strips without margins, for images that a task can hold."""
    kinds = ", ".join(f"{k} {strips.schema[k].dataType.simpleString()}" for k in keys)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("strip_row0")
        first = rows.iloc[0]
        parts = b"".join(rows["pixels"])
        made = {"height": int(rows["height"].sum()), "width": int(first["width"]), "channels": int(first["channels"]), "dtype": first["dtype"], "pixels": parts}
        return pd.DataFrame([{k: first[k] for k in keys} | made])

    return strips.groupBy(*keys).applyInPandas(join, f"{kinds}, {PAYLOAD}")


def reassemble_in_strips(tiles: DataFrame, rows: int, overlap: float = 0.5, height: str = "source_height_px", width: str = "source_width_px") -> DataFrame:
    """Strips of the sources from payloads of their tiles (source_filename, row0, col0, source size).

    As tiling.reassemble, but the tiles of a source meet by strip: each part of a tile goes to the strip
    that it lies in, so a source is put together by as many tasks as it has strips.
    """
    keep_h, keep_w = keep_of_tiles(overlap, height, width)

    def trim(row, image):
        own = image[: row.keep_h, : row.keep_w]
        for strip in range(row.row0 // rows, (row.row0 + own.shape[0] - 1) // rows + 1):
            top, bottom = max(row.row0, strip * rows), min(row.row0 + own.shape[0], (strip + 1) * rows)
            yield {"strip": strip, "top": top, **payload_of(np.ascontiguousarray(own[top - row.row0 : bottom - row.row0]))}

    parts = map_images(tiles, ("source_filename", "row0", "col0", height, width), trim, f"strip int, top int, {PAYLOAD}", keep_h=keep_h, keep_w=keep_w)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        begin = int(first["strip"]) * rows
        size = (min(rows, int(first[height]) - begin), int(first[width]))
        out = np.zeros(size if first["channels"] == 1 else (*size, int(first["channels"])), first["dtype"])
        for r in pdf.itertuples():
            part = np.frombuffer(r.pixels, r.dtype).reshape((r.height, r.width) if r.channels == 1 else (r.height, r.width, r.channels))
            out[r.top - begin : r.top - begin + r.height, r.col0 : r.col0 + r.width] = part
        return pd.DataFrame([{"source_filename": first["source_filename"], "strip": int(first["strip"]), "strip_row0": begin, "image_height": int(first[height]), "above": 0, "below": 0, **payload_of(out)}])

    return parts.groupBy("source_filename", "strip").applyInPandas(join, f"source_filename string, {STRIP}, {PAYLOAD}")
