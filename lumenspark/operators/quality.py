"""Border crop, normalisation, quality metrics at image and tile scope, and the before/after gate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.functions import kernels
from lumenspark.functions.params import Border, Gate, Quality, scaled
from lumenspark.sources.images import PAYLOAD, map_images, payload_of

METRICS = "focus_variance_of_laplacian double, noise_mad_sigma double, contrast_spread double, entropy double"
SCOPE = "scope string, tile_row int, tile_col int, tile_top_px int, tile_left_px int, tile_height_px int, tile_width_px int"
ILLUMINATION = "illumination_level double, illumination_range_frac double, illumination_flag boolean"


def tile_starts(n: int, size: int) -> range:
    return range(0, n, size)


def quality(images: DataFrame, config: Quality = Quality(), keys: tuple[str, ...] = ("filename", "magnification")) -> DataFrame:
    """Metrics of each image, and of its non-overlapping tiles, the last ones of which may be smaller.

    Focus, noise, contrast and entropy see a region alone, with its own edges; illumination is fitted
    to the whole image, and a tile's range is measured against the whole image's.
    """

    def one(row, image):
        gray = kernels.luminance(image)
        fit = kernels.gaussian(gray, row.illumination_sigma)
        span = float(gray.max() - gray.min())

        def metrics(scope, i, j, top, left, h, w):
            part, under = gray[top : top + h, left : left + w], fit[top : top + h, left : left + w]
            share = kernels.range_fraction(under, span)
            return {
                "focus_variance_of_laplacian": kernels.focus(part), "noise_mad_sigma": kernels.noise_sigma(part, row.noise_sigma),
                "contrast_spread": kernels.contrast(part, config.low_percentile, config.high_percentile), "entropy": kernels.entropy(part),
                "scope": scope, "tile_row": i, "tile_col": j, "tile_top_px": top, "tile_left_px": left, "tile_height_px": h, "tile_width_px": w,
                "illumination_level": float(under.mean()), "illumination_range_frac": share, "illumination_flag": bool(share > config.illumination_flag_threshold),
            }

        height, width = gray.shape
        yield metrics("image", -1, -1, 0, 0, height, width)
        for i, top in enumerate(tile_starts(height, config.tile_size_px)):
            for j, left in enumerate(tile_starts(width, config.tile_size_px)):
                yield metrics("tile", i, j, top, left, min(config.tile_size_px, height - top), min(config.tile_size_px, width - left))

    return map_images(images, keys, one, f"{METRICS}, {SCOPE}, {ILLUMINATION}", illumination_sigma=scaled(config.illumination_sigma_px), noise_sigma=scaled(config.noise_sigma_px))


def gate_metrics(images: DataFrame, config: Quality = Quality(), keys: tuple[str, ...] = ("filename", "magnification")) -> DataFrame:
    """Of the image-scope metrics of quality, the three that the gate looks at, without work for the others."""

    def one(row, image):
        gray = kernels.luminance(image)
        share = kernels.range_fraction(kernels.gaussian(gray, row.illumination_sigma), float(gray.max() - gray.min()))
        yield {"illumination_range_frac": share, "noise_mad_sigma": kernels.noise_sigma(gray, row.noise_sigma), "focus_variance_of_laplacian": kernels.focus(gray)}

    return map_images(images, keys, one, ", ".join(f"{name} double" for name in GATED), illumination_sigma=scaled(config.illumination_sigma_px), noise_sigma=scaled(config.noise_sigma_px))


def image_scope(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("scope") == "image")


def tile_scope(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("scope") == "tile")


def heatmap(metrics: DataFrame, metric: str, columns: list[int]) -> DataFrame:
    """A row for each row of tiles, a column for each column of tiles, of one metric."""
    return tile_scope(metrics).groupBy("filename", "tile_row").pivot("tile_col", columns).agg(F.first(metric))


def normalise(images: DataFrame, colour_mode: str, config: Border = Border(), keys: tuple[str, ...] = ("filename", "magnification")) -> DataFrame:
    """Images of integer levels -> cropped float32 images from 0 to 1, with what was cropped.

    colour_mode is colour or grayscale; images of one channel pass as they are, and alpha is left out.
    """
    if colour_mode not in ("colour", "grayscale"):
        raise ValueError(f"colour mode must be colour or grayscale, not {colour_mode!r}")

    def one(row, image):
        top_level = float(np.iinfo(image.dtype).max)
        if image.ndim == 3 and image.shape[2] in (2, 4):
            image = image[..., 0] if image.shape[2] == 2 else image[..., :3]
        # half levels are told apart from what rounding makes of them, as in SQL
        gray = image if image.ndim == 2 else np.rint(np.round(kernels.luminance(image), 9))
        top, bottom, left, right, capped = kernels.border_crop(gray, config.variance_ratio, config.max_fraction)
        source = gray if colour_mode == "grayscale" else image
        cut = source[top : source.shape[0] - bottom, left : source.shape[1] - right]
        out = (cut / top_level).astype(np.float32)
        yield {"crop_top_px": top, "crop_bottom_px": bottom, "crop_left_px": left, "crop_right_px": right, "crop_capped": capped, "original_height": image.shape[0], "original_width": image.shape[1], **payload_of(out)}

    return map_images(images, keys, one, f"crop_top_px int, crop_bottom_px int, crop_left_px int, crop_right_px int, crop_capped boolean, original_height int, original_width int, {PAYLOAD}")


# Gate: relative changes, with a defined result where the value before is 0.


def illumination_decrease(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.when(after <= 0, 0.0).otherwise(float("-inf"))).otherwise(F.try_divide(before - after, before))


def noise_increase(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.when(after <= 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(after - before, before))


def focus_decrease(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.when(after >= 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(before - after, before))


GATED = ("illumination_range_frac", "noise_mad_sigma", "focus_variance_of_laplacian")


def gate_missing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names that have metrics after but none before."""
    return after.select("filename").join(before, "filename", "left_anti")


def gate_join(before: DataFrame, after: DataFrame) -> DataFrame:
    """Image-scope metrics before and after, by name; a name without metrics before is an error, one without any after is left out."""
    b = before.select("filename", *[F.col(c).alias(f"{c}_before") for c in GATED], F.lit(True).alias("_there"))
    a = after.select("filename", "magnification", *[F.col(c).alias(f"{c}_after") for c in GATED])
    there = F.when(F.col("_there"), F.col("filename")).otherwise(F.raise_error(F.concat(F.lit("no metrics before: "), "filename")).cast("string"))
    return a.join(b, "filename", "left").withColumn("filename", there).drop("_there")


def verdicts(joined: DataFrame, config: Gate = Gate()) -> DataFrame:
    """Relative changes, the three checks, and whether all pass."""
    c = F.col
    made = joined.select(
        "*",
        illumination_decrease(c("illumination_range_frac_before"), c("illumination_range_frac_after")).alias("illumination_relative_decrease"),
        noise_increase(c("noise_mad_sigma_before"), c("noise_mad_sigma_after")).alias("noise_relative_increase"),
        focus_decrease(c("focus_variance_of_laplacian_before"), c("focus_variance_of_laplacian_after")).alias("focus_relative_decrease"),
    )
    checked = made.select("*", (c("illumination_relative_decrease") >= config.illumination_min_decrease).alias("illumination_pass"), (c("noise_relative_increase") <= config.noise_max_increase).alias("noise_pass"), (c("focus_relative_decrease") <= config.focus_max_decrease).alias("focus_pass"))
    return checked.withColumn("gate_pass", c("illumination_pass") & c("noise_pass") & c("focus_pass"))


def gate_summary(verdict: DataFrame, *by: str) -> DataFrame:
    return verdict.groupBy(*by).agg(F.count_if("gate_pass").alias("passed"), F.count("*").alias("total"))
