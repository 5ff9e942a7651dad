"""Colour and level functions on pixel columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights.
RED, GREEN, BLUE = 0.299, 0.587, 0.114


def luminance(r: Column, g: Column, b: Column) -> Column:
    return RED * r + GREEN * g + BLUE * b


def gray_level(r: Column, g: Column, b: Column) -> Column:
    """Luminance of integer levels, rounded half-even to a level."""
    return F.rint(luminance(r, g, b)).cast("int")


def unit(level: Column, bits: int = 8) -> Column:
    """An integer level as a number from 0 to 1."""
    return level.cast("double") / F.lit(float((1 << bits) - 1))


def to_level(value: Column, bits: int = 8) -> Column:
    """A number as an integer level: clipped to 0 to 1, scaled, rounded half-even."""
    return F.rint(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * F.lit(float((1 << bits) - 1))).cast("int")


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees from 0 to below 360 of unit channels; 0 without colour."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    raw = F.when(high == r, (g - b) / span).when(high == g, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span) * 60.0
    return F.when(high == low, 0.0).when(raw < 0, raw + 360.0).otherwise(raw)


def saturation(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(high == 0, 0.0).otherwise((high - low) / F.when(high == 0, F.lit(1.0)).otherwise(high))


def value(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b)


def require_colour(channels: Column, result: Column) -> Column:
    """The result for three-channel images, an error for others."""
    return F.when(channels == 3, result).otherwise(F.raise_error(F.concat(F.lit("3 channels needed, not "), channels.cast("string"))).cast("double"))
