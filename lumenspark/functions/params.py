"""Parameters of the image jobs as columns, and their rounding rules.

Lengths are declared at the reference magnification 100 and scaled by ``magnification / 100``; tile
sizes, kernel sizes of the focus measure, percentiles and thresholds never scale.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE_MAGNIFICATION = 100


# The defaults of the reference configuration.
@dataclass(frozen=True)
class Quality:
    tile_size_px: int = 512
    laplacian_ksize: int = 3
    noise_sigma_px: float = 1.0
    illumination_sigma_px: float = 200.0
    low_percentile: float = 0.05
    high_percentile: float = 0.95
    illumination_flag_threshold: float = 0.1


@dataclass(frozen=True)
class Gate:
    illumination_min_decrease: float = 0.5
    noise_max_increase: float = 0.0
    focus_max_decrease: float = 0.0


@dataclass(frozen=True)
class Enhance:
    flat_field_radius_px: float = 200.0
    flat_field_working_radius_px: float = 20.0
    denoise_patch_size_px: int = 3
    denoise_patch_distance_px: int = 6
    denoise_strength: float = 0.8
    boundary_width_px: float = 2.0
    clahe_kernel_px: int = 200
    clahe_clip_limit: float = 0.01


@dataclass(frozen=True)
class Border:
    variance_ratio: float = 0.05
    max_fraction: float = 0.15


@dataclass(frozen=True)
class Tiling:
    tile_size_px: int = 512
    overlap: float = 0.5
    feature_diameter_px: float = 40.0


@dataclass(frozen=True)
class Config:
    quality: Quality = field(default_factory=Quality)
    gate: Gate = field(default_factory=Gate)
    enhance: Enhance = field(default_factory=Enhance)
    border: Border = field(default_factory=Border)
    tiling: Tiling = field(default_factory=Tiling)
    effect_size_threshold: float = 0.2
    split_seed: int = 42

    def fingerprint(self) -> str:
        """The first twelve hex digits of the SHA-256 of the parameters, to stamp on a run's outputs."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


def file_fingerprint(content: Column) -> Column:
    """The same for the bytes of a configuration file, as read by the binaryFile source."""
    return F.substring(F.sha2(content, 256), 1, 12)


def scaled(value: float | Column, magnification: Column | str = "magnification", reference: int = REFERENCE_MAGNIFICATION) -> Column:
    """A length at the reference magnification, at another one; magnifications must be positive."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    m = F.col(magnification) if isinstance(magnification, str) else magnification
    if reference <= 0:
        raise ValueError("the reference magnification must be positive")
    checked = F.when(m > 0, m).otherwise(F.raise_error(F.concat(F.lit("magnification must be positive: "), m.cast("string"))).cast("int"))
    return value * (checked / F.lit(float(reference)))


def round_positive(value: Column, minimum: int = 1) -> Column:
    """Half-even rounding to an integer, not below a minimum."""
    return F.greatest(F.rint(value).cast("int"), F.lit(minimum))


def round_odd(value: Column, minimum: int = 1) -> Column:
    """As round_positive, and one more if that is even."""
    n = round_positive(value, minimum)
    return n + F.when(n % 2 == 0, 1).otherwise(0)


def boundary_limit(boundary_width_px: float, magnification: Column | str = "magnification") -> Column:
    """The widest half patch of a denoiser that leaves boundaries of that width alone."""
    return scaled(boundary_width_px, magnification)


def denoise_keeps_boundaries(patch: Column, limit: Column) -> Column:
    return patch / 2 <= limit


def assert_denoise_keeps_boundaries(patch: Column, limit: Column) -> Column:
    """The limit, or an error where a patch would smooth boundaries away."""
    return F.when(denoise_keeps_boundaries(patch, limit), limit).otherwise(F.raise_error(F.concat(F.lit("patch of "), patch.cast("string"), F.lit(" px exceeds the boundary limit "), limit.cast("string"))).cast("double"))
