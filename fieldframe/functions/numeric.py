"""Small numeric Columns shared by all operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def finite(value: Column) -> Column:
    """True for finite doubles; NaN sorts above infinity in Spark, so one test is enough."""
    return value.isNotNull() & (F.abs(value) < F.lit(math.inf))


def finite_positive(value: Column) -> Column:
    """True for finite values above zero (FLT10)."""
    return finite(value) & (value > 0.0)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator/denominator, NaN where the denominator is zero or not finite (PRJ20)."""
    usable = finite(denominator) & (denominator != 0.0)
    return F.when(usable, numerator / denominator).otherwise(F.lit(NAN))


def fractional_difference(base: Column, other: Column) -> Column:
    """(other-base)/base, NaN where either side is unusable (PRJ21)."""
    usable = finite(base) & (base != 0.0) & finite(other)
    return F.when(usable, (other - base) / base).otherwise(F.lit(NAN))


def clamp(value: Column, limit: float) -> Column:
    """Clamp to [-limit, limit] (PRJ29)."""
    return F.greatest(F.least(value, F.lit(float(limit))), F.lit(-float(limit)))


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]."""
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def quantize(value: Column, levels: int) -> Column:
    """Map [0, 1] onto 0..levels-1, clipping first and rounding half to even (PRJ17)."""
    return F.rint(clip(value, 0.0, 1.0) * float(levels - 1)).cast("int")


def rescale(value: Column, low: Column, high: Column, floor: float, peak: float) -> Column:
    """Map [low, high] linearly onto [floor, peak]; a tiny range counts as 1e-12 (PRJ16)."""
    width = F.greatest(high - low, F.lit(1.0e-12))
    return F.lit(float(floor)) + (value - low) / width * float(peak - floor)


def nan_fill(value: Column, fill: float = 0.0) -> Column:
    """Replace NaN (not NULL) by a value (PRJ39)."""
    return F.nanvl(value, F.lit(float(fill)))


def metadata_matches(actual: Column, expected: Column, tolerance: float = 1.0e-12) -> Column:
    """Equal within a relative tolerance on a scale of at least one (DQ6)."""
    scale = F.greatest(F.lit(1.0), F.abs(actual), F.abs(expected))
    return finite(actual) & finite(expected) & (F.abs(actual - expected) <= tolerance * scale)
