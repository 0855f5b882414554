"""Row predicates (FLT1-FLT14) as Columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldframe.functions import constants as C


def active_above(status: Column, energy_ev: Column, minimum_ev: float = 0.0) -> Column:
    """Active particles at or above an energy (FLT1); NaN energies never pass."""
    if not math.isfinite(minimum_ev) or minimum_ev < 0.0:
        raise ValueError("the minimum energy must be finite and non-negative")
    return (status == C.STATUS_ACTIVE) & (energy_ev >= float(minimum_ev)) & ~F.isnan(energy_ev)


def in_region(bounds: dict[str, tuple[float, float]]) -> Column:
    """Axis-aligned box, both ends included (FLT3)."""
    condition = F.lit(True)
    for name, (lo, hi) in bounds.items():
        if not (math.isfinite(lo) and math.isfinite(hi)) or hi <= lo:
            raise ValueError("region bounds must be finite and ascending")
        condition = condition & F.col(name).between(lo, hi)
    return condition


#: Threshold comparisons by name (FLT4). Spark sorts NaN above all numbers, so the upward
#: tests exclude it.
COMPARISONS: dict[str, Callable[[Column, float], Column]] = {
    "greater": lambda v, t: (v > t) & ~F.isnan(v),
    "greater_equal": lambda v, t: (v >= t) & ~F.isnan(v),
    "less": lambda v, t: v < t,
    "less_equal": lambda v, t: v <= t,
    "abs_greater": lambda v, t: (F.abs(v) > t) & ~F.isnan(v),
    "abs_less": lambda v, t: F.abs(v) < t,
}

#: Lifecycle subsets by name (FLT6).
LIFECYCLE = {
    "escaped": (C.STATUS_ESCAPED,),
    "inactive": (C.STATUS_INACTIVE,),
    "recyclable": (C.STATUS_ESCAPED, C.STATUS_INACTIVE),
}


def compare(value: Column, threshold: float, mode: str) -> Column:
    return COMPARISONS[mode](value, threshold)


def lifecycle(status: Column, selection: str) -> Column:
    return status.isin(*LIFECYCLE[selection])


def fov_pixels(crval: float, cdelt: float, crpix: float, n: int,
               lo: float, hi: float) -> tuple[int, int]:
    """Half-open pixel range of a world interval on a linear axis, clipped to the map (FLT7)."""
    first = int((lo - crval) / cdelt + crpix - 1)
    last = int((hi - crval) / cdelt + crpix - 1)
    return max(0, first), min(n, last)


def in_fov(ix: Column, iy: Column, x_range: tuple[int, int], y_range: tuple[int, int]) -> Column:
    return ((ix >= x_range[0]) & (ix < x_range[1]) & (iy >= y_range[0]) & (iy < y_range[1]))


def in_circle(ix: Column, iy: Column, center_x: float, center_y: float, radius: float) -> Column:
    """Circular aperture, rim included (FLT8)."""
    if not math.isfinite(radius) or radius <= 0.0:
        raise ValueError("the radius must be positive and finite")
    dx, dy = ix - float(center_x), iy - float(center_y)
    return dx * dx + dy * dy <= radius * radius


def on_cadence(frame: Column, start: int, end: int, every: int, zero_means_final: bool = False) -> Column:
    """Every k-th frame after the start, or the last one (FLT14).

    ``every=0`` means never for snapshots and the last frame only for histograms
    (``zero_means_final``).
    """
    final = frame == end
    if every <= 0:
        return final if zero_means_final else F.lit(False)
    return ((frame - start) % every == 0) | final
