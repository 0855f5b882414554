"""Vectors and orthogonal coordinate systems (PRJ25-PRJ27, PRJ44, PRJ47)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldframe.functions.numeric import finite

# Fixed value: radius or sin(theta) at or below this counts as singular.
SINGULARITY_TOLERANCE = 1.0e-14


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda s, t: s + t, [u * v for u, v in zip(a, b)])


def magnitude(v: list[Column]) -> Column:
    return F.sqrt(dot(v, v))


def direction(v: list[Column], floor: float = 0.0) -> list[Column]:
    """Unit vector; the zero vector where the length is at or below the floor (PRJ25)."""
    size = magnitude(v)
    return [F.when(size <= floor, 0.0).otherwise(c / size) for c in v]


def lame(system: str, q: list[Column]) -> list[Column]:
    """Scale factors h1, h2, h3 of (x,y,z), (r,phi,z) or (r,theta,phi) (PRJ26)."""
    one = F.lit(1.0)
    if system == "cartesian":
        return [one, one, one]
    if system == "polar":
        return [one, q[0], one]
    if system == "spherical":
        third = q[0] * F.sin(q[1]) if len(q) > 1 else one
        return [one, q[0], third]
    raise ValueError(f"unknown coordinate system: {system}")


def jacobian(system: str, q: list[Column], dims: int | None = None) -> Column:
    """Product of the scale factors of the active dimensions (PRJ26)."""
    return reduce(lambda a, b: a * b, lame(system, q)[: dims or len(q)])


def physical_distance(system: str, component: int, spacing: Column, q: list[Column]) -> Column:
    return lame(system, q)[component] * spacing


def is_singular(system: str, q: list[Column]) -> Column:
    """On the axis or the origin of a curvilinear system (PRJ26, DQ8)."""
    if system == "cartesian":
        return F.lit(False)
    origin = q[0] <= SINGULARITY_TOLERANCE
    if system == "spherical" and len(q) > 1:
        return origin | (F.abs(F.sin(q[1])) <= SINGULARITY_TOLERANCE)
    return origin


def cell_volume(system: str, centers: list[Column], widths: list[Column]) -> Column:
    """Midpoint cell volume, 0 where not finite and positive (PRJ27)."""
    size = reduce(lambda a, b: a * b, [F.abs(w) for w in widths],
                  F.abs(jacobian(system, centers)))
    return F.when(finite(size) & (size > 0.0), size).otherwise(0.0)


def to_cartesian_point(system: str, q: list[Column]) -> list[Column]:
    """Cartesian point of curvilinear coordinates, missing dimensions 0 (PRJ44)."""
    zero = F.lit(0.0)
    q1 = q[1] if len(q) > 1 else zero
    q2 = q[2] if len(q) > 2 else zero
    if system == "cartesian":
        return [q[0], q1, q2]
    if system == "polar":
        return [q[0] * F.cos(q1), q[0] * F.sin(q1), q2]
    if len(q) == 1:
        return [q[0], zero, zero]
    across = q[0] * F.sin(q1)
    return [across * F.cos(q2), across * F.sin(q2), q[0] * F.cos(q1)]


def to_cartesian_vector(system: str, q: list[Column], v: list[Column]) -> list[Column]:
    """Cartesian components of a vector given in the local basis (PRJ44)."""
    zero = F.lit(0.0)
    q1 = q[1] if len(q) > 1 else zero
    q2 = q[2] if len(q) > 2 else zero
    if system == "cartesian":
        return list(v)
    if system == "polar":
        c, s = F.cos(q1), F.sin(q1)
        return [v[0] * c - v[1] * s, v[0] * s + v[1] * c, v[2]]
    if len(q) == 1:
        return [v[0], zero, zero]
    st, ct, sp, cp = F.sin(q1), F.cos(q1), F.sin(q2), F.cos(q2)
    outward = v[0] * st + v[1] * ct
    return [outward * cp - v[2] * sp, outward * sp + v[2] * cp, v[0] * ct - v[1] * st]
