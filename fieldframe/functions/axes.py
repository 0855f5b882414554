"""Grid axes as Column expressions: edges, centres, cell lookup, wrapping."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """One grid axis of ``n`` cells.

    ``kind`` is ``uniform``, ``log``, ``linear_width`` (cell width grows by ``growth``
    from cell to cell) or ``edges``. The analytic kinds are described by the first
    face ``start`` (its logarithm for ``log``) and the first step, and compile to
    closed forms. ``edges`` carries the faces themselves and is meant for axes of up
    to a few hundred cells; longer ones go through ``operators.lookup.interval_lookup``.
    """

    kind: str
    n: int
    start: float = 0.0
    step: float = 1.0
    growth: float = 0.0
    edges: tuple[float, ...] = ()
    periodic: bool = False

    @staticmethod
    def uniform(lo: float, hi: float, n: int, periodic: bool = False) -> "Axis":
        return Axis("uniform", n, float(lo), (hi - lo) / n, periodic=periodic)

    @staticmethod
    def log(lo: float, hi: float, n: int) -> "Axis":
        if lo <= 0.0 or hi <= lo:
            raise ValueError("a log axis needs 0 < lo < hi")
        return Axis("log", n, math.log(lo), (math.log(hi) - math.log(lo)) / n)

    @staticmethod
    def linear_width(lo: float, first_width: float, growth: float, n: int) -> "Axis":
        return Axis("linear_width", n, float(lo), float(first_width), float(growth))

    @staticmethod
    def stored(edges, periodic: bool = False) -> "Axis":
        return Axis("edges", len(edges) - 1, edges=tuple(float(e) for e in edges),
                    periodic=periodic)

    # -- coordinates ----------------------------------------------------------------
    def _face_value(self, index: float) -> float:
        if self.kind == "uniform":
            return self.start + index * self.step
        if self.kind == "log":
            return math.exp(self.start + index * self.step)
        if self.kind == "linear_width":
            return self.start + index * self.step + 0.5 * self.growth * index * (index - 1.0)
        return self.edges[int(index)]

    @property
    def lower(self) -> float:
        return self._face_value(0)

    @property
    def upper(self) -> float:
        return self._face_value(self.n)

    @property
    def width(self) -> float:
        return self.upper - self.lower

    def face(self, index: Column) -> Column:
        """Face coordinate of a (possibly ghost) index."""
        if self.kind == "uniform":
            return F.lit(self.start) + index * self.step
        if self.kind == "log":
            return F.exp(F.lit(self.start) + index * self.step)
        if self.kind == "linear_width":
            return F.lit(self.start) + index * self.step + (
                index * (index - 1.0)) * (0.5 * self.growth)
        inside = F.get(F.array(*[F.lit(e) for e in self.edges]),
                       F.greatest(F.least(index, F.lit(self.n)), F.lit(0)).cast("int"))
        if self.periodic:
            below = self._ghost(index + self.n) - self.width
            above = self._ghost(index - self.n) + self.width
        else:  # extend by the width of the border cell
            below = F.lit(self.edges[0]) + index * (self.edges[1] - self.edges[0])
            above = F.lit(self.edges[-1]) + (index - self.n) * (self.edges[-1] - self.edges[-2])
        return F.when(index < 0, below).when(index > self.n, above).otherwise(inside)

    def _ghost(self, index: Column) -> Column:
        return F.get(F.array(*[F.lit(e) for e in self.edges]), index.cast("int"))

    def center(self, index: Column) -> Column:
        """Cell centre: the midpoint of the two faces (PRJ47)."""
        return (self.face(index) + self.face(index + 1)) * 0.5

    def cell_width(self, index: Column) -> Column:
        return self.face(index + 1) - self.face(index)

    # -- lookup ---------------------------------------------------------------------
    def face_index(self, x: Column) -> Column:
        """Fractional face index of a coordinate (analytic kinds)."""
        if self.kind == "uniform" or (self.kind == "linear_width" and self.growth == 0.0):
            return (x - self.start) / self.step
        if self.kind == "log":
            return (F.log(x) - self.start) / self.step
        if self.kind == "linear_width":
            # root of growth/2 i^2 + (step - growth/2) i - (x - start) = 0
            half = self.step - 0.5 * self.growth
            root = F.sqrt(F.lit(half * half) + (x - self.start) * (2.0 * self.growth))
            return (root - half) / self.growth
        raise ValueError("stored edges have no closed form")

    def center_index(self, x: Column) -> Column:
        """Fractional cell-centre index of a coordinate, for interpolation."""
        if self.kind == "uniform" or (self.kind == "linear_width" and self.growth == 0.0):
            return (x - self.start) / self.step - 0.5
        if self.kind == "log":
            offset = math.log(0.5 * (1.0 + math.exp(self.step)))
            return (F.log(x) - self.start - offset) / self.step
        if self.kind == "linear_width":
            inner = F.lit(self.step * self.step) + (
                x - self.start - 0.5 * self.step) * (2.0 * self.growth)
            return (F.sqrt(inner) - self.step) / self.growth
        centers = [0.5 * (a + b) for a, b in zip(self.edges, self.edges[1:])]
        known = F.array(*[F.lit(c) for c in centers])
        below = F.size(F.filter(known, lambda c: c <= x)) - 1
        lower = F.greatest(F.least(below, F.lit(self.n - 2)), F.lit(0))
        c0, c1 = F.get(known, lower), F.get(known, lower + 1)
        return lower + (x - c0) / (c1 - c0)

    def cell_index(self, x: Column) -> Column:
        """Cell of a coordinate: -1 below, n above, the exact top face is the last cell (PRJ30)."""
        if self.kind == "edges":
            known = F.array(*[F.lit(e) for e in self.edges])
            inside = F.size(F.filter(known, lambda e: e <= x)) - 1
        else:
            inside = F.floor(self.face_index(x)).cast("int")
        lower, upper = self.lower, self.upper
        ascending = upper >= lower
        below = x < lower if ascending else x > lower
        above = x > upper if ascending else x < upper
        if self.kind == "edges" and not ascending:
            known = F.array(*[F.lit(e) for e in self.edges])
            inside = F.size(F.filter(known, lambda e: e >= x)) - 1
        return (F.when(below, -1).when(above, self.n)
                .when(x == upper, self.n - 1).otherwise(inside).cast("int"))

    def contains(self, x: Column) -> Column:
        """Inside the axis, both ends included."""
        lo, hi = min(self.lower, self.upper), max(self.lower, self.upper)
        return (x >= lo) & (x <= hi)

    def histogram_index(self, x: Column) -> Column:
        """Uniform image bin with the upper edge in the last bin, NULL outside (AGG5 rule)."""
        raw = F.floor((x - self.lower) / self.width * self.n)
        inside = F.least(raw, F.lit(self.n - 1)).cast("int")
        return F.when((x >= self.lower) & (x <= self.upper), inside)

    def floor_bin(self, x: Column) -> Column:
        """Uniform image bin of a coordinate known to be inside (AGG6 rule)."""
        return F.floor((x - self.lower) / self.width * self.n).cast("int")

    def inside_floor(self, x: Column) -> Column:
        """Whether the floor bin lies on the image, the upper edge excluded.

        The two comparisons let the scan skip rows; the bin itself decides at the rim.
        """
        return (x >= self.lower) & (x <= self.upper) & (self.floor_bin(x) < self.n)

    def floor_index(self, x: Column) -> Column:
        """Uniform image bin with the upper edge excluded, NULL outside (AGG6 rule)."""
        return F.when(self.inside_floor(x), self.floor_bin(x))

    def wrap(self, x: Column) -> Column:
        """Wrap a coordinate into [lower, upper) (PRJ28)."""
        return wrap(x, self.lower, self.upper)


def wrap(x: Column, lower: float, upper: float) -> Column:
    """Periodic wrap into [lower, upper), with roundoff at both ends repaired (PRJ28)."""
    width = upper - lower
    turns = F.floor((x - lower) / width)
    once = x - turns * width
    folded = F.when(once >= upper, once - width).otherwise(once)
    return F.when(folded < lower, folded + width).otherwise(folded)


def linear_edges(lo: float, hi: float, n: int) -> Column:
    """Array of n+1 evenly spaced edges (PRJ31)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)),
                       lambda i: F.lit(float(lo)) + i * ((hi - lo) / n))


def log_edges(lo: Column, hi: Column, n: int) -> Column:
    """Array of n+1 edges evenly spaced in log10; the end points are powers too (PRJ31)."""
    first = F.log10(lo)
    step = (F.log10(hi) - first) / float(n)
    return F.transform(F.sequence(F.lit(0), F.lit(n)),
                       lambda i: F.pow(F.lit(10.0), first + i * step))


def pixel_centers(lo: float, hi: float, n: int) -> Column:
    """Array of n pixel centres (PRJ31)."""
    step = (hi - lo) / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: (F.lit(float(lo)) + i * step + (F.lit(float(lo)) + (i + 1) * step))
                       * 0.5)


def edge_index(edges: Column, value: Column) -> Column:
    """Number of edges <= value, minus one, for an array Column of edges (AGG6 rule)."""
    return F.size(F.filter(edges, lambda e: e <= value)) - 1


def fixed_edge_index(edges: list[float], value: Column) -> Column:
    """The same for edges known beforehand: a binary search written as nested conditions.

    It stays inside generated code and needs log2(n) comparisons per row.
    """
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo - 1)
        middle = (lo + hi) // 2
        return F.when(value < float(edges[middle]), search(lo, middle)).otherwise(search(middle + 1, hi))

    return search(0, len(edges))


def log_edge_index(edges: Column, value: Column) -> Column:
    """The same for evenly spaced log edges: a closed-form guess, settled by its two edges."""
    n = F.size(edges) - 1
    first = F.log10(F.get(edges, F.lit(0)))
    step = (F.log10(F.get(edges, n)) - first) / n
    guess = F.floor((F.log10(value) - first) / step)
    near = F.greatest(F.least(guess, n), F.lit(-1)).cast("int")
    lower, upper = F.get(edges, near), F.get(edges, near + 1)
    settled = F.when(value >= upper, near + 1).when(value < lower, near - 1).otherwise(near)
    return F.when(value > 0.0, settled).otherwise(-1)
