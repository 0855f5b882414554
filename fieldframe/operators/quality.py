"""Data-quality checks (DQ1-DQ9). Each returns violations (check, key, detail); empty means good."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldframe.functions.geometry import is_singular
from fieldframe.functions.numeric import finite, metadata_matches


def violations(df: DataFrame, key: Column, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows failing any of the named checks; a check is (good, detail). One pass over ``df``."""
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(good, F.lit(False)), F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail")))
        for name, (good, detail) in checks.items()]))
    return df.select(key.cast("string").alias("key"), F.explode(failed).alias("_f")).select(
        F.col("_f.check").alias("check"), "key", F.col("_f.detail").alias("detail"))


def require_clean(found: DataFrame) -> None:
    """Raise with up to 20 violations when there are any."""
    rows = found.limit(20).collect()
    if rows:
        raise ValueError("; ".join(f"{r['check']}[{r['key']}]: {r['detail']}" for r in rows))


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def header_ranges(headers: DataFrame, key: str = "path") -> DataFrame:
    """Particle snapshot header ranges (DQ1)."""
    def positive(c: str) -> tuple[Column, Column]:
        return finite(F.col(c)) & (F.col(c) > 0.0), F.col(c)

    return violations(headers, F.col(key), {
        "space_dim": (F.col("space_dim").between(1, 3), F.col("space_dim")),
        "particle_count": (F.col("particle_count") >= 0, F.col("particle_count")),
        "particle_capacity": (F.col("particle_capacity") >= F.col("particle_count"), F.col("particle_capacity")),
        "rest_mass": positive("rest_mass"), "speed_of_light": positive("speed_of_light"),
        "energy_scale_erg": positive("energy_scale_erg"),
        "charge": (finite(F.col("charge")), F.col("charge"))})


def field_header_ranges(headers: DataFrame, key: str = "path") -> DataFrame:
    """Field snapshot header ranges (DQ1)."""
    product = F.col("nx").cast("long") * F.col("ny") * F.col("nz")

    def positive(c: str) -> tuple[Column, Column]:
        return finite(F.col(c)) & (F.col(c) > 0.0), F.col(c)

    return violations(headers, F.col(key), {
        "space_dim": (F.col("space_dim").between(1, 3), F.col("space_dim")),
        "output_component_dim": (F.col("output_component_dim").isin(1, 3), F.col("output_component_dim")),
        "dimensions": (_all(*[F.col(c) > 0 for c in ("nx", "ny", "nz")]), product),
        "point_count": (F.col("point_count") == product, F.col("point_count")),
        "coordinate_scale_cgs": positive("coordinate_scale_cgs"),
        "value_scale_cgs": positive("value_scale_cgs")})


def value_columns(df: DataFrame, key: Column, columns: list[str], non_negative: bool = True) -> DataFrame:
    """Finite and non-negative values (DQ2)."""
    return violations(df, key, {
        c: (finite(F.col(c)) & ((F.col(c) >= 0.0) if non_negative else F.lit(True)), F.col(c)) for c in columns})


def cell_counts(df: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Frames whose number of cells differs from nx*ny (DQ2)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return violations(counts, F.concat_ws("/", *keys), {"cell_count": (F.col("_n") == expected, F.col("_n"))})


def edges(axes: DataFrame, keys: list[str], index: str = "i", value: str = "edge", uniform: bool = False) -> DataFrame:
    """Finite, strictly ascending and optionally evenly spaced edges (DQ3, DQ4).

    The spacing tolerance is 1024 machine epsilons of the largest of span, step and 1. An
    axis is one grid line, so the lag window is as long as the axis.
    """
    w = W.partitionBy(*keys).orderBy(index)
    ends = axes.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    staged = axes.withColumn("_prev", F.lag(value).over(w)).join(ends, keys)
    v, prev = F.col(value), F.col("_prev")
    span = F.col("_hi") - F.col("_lo")
    step = span / F.greatest(F.col("_n") - 1, F.lit(1))
    here = v - prev
    tolerance = F.greatest(F.abs(span), F.abs(step), F.abs(here), F.lit(1.0)) * (1024.0 * 2.0 ** -52)
    checks = {"finite": (finite(v), v), "ascending": (prev.isNull() | (v > prev), v),
              "length": (F.col("_n") >= 2, F.col("_n"))}
    if uniform:
        checks["uniform"] = (prev.isNull() | (F.abs(here - step) <= tolerance), here)
    return violations(staged, F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col(index).cast("string")), checks)


def frequency_grid(bands: DataFrame, keys: list[str], index: str = "freq_idx", freq: str = "freq_hz") -> DataFrame:
    """Positive, finite, strictly increasing frequencies (DQ4)."""
    w = W.partitionBy(*keys).orderBy(index)
    staged = bands.withColumn("_prev", F.lag(freq).over(w))
    f = F.col(freq)
    return violations(staged, F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col(index).cast("string")), {
        "positive": (finite(f) & (f > 0.0), f),
        "increasing": (F.col("_prev").isNull() | (f > F.col("_prev")), f)})


def time_consistency(summary: DataFrame, dt_out: float, key: Column | None = None) -> DataFrame:
    """|time - frame*dt| within max(1e-12, 1e-12*|expected|) (DQ5)."""
    expected = F.col("frame").cast("double") * float(dt_out)
    error = F.abs(F.col("time") - expected)
    limit = F.greatest(F.lit(1.0e-12), F.abs(expected) * 1.0e-12)
    return violations(summary, F.col("frame") if key is None else key, {"time": (error <= limit, F.col("time"))})


def last_frame_present(summary: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Runs whose last summary frame has no snapshot (DQ5)."""
    last = summary.groupBy(*keys).agg(F.max("frame").alias("frame"))
    gone = last.join(available.select(*keys, "frame").distinct(), [*keys, "frame"], "left_anti")
    return gone.select(F.lit("last_frame").alias("check"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
                       .alias("key"), F.col("frame").cast("string").alias("detail"))


def metadata(actual: DataFrame, expected: dict[str, float], key: str = "path") -> DataFrame:
    """Metadata equal to expectations within 1e-12 relative (DQ6)."""
    return violations(actual, F.col(key), {
        c: (metadata_matches(F.col(c), F.lit(float(v))), F.col(c)) for c, v in expected.items()})


def region_bounds(regions: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """Finite and ascending region bounds ``<d>_lo``, ``<d>_hi`` (DQ7)."""
    return violations(regions, F.col(key), {
        d: (finite(F.col(f"{d}_lo")) & finite(F.col(f"{d}_hi")) & (F.col(f"{d}_hi") > F.col(f"{d}_lo")),
            F.concat_ws("..", F.col(f"{d}_lo").cast("string"), F.col(f"{d}_hi").cast("string"))) for d in dims})


def particle_moments(cells: DataFrame, key: Column) -> DataFrame:
    """Ordered energies, non-negative weights and variance, angle in [0, pi] where present (DQ7)."""
    checks = {
        "weight": (finite(F.col("weight_sum")) & (F.col("weight_sum") >= 0.0), F.col("weight_sum")),
        "energy": (finite(F.col("min_energy_ev")) & finite(F.col("max_energy_ev")) & (F.col("min_energy_ev") >= 0.0)
                   & (F.col("max_energy_ev") >= F.col("min_energy_ev")), F.col("max_energy_ev")),
        "mean_mu": (finite(F.col("mean_mu")), F.col("mean_mu")),
        "var_mu": (finite(F.col("var_mu")) & (F.col("var_mu") >= 0.0), F.col("var_mu"))}
    if "viewing_angle" in cells.columns:
        angle = F.col("viewing_angle")
        checks["viewing_angle"] = (finite(angle) & angle.between(0.0, math.pi), angle)
    return violations(cells, key, checks)


def grid_singularities(points: DataFrame, key: Column, system: str, coordinates: list[str]) -> DataFrame:
    """Points on the axis or origin of a curvilinear grid (DQ8)."""
    q = [F.col(c) for c in coordinates]
    return violations(points, key, {"singular": (~is_singular(system, q), F.concat_ws(",", *[c.cast("string") for c in q]))})


def periodic_ascending(axes: DataFrame, keys: list[str], index: str = "i", value: str = "edge") -> DataFrame:
    """Periodic axes must ascend (DQ8); rows of other axes are ignored."""
    return edges(axes.filter(F.col("periodic")), keys, index, value).filter(F.col("check") == "ascending")


def payload_size(files: DataFrame, expected: Column, key: str = "path") -> DataFrame:
    """File length against the size its header promises (DQ9)."""
    return violations(files, F.col(key), {
        "short": (F.col("length") >= expected, F.col("length")),
        "trailing": (F.col("length") <= expected, F.col("length"))})
