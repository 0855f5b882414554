"""Weighted histograms and deposits (AGG3-AGG9, AGG13, PRJ24)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions.axes import Axis, edge_index, fixed_edge_index, log_edge_index, log_edges
from fieldframe.functions.kinematics import transport_energy_kev
from fieldframe.functions.numeric import finite_positive
from fieldframe.session import materialize


def densify(df: DataFrame, groups: DataFrame, keys: list[str], cells: dict[str, int],
            fills: dict[str, object]) -> DataFrame:
    """One row per (group, cell) with empty cells filled (AGG4).

    ``groups`` holds the distinct keys; ``cells`` maps index column to its length. The
    full grid is generated from the groups, so nothing but the groups is shuffled twice. A
    row of ``df`` outside the declared cells raises; a NULL index belongs to no cell and is left out.
    """
    outside = F.lit(False)
    for name, n in cells.items():
        outside = outside | (F.col(name) < 0) | (F.col(name) >= n)
    where = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in cells])
    # a filter leaves the index columns plain for the join
    df = df.filter(F.when(outside, F.raise_error(F.concat(F.lit("outside the declared cells: "), where)).cast("boolean")).otherwise(True))
    grid = groups.select(*keys).distinct()
    for name, n in cells.items():
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    joined = grid.join(df, [*keys, *cells], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def fill_bins(hist: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """All bins 0..bins-1 per key from a summed histogram (AGG4).

    A key has at most ``bins`` rows here, so they fit in one map; keys whose rows all carry
    a NULL bin still get their empty bins. No join and no second scan are needed.
    """
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", "weight"))
    packed = hist.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    return (packed.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
            .select(*keys, "bin", F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0.0))
                    .alias("weight")))


def log_bin(p: Column, pmin: float, pmax: float, bins: int) -> Column:
    """Natural-log bin on [pmin, pmax], both ends included, NULL outside (AGG3 rule)."""
    scale = bins / (math.log(pmax) - math.log(pmin))
    raw = ((F.log(p) - math.log(pmin)) * scale).cast("int")
    inside = F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0))
    return F.when((p >= pmin) & (p <= pmax), inside)


def momentum_histogram(particles: DataFrame, pmin: float = 0.01, pmax: float = 10.0,
                       bins: int = 128, keys: tuple[str, ...] = ("frame",),
                       dense: bool = True) -> DataFrame:
    """Weighted momentum histogram of active particles per frame (AGG3, AGG4, SNK2)."""
    active = F.col("status") == C.STATUS_ACTIVE
    binned = particles.select(*keys, F.when(active, log_bin(F.col("p"), pmin, pmax, bins)).alias("bin"),
                              "weight")
    hist = binned.groupBy(*keys, "bin").agg(F.sum("weight").alias("weight"))
    hist = fill_bins(hist, list(keys), bins) if dense else hist.filter(F.col("bin").isNotNull())
    step = (math.log(pmax) - math.log(pmin)) / bins
    return hist.select(
        *keys, "bin",
        F.exp(F.lit(math.log(pmin)) + F.col("bin") * step).alias("p_left"),
        F.exp(F.lit(math.log(pmin)) + (F.col("bin") + 1) * step).alias("p_right"),
        "weight")


def deposit(particles: DataFrame, x_axis: Axis, y_axis: Axis, keys: tuple[str, ...] = ("frame",),
            values: dict[str, Column] | None = None, dense: bool = False) -> DataFrame:
    """Weights summed on an image grid, upper edges included (AGG5).

    ``values`` adds further sums, for example conditional weights, in the same pass.
    """
    sums = {"weight": F.col("weight")} | (values or {})
    inside = particles.filter(x_axis.contains(F.col("x")) & y_axis.contains(F.col("y")))
    binned = inside.select(
        *keys, x_axis.histogram_index(F.col("x")).alias("ix"),
        y_axis.histogram_index(F.col("y")).alias("iy"),
        *[v.alias(f"_v_{n}") for n, v in sums.items()])
    out = binned.groupBy(*keys, "iy", "ix").agg(*[F.sum(f"_v_{n}").alias(n) for n in sums])
    if dense:
        out = densify(out, particles.select(*keys), list(keys), {"iy": y_axis.n, "ix": x_axis.n},
                      {n: 0.0 for n in sums})
    return out.select(*keys, "iy", "ix", *sums)


def energy_edges(particles: DataFrame, bins: int, keys: tuple[str, ...] = ("frame",),
                 energy: str = "energy_ev", widen: bool = True) -> DataFrame:
    """Log energy edges between the active extremes, one array per key (AGG7).

    A key without active particles of positive energy gives no row. With ``widen`` a
    single energy spans up to 1.001 times itself.
    """
    active = particles.filter((F.col("status") == C.STATUS_ACTIVE)
                              & finite_positive(F.col(energy)))
    lo, hi = F.min(energy).alias("_lo"), F.max(energy).alias("_hi")
    ends = active.groupBy(*keys).agg(lo, hi)
    top = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo") * 1.001)
    return ends.select(*keys, log_edges(F.col("_lo"), top if widen else F.col("_hi"), bins)
                       .alias("edges"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail before any further job when a frame that must not be empty is empty."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def cell_energy_histogram(particles: DataFrame, x_axis: Axis, y_axis: Axis, edges: DataFrame | list,
                          keys: tuple[str, ...] = ("frame",), energy: str = "energy_ev",
                          include_top: bool = False, log_spaced: bool = True) -> DataFrame:
    """Weights per (cell, energy bin); upper edges are excluded (AGG6).

    ``edges`` is a list shared by all keys or a DataFrame (keys, edges), evenly spaced in the
    logarithm as ``energy_edges`` makes them unless ``log_spaced`` is off. The hottest
    particle falls on the top edge and is dropped unless ``include_top`` is set.
    """
    e = F.col(energy)
    if isinstance(edges, list):
        if len(edges) < 2 or any(not b > a for a, b in zip(edges, edges[1:])):
            raise ValueError("energy edges must be strictly increasing")
        known, raw = particles, fixed_edge_index(edges, e)
        bottom, top, last = F.lit(float(edges[0])), F.lit(float(edges[-1])), F.lit(len(edges) - 2)
    else:
        # one row per key: written first, so that Catalyst need not shuffle the particles
        known = particles.join(materialize(edges, "energy-edges"), list(keys))
        raw = log_edge_index(F.col("edges"), e) if log_spaced else edge_index(F.col("edges"), e)
        bottom, top, last = F.get("edges", F.lit(0)), F.element_at("edges", -1), F.size("edges") - 2
    # rows are filtered by plain comparisons, so that the bin expressions are evaluated once
    inside = (e >= bottom) & ((e <= top) if include_top else (e < top))
    kept = known.filter(x_axis.inside_floor(F.col("x")) & y_axis.inside_floor(F.col("y")) & inside)
    binned = kept.select(
        *keys, x_axis.floor_bin(F.col("x")).alias("ix"), y_axis.floor_bin(F.col("y")).alias("iy"),
        F.least(raw, last).alias("ie"), "weight")
    return binned.groupBy(*keys, "iy", "ix", "ie").agg(F.sum("weight").alias("weight"))


def coarse_average(field: DataFrame, x_axis: Axis, y_axis: Axis, nx: int, ny: int,
                   columns: list[str], keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Mean of native cells per coarse pixel by cell centre, empty pixels 0 (AGG8)."""
    def index(axis: Axis, i: Column, n: int) -> Column:
        raw = F.floor((axis.center(i) - axis.lower) / axis.width * n).cast("int")
        return F.greatest(F.least(raw, F.lit(n - 1)), F.lit(0))

    coarse = field.select(*keys, index(y_axis, F.col("iy"), ny).alias("cy"),
                          index(x_axis, F.col("ix"), nx).alias("cx"), *columns)
    means = coarse.groupBy(*keys, "cy", "cx").agg(*[F.avg(c).alias(c) for c in columns])
    means = means.withColumnsRenamed({"cy": "iy", "cx": "ix"})
    return densify(means, field.select(*keys), list(keys), {"iy": ny, "ix": nx},
                   {c: 0.0 for c in columns})


def project_axis(table: DataFrame, keep: list[str], value: str) -> DataFrame:
    """Sum an N-d table over all axes but the named ones (AGG13)."""
    return table.groupBy(*keep).agg(F.sum(value).alias(value))


def spectrum_columns(hist: DataFrame, p0: float = 0.1, p0_energy_kev: float = 1.0) -> DataFrame:
    """Geometric centres and per-decade densities in momentum and energy (PRJ24)."""
    e_lo = transport_energy_kev(F.col("p_left"), p0, p0_energy_kev)
    e_hi = transport_energy_kev(F.col("p_right"), p0, p0_energy_kev)
    staged = hist.withColumns({"energy_left_kev": e_lo, "energy_right_kev": e_hi})
    return staged.withColumns({
        "p_center": F.sqrt(F.col("p_left") * F.col("p_right")),
        "energy_center_kev": F.sqrt(F.col("energy_left_kev") * F.col("energy_right_kev")),
        "dndlog10p": F.col("weight") / (F.log10("p_right") - F.log10("p_left")),
        "dndlog10e": F.col("weight") / (F.log10("energy_right_kev") - F.log10("energy_left_kev")),
    })
