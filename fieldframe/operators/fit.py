"""Power-law fits of histograms and per-pixel spectral fits (AGG10, AGG11, UDF4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.functions.numeric import clip, finite, finite_positive


def power_law_fit(hist: DataFrame, keys: list[str], fallback: float | str = 4.0,
                  minimum_bins: int = 4, bounds: tuple[float, float] = (2.0, 8.0),
                  minimum_r2: float = 0.5) -> DataFrame:
    """Fit dN/dE ~ E^-delta on the populated bins of each key (AGG10).

    ``hist`` has the columns ``lo``, ``hi`` and ``weight``. ``fallback`` is a number or a
    column of ``hist`` that is constant inside a key. The regression sums are partial
    aggregates, so bins of one key may arrive from many tasks.
    """
    lo, hi, w = F.col("lo"), F.col("hi"), F.col("weight")
    density = w / (hi - lo)
    used = (w > 0.0) & finite(density) & (density > 0.0)
    x = F.when(used, F.log10(F.sqrt(lo * hi)))
    y = F.when(used, F.log10(density))
    back = F.lit(float(fallback)) if not isinstance(fallback, str) else F.col(fallback)
    sums = hist.withColumns({"_x": x, "_y": y, "_fallback": back}).groupBy(*keys).agg(
        F.count("_y").alias("bins"),
        F.regr_slope("_y", "_x").alias("_slope"),
        F.regr_r2("_y", "_x").alias("_r2"),
        F.var_pop("_y").alias("_spread"),
        F.max("_fallback").alias("_fallback"))
    enough = F.col("bins") >= minimum_bins
    # a flat spectrum explains nothing: its quality is 0, not 1
    r2 = F.when(enough & (F.col("_spread") > 0.0), F.coalesce(F.col("_r2"), F.lit(0.0))).otherwise(0.0)
    delta = -F.col("_slope")
    accepted = F.coalesce(enough & finite(delta) & (r2 >= minimum_r2)
                          & (delta >= bounds[0]) & (delta <= bounds[1]), F.lit(False))
    return sums.select(
        *keys,
        F.when(accepted, delta).otherwise(clip(F.col("_fallback"), *bounds)).alias("delta"),
        r2.alias("r2"), accepted.alias("accepted"), "bins")


def power_law_map(hist: DataFrame, keys: list[str], ny: int, nx: int, fallback: float = 4.0,
                  **rules) -> DataFrame:
    """Per-cell fits with the fit of the whole image as fallback (AGG11).

    ``hist`` has keys, iy, ix, ie, lo, hi, weight. Every cell of the image gets a row;
    cells without particles carry the clipped fallback.
    """
    bounds = rules.get("bounds", (2.0, 8.0))
    whole = hist.groupBy(*keys, "ie", "lo", "hi").agg(F.sum("weight").alias("weight"))
    overall = power_law_fit(whole, keys, fallback, **rules).select(
        *keys, F.col("delta").alias("global_delta"), F.col("r2").alias("global_r2"),
        F.col("accepted").alias("global_accepted"))
    local = power_law_fit(hist, [*keys, "iy", "ix"], fallback, **rules)
    # the one row per key of the whole-image fit opens up into the image grid
    grid = overall
    for name, n in (("iy", ny), ("ix", nx)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # joining on a struct, which is never NULL, adds no filter to the local side: both sides
    # then share the exchange of the histogram, and the particles are read once
    cell = F.struct(*keys, "iy", "ix")
    fits = local.select(cell.alias("_cell"), "delta", "r2", "accepted", "bins")
    joined = grid.withColumn("_cell", cell).join(fits, "_cell", "left")
    accepted = F.coalesce(F.col("accepted"), F.lit(False))
    delta = F.when(accepted, F.col("delta")).otherwise(clip(F.col("global_delta"), *bounds))
    return joined.select(
        *keys, "iy", "ix", delta.alias("delta"), F.coalesce("r2", F.lit(0.0)).alias("r2"),
        accepted.alias("accepted"), F.coalesce("bins", F.lit(0)).alias("bins"),
        "global_delta", "global_r2", "global_accepted")


# -- per-pixel spectral fits -----------------------------------------------------------

FIT_SCHEMA = "params array<double>, errors array<double>, spec array<struct<freq:double,obs:double,err:double,fit:double>>"


def log_polynomial_fit(freq: np.ndarray, obs: np.ndarray, err: np.ndarray, degree: int = 1) -> dict:
    """Fit log10 flux by a polynomial of log10 frequency, as a solver for :func:`fit_spectra`.

    Points without positive finite flux are ignored. Too few points give NaN parameters.
    """
    good = np.isfinite(obs) & (obs > 0.0) & (freq > 0.0)
    params = np.full(degree + 1, np.nan)
    errors = np.full(degree + 1, np.nan)
    fit = np.full(obs.shape, np.nan)
    if good.sum() > degree:
        x, y = np.log10(freq[good]), np.log10(obs[good])
        basis = np.vander(x, degree + 1)
        params = np.linalg.lstsq(basis, y, rcond=None)[0]
        residual = y - basis @ params
        spare = max(int(good.sum()) - degree - 1, 1)
        covariance = np.linalg.pinv(basis.T @ basis) * (residual @ residual) / spare
        errors = np.sqrt(np.clip(np.diag(covariance), 0.0, None))
        shown = freq > 0.0
        fit[shown] = 10.0 ** (np.vander(np.log10(freq[shown]), degree + 1) @ params)
    return {"params": params, "errors": errors, "fit": fit}


#: Maps (freq, obs, err) arrays to params, errors and the fitted spectrum.
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray], dict]


def fit_log_line(observed: DataFrame, keys: list[str]) -> DataFrame:
    """A line of log10 flux over log10 frequency for every pixel, by one aggregate (UDF4).

    Same columns as :func:`fit_spectra`; params and errors are (slope, intercept). Points
    without positive finite flux are ignored, fewer than two distinct frequencies give NaN.
    """
    once = observed.groupBy(*keys, "freq").agg(F.avg("obs").alias("obs"), F.avg("err").alias("err"))
    good = (F.col("freq") > 0.0) & finite_positive(F.col("obs"))
    x, y = F.when(good, F.log10("freq")), F.when(good, F.log10("obs"))
    sums = once.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("_a"), F.regr_intercept(y, x).alias("_b"), F.regr_count(y, x).alias("_n"),
        F.regr_sxx(y, x).alias("_xx"), F.regr_syy(y, x).alias("_yy"), F.regr_avgx(y, x).alias("_x"),
        F.array_sort(F.collect_list(F.struct("freq", "obs", "err"))).alias("_s"))
    nan = F.lit(float("nan"))
    usable = (F.col("_n") > 1) & (F.col("_xx") > 0.0)
    spread = F.greatest(F.col("_yy") - F.col("_a") * F.col("_a") * F.col("_xx"), F.lit(0.0)) / F.greatest(F.col("_n") - 2, F.lit(1))
    slope_error = F.sqrt(spread / F.col("_xx"))
    intercept_error = F.sqrt(spread * (F.lit(1.0) / F.col("_n") + F.col("_x") * F.col("_x") / F.col("_xx")))

    def pair(first: Column, second: Column) -> Column:
        return F.array(F.when(usable, first).otherwise(nan), F.when(usable, second).otherwise(nan))

    def fitted(point: Column) -> Column:
        line = F.pow(F.lit(10.0), F.col("_a") * F.log10(point["freq"]) + F.col("_b"))
        fit = F.when(usable & (point["freq"] > 0.0), line).otherwise(nan)
        return F.struct(point["freq"].alias("freq"), point["obs"].alias("obs"), point["err"].alias("err"), fit.alias("fit"))

    return sums.select(*keys, pair(F.col("_a"), F.col("_b")).alias("params"), pair(slope_error, intercept_error).alias("errors"),
                       F.transform("_s", fitted).alias("spec"))


def fit_spectra(observed: DataFrame, keys: list[str], solver: Solver | None = None,
                partitions: int | None = None) -> DataFrame:
    """Run a solver once per pixel spectrum (UDF4); without one, :func:`fit_log_line`.

    ``observed`` has the keys, ``freq``, ``obs`` and ``err``. Repeated measurements of one
    (pixel, frequency) are averaged first, with partial aggregation, so the spectrum of a
    pixel is never longer than the frequency list. Pixels are few and expensive:
    ``partitions`` spreads them over more tasks than their bytes would ask for.
    """
    if solver is None:
        return fit_log_line(observed, keys)
    once = observed.groupBy(*keys, "freq").agg(F.avg("obs").alias("obs"), F.avg("err").alias("err"))
    points = F.array_sort(F.collect_list(F.struct("freq", "obs", "err")))
    spectra = once.groupBy(*keys).agg(points.alias("_s")).select(
        *keys, *[F.col("_s").getField(n).alias(n) for n in ("freq", "obs", "err")])
    if partitions:
        spectra = spectra.repartition(partitions, *keys)
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spectra.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            freq, obs, err = (batch.column(batch.schema.get_field_index(n)) for n in ("freq", "obs", "err"))
            ends = freq.offsets.to_numpy() - freq.offsets[0].as_py()
            flat = [a.flatten().to_numpy(zero_copy_only=False) for a in (freq, obs, err)]
            found = [solver(*(v[i:j] for v in flat)) for i, j in zip(ends, ends[1:])]
            fitted = np.concatenate([f["fit"] for f in found]) if found else np.zeros(0)
            spec = pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in (*flat, fitted)],
                                              names=["freq", "obs", "err", "fit"])
            lists = [pa.array([list(f[n]) for f in found], pa.list_(pa.float64())) for n in ("params", "errors")]
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*arrays, *lists, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spec)],
                names=[*keys, "params", "errors", "spec"])

    return spectra.mapInArrow(run, f"{key_types}, {FIT_SCHEMA}")
