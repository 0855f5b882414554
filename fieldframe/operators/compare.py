"""Truth against candidate: map, image, band and series metrics (AGG14-AGG20, AGG28-AGG33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.functions.constants import SPECTRUM_BANDS
from fieldframe.functions.numeric import NAN, finite


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def match_maps(truth: DataFrame, candidate: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Truth and candidate values side by side (JON7)."""
    left = truth.select(*keys, F.col(value).alias("truth"))
    right = candidate.select(*keys, F.col(value).alias("candidate"))
    return left.join(right, keys)


def _relative_error(reference: Column, other: Column) -> Column:
    """|other-reference|/reference for a positive reference, else 0."""
    return F.when(reference > 0.0, F.abs(other - reference) / F.when(reference > 0.0, reference)).otherwise(0.0)


def _measures(pairs: DataFrame, mask: Column | None) -> tuple[Column, Column, Column, Column]:
    t, c = F.col("truth"), F.col("candidate")
    valid = finite(t) & finite(c)
    if mask is not None:
        valid = valid & mask
    diff = F.when(valid, c - t)
    relative = F.when(valid & (t != 0.0), (c - t) / F.when(t != 0.0, t))
    return t, c, diff, relative


def map_metrics(pairs: DataFrame, keys: list[str], mask: Column | None = None) -> DataFrame:
    """Absolute and relative errors and peaks of a parameter map (AGG14); no valid pixel gives zeros."""
    t, c, diff, relative = _measures(pairs, mask)
    seen = diff.isNotNull()
    out = pairs.groupBy(*keys).agg(
        _zero(F.avg(F.abs(diff))).alias("mae"),
        _zero(F.sqrt(F.avg(diff * diff))).alias("rmse"),
        _zero(F.avg(F.abs(relative))).alias("relative_mae"),
        _zero(F.sqrt(F.avg(relative * relative))).alias("relative_rmse"),
        _zero(F.max(F.when(seen, t))).alias("peak_theory"),
        _zero(F.max(F.when(seen, c))).alias("peak_reconstructed"))
    return out.withColumn("peak_relative_error", _relative_error(F.col("peak_theory"), F.col("peak_reconstructed")))


def image_metrics(pairs: DataFrame, keys: list[str], mask: Column | None = None) -> DataFrame:
    """Image plane errors with brightness centroid offset (AGG15)."""
    t, c, diff, relative = _measures(pairs, mask)
    seen = diff.isNotNull()
    wt = F.when(seen, F.greatest(t, F.lit(0.0))).otherwise(0.0)
    wc = F.when(seen, F.greatest(c, F.lit(0.0))).otherwise(0.0)
    sums = pairs.groupBy(*keys).agg(
        _zero(F.sqrt(F.avg(relative * relative))).alias("relative_rmse"),
        _zero(F.avg(F.abs(relative))).alias("relative_mae"),
        F.sum(wt).alias("_t"), F.sum(wc).alias("_c"),
        F.sum(wt * F.col("ix")).alias("_tx"), F.sum(wt * F.col("iy")).alias("_ty"),
        F.sum(wc * F.col("ix")).alias("_cx"), F.sum(wc * F.col("iy")).alias("_cy"),
        _zero(F.max(F.when(seen, t))).alias("_pt"), _zero(F.max(F.when(seen, c))).alias("_pc"))
    both = (F.col("_t") > 0.0) & (F.col("_c") > 0.0)
    safe_t, safe_c = F.when(both, F.col("_t")), F.when(both, F.col("_c"))
    dx = F.col("_cx") / safe_c - F.col("_tx") / safe_t
    dy = F.col("_cy") / safe_c - F.col("_ty") / safe_t
    return sums.select(
        *keys, "relative_rmse", "relative_mae",
        _zero(F.hypot(dx, dy)).alias("centroid_offset_pixels"),
        _relative_error(F.col("_pt"), F.col("_pc")).alias("peak_value_relative_error"),
        _relative_error(F.col("_t"), F.col("_c")).alias("plane_flux_relative_error"))


def spectrum_error(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """RMS relative error over bins with nonzero truth, 0 without any (AGG17)."""
    t, c = F.col("truth"), F.col("candidate")
    r = F.when(t != 0.0, (c - t) / F.when(t != 0.0, t))
    return pairs.groupBy(*keys).agg(_zero(F.sqrt(F.avg(r * r))).alias("rms_relative_error"))


def band_name(freq_ghz: Column) -> Column:
    """Observing band of a frequency; only the top edge of the last band is included."""
    name = None
    for label, lo, hi, closed in SPECTRUM_BANDS:
        inside = (freq_ghz >= lo) & ((freq_ghz <= hi) if closed else (freq_ghz < hi))
        name = F.when(inside, label) if name is None else name.when(inside, label)
    return name


def band_metrics(pairs: DataFrame, keys: list[str], freq_ghz: str = "freq_ghz") -> DataFrame:
    """Spectrum errors per observing band, a zero row for an empty band (AGG16)."""
    t, c = F.col("truth"), F.col("candidate")
    r = F.when(t != 0.0, (c - t) / F.when(t != 0.0, t))
    banded = pairs.withColumn("band", band_name(F.col(freq_ghz))).filter(F.col("band").isNotNull())
    found = banded.groupBy(*keys, "band").agg(
        _zero(F.sqrt(F.avg(r * r))).alias("rms_relative_error"),
        F.sum(t).alias("flux_theory"), F.sum(c).alias("flux_reconstructed"))
    names = F.explode(F.array(*[F.lit(b[0]) for b in SPECTRUM_BANDS])).alias("band")
    grid = pairs.select(*keys).distinct().select(*keys, names)
    dense = grid.join(found, [*keys, "band"], "left").fillna(0.0)
    return dense.withColumn("flux_relative_error",
                            _relative_error(F.col("flux_theory"), F.col("flux_reconstructed")))


def series_difference(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Relative L1 distance and largest relative difference of two series (AGG20, JON9).

    The floor of the denominator is 1e-12 of the largest |truth| of the key; it is found
    in one aggregate and joined back.
    """
    t, c = F.col("truth"), F.col("candidate")
    largest = F.max(F.abs(t))
    floors = pairs.groupBy(*keys).agg(
        F.when(largest > 0.0, largest * 1.0e-12).otherwise(1.0).alias("_floor"))
    joined = pairs.join(floors, keys)
    reference = F.sum(F.abs(t))
    return joined.groupBy(*keys).agg(
        F.when(reference > 0.0, F.sum(F.abs(c - t)) / F.when(reference > 0.0, reference))
        .otherwise(F.lit(NAN)).alias("relative_l1"),
        F.max(F.abs(c - t) / F.greatest(F.abs(t), F.col("_floor"))).alias("max_relative"))


def match_series(reference: DataFrame, candidate: DataFrame, keys: list[str], position: str,
                 value: str) -> DataFrame:
    """Two series matched by key and position; the shorter one decides the length (JON9)."""
    return match_maps(reference, candidate, [*keys, position], value)


def latest_per_case(timing: DataFrame, case: list[str], columns: list[str], frame: str = "frame") -> DataFrame:
    """The row of the last frame of each case (AGG28)."""
    last = F.max(F.struct(F.col(frame), *columns)).alias("_l")
    return timing.groupBy(*case).agg(last).select(*case, "_l.*")


def speed_up(latest: DataFrame, reference_case: str, case: str = "case", seconds: str = "elapsed_seconds",
             groups: tuple[str, ...] = ()) -> DataFrame:
    """Elapsed time of the reference case over each case (AGG29)."""
    base = latest.filter(F.col(case) == reference_case).select(*groups, F.col(seconds).alias("_ref"))
    if groups:
        joined = latest.join(base, list(groups), "left")
    else:
        row = base.first()
        joined = latest.withColumn("_ref", F.lit(row["_ref"] if row else None).cast("double"))
    ratio = F.when((F.col(seconds) > 0.0) & finite(F.col("_ref")), F.col("_ref") / F.col(seconds))
    return joined.withColumn("speedup", F.coalesce(ratio, F.lit(NAN))).drop("_ref")


def movie_index(particles: DataFrame, threshold_ev: float, keys: list[str], spectra: DataFrame | None = None) -> DataFrame:
    """Per-frame weights around an energy threshold and the spectrum peak (AGG30, FLT2, SNK5).

    ``particles`` is already limited to active rows inside the image.
    """
    below = F.col("energy_ev") < threshold_ev
    above = ~below & ~F.isnan("energy_ev")
    out = particles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("particle_count"), F.sum("weight").alias("active_weight"),
        F.sum(F.when(below, F.col("weight")).otherwise(0.0)).alias("below_threshold_weight"),
        F.sum(F.when(above, F.col("weight")).otherwise(0.0)).alias("above_threshold_weight"))
    if spectra is None:
        return out
    peaks = spectra.groupBy(*keys).agg(F.max("value").alias("spectrum_peak_sfu"))
    return out.join(peaks, keys, "left")


def spectra_range(spectra: DataFrame, lo: str = "energy_left_kev", hi: str = "energy_right_kev") -> DataFrame:
    """Smallest positive left and largest positive right edge, 1e-2 and 1e1 when empty (AGG31)."""
    left = F.when(finite(F.col(lo)) & (F.col(lo) > 0.0), F.col(lo))
    right = F.when(finite(F.col(hi)) & (F.col(hi) > 0.0), F.col(hi))
    return spectra.agg(F.coalesce(F.min(left), F.lit(1.0e-2)).alias("x_min"),
                       F.coalesce(F.max(right), F.lit(1.0e1)).alias("x_max"))


def _summary_in_one_pass(maps: DataFrame, keys: list[str], series: list[str]) -> DataFrame:
    """Map metrics of all pixels and the RMS error of their sums along ``series``, in two levels of one aggregate."""
    t, c, diff, relative = _measures(maps, None)
    seen = diff.isNotNull()
    lines = maps.groupBy(*keys, *series).agg(
        F.count(diff).alias("_n"), F.sum(F.abs(diff)).alias("_d"), F.sum(diff * diff).alias("_dd"),
        F.count(relative).alias("_m"), F.sum(F.abs(relative)).alias("_r"), F.sum(relative * relative).alias("_rr"),
        F.max(F.when(seen, t)).alias("_pt"), F.max(F.when(seen, c)).alias("_pc"), F.sum(t).alias("truth"), F.sum(c).alias("candidate"))
    error = F.when(F.col("truth") != 0.0, (F.col("candidate") - F.col("truth")) / F.when(F.col("truth") != 0.0, F.col("truth")))

    def mean(total: str, count: str) -> Column:
        return F.sum(total) / F.when(F.sum(count) > 0, F.sum(count))

    out = lines.groupBy(*keys).agg(
        _zero(mean("_d", "_n")).alias("mae"), _zero(F.sqrt(mean("_dd", "_n"))).alias("rmse"),
        _zero(mean("_r", "_m")).alias("relative_mae"), _zero(F.sqrt(mean("_rr", "_m"))).alias("relative_rmse"),
        _zero(F.max("_pt")).alias("peak_theory"), _zero(F.max("_pc")).alias("peak_reconstructed"),
        _zero(F.sqrt(F.avg(error * error))).alias("rms_relative_error"))
    return out.withColumn("peak_relative_error", _relative_error(F.col("peak_theory"), F.col("peak_reconstructed")))


def validation_summary(fits: DataFrame, maps: DataFrame, spectra: DataFrame | list[str], keys: list[str]) -> DataFrame:
    """One row per case: accepted fits, global index, map metrics and spectrum error (AGG33).

    ``fits`` comes from ``power_law_map``, ``maps`` holds matched (truth, candidate) pixels,
    ``spectra`` matched frequencies. Where the spectra are sums of the same pixels, name the columns of their
    positions instead: the pixels are then read once, not once for the maps and once for the spectra.
    """
    counts = fits.groupBy(*keys).agg(
        F.count(F.when(F.col("accepted"), 1)).alias("accepted_local_fits"),
        F.max("global_delta").alias("global_power_law_index"),
        F.max("global_r2").alias("global_power_law_r_squared"))
    if isinstance(spectra, list):
        return counts.join(_summary_in_one_pass(maps, keys, spectra), keys)
    return (counts.join(map_metrics(maps, keys), keys)
            .join(spectrum_error(spectra, keys), keys))


def validation_groups(pairs: DataFrame, keys: list[str], kind: str = "kind", name: str = "name") -> DataFrame:
    """Error measures of matched pixels for each (kind, name), each kind, and each case, in one pass (AGG33).

    ``pairs`` holds truth and candidate with iy, ix, kind and name. The wider groups have ``all`` in place of what
    they leave out; a kind or name that is NULL is called ``none``. Maps, peaks, flux and brightness centroid are
    measured as in ``map_metrics`` and ``image_metrics``.
    """
    named = pairs.withColumns({c: F.coalesce(F.col(c), F.lit("none")) for c in (kind, name)})
    t, c, diff, relative = _measures(named, None)
    seen = diff.isNotNull()
    wt = F.when(seen, F.greatest(t, F.lit(0.0))).otherwise(0.0)
    wc = F.when(seen, F.greatest(c, F.lit(0.0))).otherwise(0.0)
    moments = {f"_{w}{d}": F.sum(m * F.col(f"i{d}") if d else m) for w, m in (("t", wt), ("c", wc)) for d in ("", "x", "y")}
    sums = named.groupingSets([[*keys, kind, name], [*keys, kind], [*keys]], *keys, kind, name).agg(
        F.grouping(kind).alias("_no_kind"), F.grouping(name).alias("_no_name"),
        _zero(F.avg(F.abs(diff))).alias("mae"), _zero(F.sqrt(F.avg(diff * diff))).alias("rmse"),
        _zero(F.avg(F.abs(relative))).alias("relative_mae"), _zero(F.sqrt(F.avg(relative * relative))).alias("relative_rmse"),
        _zero(F.max(F.when(seen, t))).alias("peak_theory"), _zero(F.max(F.when(seen, c))).alias("peak_reconstructed"),
        *[m.alias(n) for n, m in moments.items()])
    both = (F.col("_t") > 0.0) & (F.col("_c") > 0.0)
    offset = [F.col(f"_c{d}") / F.when(both, F.col("_c")) - F.col(f"_t{d}") / F.when(both, F.col("_t")) for d in ("x", "y")]
    return sums.select(
        *keys, F.when(F.col("_no_kind") == 1, "all").otherwise(F.col(kind)).alias(kind),
        F.when(F.col("_no_name") == 1, "all").otherwise(F.col(name)).alias(name),
        "mae", "rmse", "relative_mae", "relative_rmse", "peak_theory", "peak_reconstructed",
        _relative_error(F.col("peak_theory"), F.col("peak_reconstructed")).alias("peak_relative_error"),
        _relative_error(F.col("_t"), F.col("_c")).alias("flux_relative_error"),
        _zero(F.hypot(*offset)).alias("centroid_offset_pixels"))


def validation_documents(groups: DataFrame, keys: list[str], summary: DataFrame, kind: str = "kind", name: str = "name") -> DataFrame:
    """One VARIANT ``report`` a case: ``summary``, its columns, and ``groups``, measures by kind and name (AGG33).

    A case has as many groups as kinds and names, not as pixels. Cases without a summary are left out.
    """
    measures = [c for c in groups.columns if c not in (*keys, kind, name)]
    by_name = groups.groupBy(*keys, kind).agg(F.map_from_entries(F.collect_list(F.struct(F.col(name), F.struct(*measures)))).alias("_names"))
    by_kind = by_name.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(kind), F.col("_names")))).alias("groups"))
    told = summary.select(*keys, F.struct(*[c for c in summary.columns if c not in keys]).alias("summary"))
    return told.join(by_kind, keys).select(*keys, F.parse_json(F.to_json(F.struct("summary", "groups"))).alias("report"))
