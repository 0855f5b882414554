"""Image cubes: spectra, beams, regions of interest, masks and limits.

A cube is a long table (keys, freq_hz or freq_idx, iy, ix, value).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldframe.functions import radiometry as R
from fieldframe.functions.numeric import finite, finite_positive, fractional_difference
from fieldframe.functions.predicates import in_circle
from fieldframe.operators.binning import densify
from fieldframe.operators.blocks import exact_percentiles


def spectrum(cube: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sum over the image per key (AGG9)."""
    return cube.groupBy(*keys).agg(F.sum(value).alias(value))


def gaussian_kernel(fwhm: float, truncate: float = 4.0) -> list[float]:
    """Normalized 1-D kernel, radius ceil(4 sigma)."""
    if not math.isfinite(fwhm) or fwhm <= 0.0:
        raise ValueError("the beam width must be positive and finite")
    sigma = fwhm * R.SIGMA_PER_FWHM
    radius = math.ceil(truncate * sigma)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [v / math.fsum(raw) for v in raw]


def _smooth_axis(cube: DataFrame, line: list[str], dim: str, values: list[str],
                 taps: list[tuple[int, Column]]) -> DataFrame:
    """Weighted sums of shifted values along a dense line, the ends repeated."""
    w = W.partitionBy(*line).orderBy(dim)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    smoothed = {}
    for value in values:
        first, last = F.first(value).over(whole), F.last(value).over(whole)
        total = None
        for offset, tap in taps:
            if offset < 0:
                v = F.coalesce(F.lag(value, -offset).over(w), first)
            elif offset > 0:
                v = F.coalesce(F.lead(value, offset).over(w), last)
            else:
                v = F.col(value)
            total = v * tap if total is None else total + v * tap
        smoothed[value] = total
    return cube.withColumns(smoothed)


def beam_convolve(cube: DataFrame, keys: list[str], value: str | list[str] = "value",
                  fwhm: float | Column = 3.0, max_fwhm: float | None = None) -> DataFrame:
    """Separable Gaussian beam convolution with repeated edges (GRD10).

    Two window passes over grid lines; several value columns share both passes. Every line
    must be dense (see ``densify``). ``fwhm`` may be a Column that is constant per key;
    ``max_fwhm`` then bounds the kernel radius.
    """
    values = [value] if isinstance(value, str) else list(value)
    if isinstance(fwhm, Column):
        if max_fwhm is None:
            raise ValueError("a Column beam width needs max_fwhm")
        radius = math.ceil(4.0 * max_fwhm * R.SIGMA_PER_FWHM)
        sigma = fwhm * R.SIGMA_PER_FWHM
        reach = F.ceil(sigma * 4.0)
        raw = {k: F.when(F.lit(k) <= reach, F.exp(F.lit(-0.5 * k * k) / (sigma * sigma))).otherwise(0.0)
               for k in range(radius + 1)}
        norm = raw[0]
        for k in range(1, radius + 1):
            norm = norm + raw[k] * 2.0
        staged = cube.withColumn("_norm", norm).withColumns(
            {f"_k{k}": raw[k] / F.col("_norm") for k in range(radius + 1)})
        taps = [(k, F.col(f"_k{abs(k)}")) for k in range(-radius, radius + 1)]
    else:
        kernel = gaussian_kernel(fwhm)
        radius = len(kernel) // 2
        staged = cube
        taps = [(k - radius, F.lit(v)) for k, v in enumerate(kernel)]
    smooth = _smooth_axis(staged, [*keys, "ix"], "iy", values, taps)
    smooth = _smooth_axis(smooth, [*keys, "iy"], "ix", values, taps)
    return smooth.select(*cube.columns)


def nearest_frequency(freqs: DataFrame, target: float, keys: list[str], freq: str = "freq_hz",
                      index: str = "freq_idx", tolerance: float | None = 1.0e-6) -> DataFrame:
    """Nearest band per key, the lowest index on ties (AGG22).

    With a tolerance (relative to the target) a key without a match fails the query.
    """
    if not math.isfinite(target) or target <= 0.0:
        raise ValueError("the target frequency must be positive and finite")
    gap = F.abs(F.col(freq) - float(target))
    best = freqs.groupBy(*keys).agg(F.min(F.struct(gap.alias("gap"), F.col(index).alias(index),
                                                   F.col(freq).alias(freq))).alias("_b"))
    out = best.select(*keys, F.col(f"_b.{index}").alias(index), F.col(f"_b.{freq}").alias(freq),
                      F.col("_b.gap").alias("_gap"))
    if tolerance is not None:
        good = F.col("_gap") <= tolerance * target
        failed = F.raise_error(F.lit(f"no frequency matches {target:.6e} within tolerance"))
        out = out.withColumn(freq, F.when(good, F.col(freq)).otherwise(failed.cast("double")))
    return out.drop("_gap")


def frequency_slice(cube: DataFrame, target: float, keys: list[str], tolerance: float | None = 1.0e-6,
                    freq: str = "freq_hz") -> DataFrame:
    """The image plane at a frequency (GRD11)."""
    bands = cube.select(*keys, freq).distinct().withColumn("_i", F.col(freq))
    chosen = nearest_frequency(bands, target, keys, freq, "_i", tolerance).select(*keys, freq)
    return cube.join(chosen, [*keys, freq], "left_semi")


def band_slice(cube: DataFrame, start: float, end: float, keys: list[str], freq: str = "freq_hz") -> DataFrame:
    """Planes between the bands nearest to two frequencies, both included (FLT12)."""
    bands = cube.select(*keys, freq).distinct()
    limits = bands.groupBy(*keys).agg(
        F.min(F.struct(F.abs(F.col(freq) - start).alias("g"), F.col(freq).alias("f")))["f"].alias("_lo"),
        F.min(F.struct(F.abs(F.col(freq) - end).alias("g"), F.col(freq).alias("f")))["f"].alias("_hi"))
    if keys:
        joined = cube.join(limits, keys)
    else:
        row = limits.first()
        joined = cube.withColumns({"_lo": F.lit(row["_lo"]), "_hi": F.lit(row["_hi"])})
    return joined.filter(F.col(freq).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def beam_weights(pixels: DataFrame, keys: list[str], center: tuple[float, float],
                 fwhm: Column | float) -> DataFrame:
    """Beam weights normalized to sum 1 per plane, column ``w`` (PRJ33, WIN8).

    The plane sum is an aggregate joined back, so a large plane is never one window.
    """
    raw = pixels.withColumn("_raw", R.beam_profile(F.col("ix"), F.col("iy"), *center, fwhm))
    sums = raw.groupBy(*keys).agg(F.sum("_raw").alias("_sum"))
    if keys:
        joined = raw.join(sums, keys)
    else:
        joined = raw.withColumn("_sum", F.lit(sums.first()["_sum"]))
    good = finite_positive(F.col("_sum"))
    failed = F.raise_error(F.lit("beam weights are numerically invalid")).cast("double")
    return joined.withColumn("w", F.when(good, F.col("_raw") / F.col("_sum")).otherwise(failed)).drop("_raw", "_sum")


def roi_weight(mode: str, center: tuple[float, float] = (0.0, 0.0), radius: float = 1.0, fwhm: Column | float = 1.0) -> Column:
    """Weight of a pixel in a region, the beam not yet normalized: full_image, circular_aperture or gaussian_beam."""
    ix, iy = F.col("ix"), F.col("iy")
    if mode == "full_image":
        return F.lit(1.0)
    if mode == "circular_aperture":
        return F.when(in_circle(ix, iy, *center, radius), 1.0).otherwise(0.0)
    if mode == "gaussian_beam":
        return R.beam_profile(ix, iy, *center, fwhm)
    raise ValueError(f"unsupported region mode: {mode}")


def roi_spectrum(cube: DataFrame, keys: list[str], mode: str, center: tuple[float, float] = (0.0, 0.0),
                 radius: float = 1.0, fwhm: Column | float = 1.0, value: str = "value") -> DataFrame:
    """Spectrum integrated over a region: full_image, circular_aperture or gaussian_beam (FLT9, AGG12).

    The normalized beam needs no join: its sum is a second aggregate of the same pass.
    """
    weight = roi_weight(mode, center, radius, fwhm)
    v = F.col(value)
    if mode == "full_image":
        total = F.sum(v)
    elif mode == "circular_aperture":
        total = F.sum(F.when(weight > 0.0, v).otherwise(0.0))
    else:
        total = F.sum(v * weight) / F.sum(weight)
    return cube.groupBy(*keys).agg(total.alias(value))


def roi_stokes(cube: DataFrame, keys: list[str], regions: dict[str, dict], pixel_area_arcsec2: float, freq: str = "freq_hz",
               i_flux: str = "i_flux", v_flux: str = "v_flux") -> DataFrame:
    """Spectra of I and V over several regions from one aggregate: flux, specific intensity and brightness temperature (AGG12, GRD12).

    ``regions`` maps a name to the arguments of :func:`roi_weight`. Each gives ``<name>_sfu``, ``<name>_specific`` and
    ``<name>_tb`` for I, and the same with ``<name>_v`` for V. The flux of an image or aperture is its sum and the other two are
    means over its pixels; a beam weighs all three to sum 1. A region without pixels has flux 0 and no means; a null flux counts
    as no light. ``freq`` is one of ``keys``.
    """
    if freq not in keys:
        raise ValueError(f"the frequency column {freq} must be one of the keys")
    sums = []
    for n, region in enumerate(regions.values()):
        weight = roi_weight(**region)
        sums.append(F.sum(weight).alias(f"_w{n}"))
        # outside an aperture a pixel plays no part, whatever it holds
        sums += [F.sum(F.when(weight > 0.0, F.coalesce(F.col(flux), F.lit(0.0)) * weight).otherwise(0.0)).alias(f"_{sign}{n}")
                 for sign, flux in (("i", i_flux), ("v", v_flux))]
    totals = cube.groupBy(*keys).agg(*sums)
    out = []
    for n, (name, region) in enumerate(regions.items()):
        for sign, suffix in (("i", ""), ("v", "_v")):
            mean = F.col(f"_{sign}{n}") / F.when(F.col(f"_w{n}") > 0.0, F.col(f"_w{n}"))
            specific = R.flux_to_intensity(mean, pixel_area_arcsec2)
            flux = F.coalesce(mean, F.lit(0.0)) if region["mode"] == "gaussian_beam" else F.col(f"_{sign}{n}")
            out += [flux.alias(f"{name}{suffix}_sfu"), specific.alias(f"{name}{suffix}_specific"),
                    R.intensity_to_tb(specific, F.col(freq)).alias(f"{name}{suffix}_tb")]
    return totals.select(*keys, *out)


def stokes_cube(cube: DataFrame, pixel_area_arcsec2: float, freq: str = "freq_hz", i_flux: str = "i_flux",
                v_flux: str = "v_flux") -> DataFrame:
    """Intensity and brightness temperature of I and V flux cubes (GRD12)."""
    out = {}
    for name, flux in (("i", i_flux), ("v", v_flux)):
        intensity = R.flux_to_intensity(F.col(flux), pixel_area_arcsec2)
        out[f"{name}_specific"] = intensity
        out[f"{name}_tb"] = R.intensity_to_tb(intensity, F.col(freq))
    return cube.withColumns(out)


def plane_stats(cube: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Min, max, sum and mean over finite values, zeros for an empty plane (AGG21)."""
    v = F.when(finite(F.col(value)), F.col(value))
    return cube.groupBy(*keys).agg(*[
        F.coalesce(f(v), F.lit(0.0)).alias(n)
        for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("mean", F.avg))])


def color_limits(cube: DataFrame, keys: list[str], value: str = "value", log: bool = False) -> DataFrame:
    """2 and 99.5 percent limits of finite values, of positive ones in log mode (AGG23)."""
    usable = finite_positive(F.col(value)) if log else finite(F.col(value))
    return exact_percentiles(cube.filter(usable), keys, value, {"vmin": 0.02, "vmax": 0.995})


def symmetric_limit(cube: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """99.5 percent of |value|, at least 1e-12 (AGG23)."""
    sized = cube.filter(finite(F.col(value))).withColumn("_a", F.abs(F.col(value)))
    out = exact_percentiles(sized, keys, "_a", {"limit": 0.995})
    return out.withColumn("limit", F.greatest(F.col("limit"), F.lit(1.0e-12)))


def log_limits(cube: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Maximum and robust minimum (1 percent, at least 1e-5 of the maximum) of positive values (AGG23)."""
    positive = cube.filter(finite_positive(F.col(value)))
    out = exact_percentiles(positive, keys, value, {"p1": 0.01, "vmax": 1.0})
    low = F.greatest(F.col("p1"), F.col("vmax") * 1.0e-5)
    floor = F.greatest(F.col("vmax") * 1.0e-5, F.lit(1.0e-300))
    return out.select(*keys, F.when(low >= F.col("vmax"), floor).otherwise(low).alias("vmin"), "vmax")


def difference_limit(pairs: DataFrame, keys: list[str], base: str, other: str) -> DataFrame:
    """98 percent of the absolute fractional difference, at least 1e-6 (AGG23, PRJ21)."""
    sized = pairs.withColumn("_d", F.abs(fractional_difference(F.col(base), F.col(other)))).filter(finite(F.col("_d")))
    out = exact_percentiles(sized, keys, "_d", {"limit": 0.98})
    return out.withColumn("limit", F.greatest(F.col("limit"), F.lit(1.0e-6)))


# -- masks and background ------------------------------------------------------------------

def background_rms(cube: DataFrame, keys: list[str], ny: int, nx: int,
                   box: tuple[tuple[float, float], tuple[float, float]], factor: float,
                   value: str = "value") -> DataFrame:
    """Population deviation in a fractional box, times a factor (AGG19).

    ``box`` is ((x start, y start), (x end, y end)) in fractions of the image.
    """
    (xs, ys), (xe, ye) = box
    inside = ((F.col("iy") >= int(ny * ys)) & (F.col("iy") < int(ny * ye))
              & (F.col("ix") >= int(nx * xs)) & (F.col("ix") < int(nx * xe)))
    return cube.filter(inside).groupBy(*keys).agg((F.stddev_pop(value) * float(factor)).alias("rms"))


def integrated_excess(cube: DataFrame, rms: DataFrame, freq_keys: list[str], pixel_keys: list[str],
                      value: str = "value") -> DataFrame:
    """Sum over frequency of flux minus rms, per pixel (AGG18)."""
    return (cube.join(rms, freq_keys).groupBy(*pixel_keys)
            .agg(F.sum(F.col(value) - F.col("rms")).alias("excess")))


def selection_mask(excess: DataFrame, threshold: float, x_range: tuple[int, int],
                   y_range: tuple[int, int]) -> DataFrame:
    """Masked where outside the field of view or at or below the threshold (FLT13).

    ``masked`` is True for excluded pixels. A negative threshold disables the flux test.
    """
    outside = ~((F.col("ix") >= x_range[0]) & (F.col("ix") < x_range[1])
                & (F.col("iy") >= y_range[0]) & (F.col("iy") < y_range[1]))
    faint = F.col("excess") <= threshold if threshold >= 0.0 else F.lit(False)
    return excess.withColumns({"fov_masked": outside, "masked": outside | faint})


def mask_box(mask: DataFrame, margin: int, ny: int, nx: int, keys: list[str]) -> DataFrame:
    """Bounding box of the field of view grown by a margin and clipped to the map (FLT13)."""
    inside = mask.filter(~F.col("fov_masked"))
    return inside.groupBy(*keys).agg(
        F.greatest(F.min("iy") - margin, F.lit(0)).alias("min_y"),
        F.least(F.max("iy") + margin, F.lit(ny)).alias("max_y"),
        F.greatest(F.min("ix") - margin, F.lit(0)).alias("min_x"),
        F.least(F.max("ix") + margin, F.lit(nx)).alias("max_x"))


def peak(cube: DataFrame, pixel_keys: list[str], freq: str = "freq_hz", value: str = "value") -> DataFrame:
    """Peak flux and the lowest frequency that reaches it, per pixel (AGG24)."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(freq)).alias("f")))
    return cube.groupBy(*pixel_keys).agg(best.alias("_p")).select(
        *pixel_keys, F.col("_p.v").alias("peak_flux"), (-F.col("_p.f")).alias("peak_freq"))


def calibration(weight_map: DataFrame, keys: list[str], volume_cm3: float, target_density: float,
                weight: str = "weight") -> DataFrame:
    """Particles per weight so that the densest pixel reaches a target (AGG25); an empty map fails."""
    top = weight_map.groupBy(*keys).agg(F.max(weight).alias("_max"))
    failed = F.raise_error(F.lit("cannot calibrate from an empty weight map")).cast("double")
    return top.select(*keys, F.when(F.col("_max") > 0.0, F.lit(target_density * volume_cm3) / F.col("_max"))
                      .otherwise(failed).alias("per_weight"))


# -- bands and cubes ---------------------------------------------------------------------------

def band_spacing(bands: DataFrame, keys: list[str], freq: str = "freq_hz", index: str = "freq_idx") -> DataFrame:
    """Mean of frequency step over index step between stored bands (AGG32)."""
    w = W.partitionBy(*keys).orderBy(freq)
    steps = bands.withColumn("_s", (F.col(freq) - F.lag(freq).over(w))
                             / (F.col(index) - F.lag(index).over(w)))
    return steps.groupBy(*keys).agg(F.avg("_s").alias("band_step"))


def order_bands(bands: DataFrame, keys: list[str], freq: str = "freq_hz", out: str = "band") -> DataFrame:
    """Rank bands by frequency, from 0 (SRT4); the band list is distinct before ranking."""
    w = W.partitionBy(*keys).orderBy(freq)
    distinct = bands.select(*keys, freq).distinct()
    return distinct.withColumn(out, F.row_number().over(w) - 1)


def union_frequencies(*lists: DataFrame, freq: str = "freq_hz") -> DataFrame:
    """Sorted distinct union of frequency lists (SET2)."""
    union = lists[0].select(freq)
    for other in lists[1:]:
        union = union.unionByName(other.select(freq))
    return union.distinct().orderBy(freq)


def frequency_axis(header: DataFrame, explicit: DataFrame | None, keys: list[str], bands: int) -> DataFrame:
    """Band frequencies from the header, replaced by an explicit table where one exists (SRC17).

    ``header`` has crval and cdelt per key, ``explicit`` (keys, freq_idx, freq).
    """
    linear = header.withColumn("freq_idx", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).withColumn(
        "_linear", F.col("crval") + F.col("cdelt") * F.col("freq_idx"))
    if explicit is None:
        return linear.select(*keys, "freq_idx", F.col("_linear").alias("freq_hz"))
    given = explicit.select(*keys, "freq_idx", F.col("freq").alias("_given"))
    return linear.join(given, [*keys, "freq_idx"], "left").select(
        *keys, "freq_idx", F.coalesce("_given", "_linear").alias("freq_hz"))


def stack_images(images: DataFrame, keys: list[str], bands: int, ny: int, nx: int,
                 value: str = "value") -> DataFrame:
    """Per-band images to one cube, bands in frequency order, missing pixels and bands 0 (SET4).

    ``images`` has keys, freq_hz, iy, ix, value. Bands missing at the end of the list are
    filled like missing pixels.
    """
    ranked = images.join(order_bands(images, keys), [*keys, "freq_hz"])
    summed = ranked.groupBy(*keys, "band", "iy", "ix").agg(F.max(value).alias(value))
    return densify(summed, images, keys, {"band": bands, "iy": ny, "ix": nx}, {value: 0.0})


def to_rows(cubes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Nested [freq][y][x] arrays to long rows (ARR1)."""
    planes = cubes.select(*keys, F.posexplode(column).alias("freq_idx", "_plane"))
    lines = planes.select(*keys, "freq_idx", F.posexplode("_plane").alias("iy", "_line"))
    return lines.select(*keys, "freq_idx", "iy", F.posexplode("_line").alias("ix", "value"))


def to_spectra(cube: DataFrame, pixel_keys: list[str], index: str = "freq_idx", value: str = "value") -> DataFrame:
    """Long rows to one spectrum array per pixel, in index order (ARR1).

    Repeated values of one (pixel, index) are averaged first, so an array is never longer
    than the frequency list.
    """
    once = cube.groupBy(*pixel_keys, index).agg(F.avg(value).alias(value))
    packed = F.array_sort(F.collect_list(F.struct(index, value)))
    return once.groupBy(*pixel_keys).agg(packed.getField(value).alias("spectrum"))


def parameter_maps(fits: DataFrame, pixels: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Named parameter and error maps on the whole pixel grid, missing fits 0 (JON14, SET5).

    Works for any number of frames at once; ``keys`` are frame and pixel columns.
    """
    joined = pixels.select(*keys).join(fits.select(*keys, "params", "errors"), keys, "left")
    out = []
    for k, name in enumerate(names):
        out.append(F.coalesce(F.get("params", F.lit(k)), F.lit(0.0)).alias(name))
        out.append(F.coalesce(F.get("errors", F.lit(k)), F.lit(0.0)).alias(f"err_{name}"))
    return joined.select(*keys, *out)
