"""Particles and field to image cubes, for all frames in one job.

The chain: deposit, coarse field, density, per-cell power law, parameter keys, one model
evaluation per key, Stokes columns, beam and region spectra. The radiation model is a
function of the caller; it sees one row per distinct parameter key.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions import radiometry as R
from fieldframe.functions.axes import Axis, fixed_edge_index, log_edge_index
from fieldframe.functions.geometry import magnitude
from fieldframe.functions.numeric import clip, rescale
from fieldframe.functions.predicates import active_above
from fieldframe.functions.radiometry import voxel_volume_cm3
from fieldframe.operators import binning, fit, image, memo
from fieldframe.operators.blocks import row_numbers
from fieldframe.operators.compare import movie_index
from fieldframe.session import materialize

CELL = ["frame", "iy", "ix"]
PARAMETERS = ["nonthermal_density_1e7", "magnetic_field_100g", "thermal_density_1e9", "power_law_index",
              "temperature_mk", "los_depth_arcsec"]
KEYS = ["k_nonthermal", "k_field", "k_index", "k_thermal", "k_temperature"]

#: Adds the array columns ``left`` and ``right`` (sfu per frequency) to the parameter rows.
Model = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class EmissionConfig:
    """Settings of an image synthesis."""

    x_axis: Axis
    y_axis: Axis
    frequencies_ghz: tuple[float, ...]
    nx: int = 64
    ny: int = 64
    pixel_arcsec: float = 2.0
    depth_arcsec: float = 8.0
    minimum_energy_ev: float = 0.0
    energy_bins: int = 12
    energy_edges: tuple[float, ...] | None = None
    target_density_cm3: float = 3.0e7
    per_weight: float | None = None
    field_floor_gauss: float = 50.0
    field_peak_gauss: float = 400.0
    thermal_density_cm3: float = 1.0e9
    temperature_mk: float = 2.0
    default_index: float = 4.0
    index_bounds: tuple[float, float] = (2.0, 8.0)
    minimum_bins: int = 4
    minimum_r2: float = 0.5
    beam_fwhm_pixels: float = 3.0
    aperture_radius_pixels: float = 5.0
    levels: dict[str, int] = field(default_factory=lambda: dict.fromkeys(KEYS, 8))

    @property
    def image_axes(self) -> tuple[Axis, Axis]:
        x, y = self.x_axis, self.y_axis
        return Axis.uniform(x.lower, x.upper, self.nx), Axis.uniform(y.lower, y.upper, self.ny)


def particle_maps(particles: DataFrame, config: EmissionConfig) -> tuple[DataFrame, DataFrame]:
    """Dense weight map and cell-energy histogram from one pass over the particles.

    One aggregate holds what both need: the closed-edge cell, whether a row lies on an upper
    edge (which the deposit keeps and the histogram drops) and the energy bin, NULL outside.
    It is as small as cells times bins and is written once. Only data-driven energy edges
    need a pass of their own for the extremes.
    """
    x, y = config.image_axes
    e = F.col("energy_ev")
    active = particles.filter(active_above(F.col("status"), e, config.minimum_energy_ev)
                              & x.contains(F.col("x")) & y.contains(F.col("y")))
    if config.energy_edges is not None:
        fixed = [float(v) for v in config.energy_edges]
        energy_bin = F.when((e >= fixed[0]) & (e < fixed[-1]), fixed_edge_index(fixed, e))
        edges = F.array(*[F.lit(v) for v in fixed])
    else:
        edges_by_frame = materialize(binning.energy_edges(particles, config.energy_bins), "energy-edges")
        active = active.join(edges_by_frame, "frame")
        edges = F.col("edges")
        inside = (e >= F.get(edges, F.lit(0))) & (e < F.element_at(edges, -1))
        energy_bin = F.when(inside, log_edge_index(edges, e))
    binned = active.select(
        "frame", y.histogram_index(F.col("y")).alias("iy"), x.histogram_index(F.col("x")).alias("ix"),
        ((F.col("x") == x.upper) | (F.col("y") == y.upper)).alias("on_top"), energy_bin.alias("ie"), "weight",
        F.get(edges, energy_bin).alias("lo"), F.get(edges, energy_bin + 1).alias("hi"))
    base = materialize(binned.groupBy("frame", "iy", "ix", "on_top", "ie", "lo", "hi").agg(
        F.sum("weight").alias("weight")), "particle-maps")
    sums = base.groupBy(*CELL).agg(F.sum("weight").alias("weight"))
    weight = binning.densify(sums, base, ["frame"], {"iy": config.ny, "ix": config.nx}, {"weight": 0.0})
    hist = base.filter(~F.col("on_top") & F.col("ie").isNotNull()).drop("on_top")
    return weight, hist


def cell_table(particles: DataFrame, field_table: DataFrame, config: EmissionConfig,
               background: DataFrame | None = None) -> DataFrame:
    """One row per (frame, cell) with weight, densities, field, temperature and index.

    ``particles``: frame, x, y, weight, status, energy_ev. ``field_table``: frame, ix, iy,
    bx, by, bz on the native axes. ``background``: frame, ix, iy, thermal_density_cm3,
    temperature_mk on the native axes; constants of the config otherwise.
    """
    weight, hist = particle_maps(particles, config)
    bmag = field_table.withColumn("bmag", magnitude([F.col(c) for c in ("bx", "by", "bz")]))
    # as small as the image; the extremes and the cells read it back, the native field is averaged once
    coarse = materialize(binning.coarse_average(bmag, config.x_axis, config.y_axis, config.nx, config.ny, ["bmag"]), "coarse-field")
    ends = coarse.groupBy("frame").agg(F.min("bmag").alias("_lo"), F.max("bmag").alias("_hi"))
    gauss = coarse.join(ends, "frame").select(*CELL, rescale(
        F.col("bmag"), F.col("_lo"), F.col("_hi"), config.field_floor_gauss, config.field_peak_gauss)
        .alias("magnetic_field_gauss"))
    index = fit.power_law_map(hist, ["frame"], config.ny, config.nx, config.default_index,
                              minimum_bins=config.minimum_bins, bounds=config.index_bounds,
                              minimum_r2=config.minimum_r2)

    if background is None:
        thermal = memo.constant_provider(thermal_density_cm3=config.thermal_density_cm3,
                                         temperature_mk=config.temperature_mk)(weight.select(*CELL))
    else:
        thermal = binning.coarse_average(background, config.x_axis, config.y_axis, config.nx, config.ny,
                                         ["thermal_density_cm3", "temperature_mk"])
    cells = memo.assemble_cells(CELL, weight, gauss, index.select(*CELL, F.col("delta").alias("power_law_index"),
                                                                  "r2", "accepted"), thermal)
    volume = voxel_volume_cm3(config.pixel_arcsec, config.depth_arcsec)
    if config.per_weight is not None:
        cells = cells.withColumn("per_weight", F.lit(float(config.per_weight)))
    else:
        occupied = weight.filter(F.col("weight") > 0.0)
        cells = cells.join(image.calibration(occupied, ["frame"], volume, config.target_density_cm3), "frame")
    return cells.withColumn("nonthermal_density_cm3", F.col("weight") * F.col("per_weight") / volume)


def keyed_cells(cells: DataFrame, config: EmissionConfig) -> DataFrame:
    """Cells with model parameters and their quantized keys."""
    occupied = F.col("weight") > 0.0
    lo, hi = config.index_bounds
    out = memo.normalized(cells, ["magnetic_field_gauss", "thermal_density_cm3", "temperature_mk"],
                          of_peak={"nonthermal_density_cm3": occupied})
    index = (clip(F.col("power_law_index"), lo, hi) - lo) / max(hi - lo, 1.0e-12)
    sources = dict(zip(KEYS, (F.col("nonthermal_density_cm3_norm"), F.col("magnetic_field_gauss_norm"), index,
                              F.col("thermal_density_cm3_norm"), F.col("temperature_mk_norm"))))
    out = memo.quantize_keys(out, {k: (v, config.levels[k]) for k, v in sources.items()})
    return out.withColumns({
        "nonthermal_density_1e7": F.col("nonthermal_density_cm3") / 1.0e7,
        "magnetic_field_100g": F.col("magnetic_field_gauss") / 100.0,
        "thermal_density_1e9": F.col("thermal_density_cm3") / 1.0e9,
        "los_depth_arcsec": F.lit(float(config.depth_arcsec))})


#: Array outputs that :func:`reference_spectra` adds, each as total flux and, with the suffix, as circular flux.
VARIANTS = ("thermal_only", "no_razin_density_proxy", "optically_thin_proxy")
IMPACTS = {"absorption_impact": "optically_thin_proxy", "razin_impact": "no_razin_density_proxy"}
CIRCULAR = "_circular"
REFERENCES = tuple(n + c for n in (*VARIANTS, "background_only", *IMPACTS) for c in ("", CIRCULAR))


def reference_spectra(model: Model) -> Model:
    """Model wrapper that also evaluates the reference variants and their differences.

    All variants of all representatives go through the model in one call, and one aggregate brings those of a key
    together. Adds the arrays of ``REFERENCES``: variants, ``background_only`` (zeros), and the impacts, variant less full.
    """
    def run(representatives: DataFrame) -> DataFrame:
        keys = [c for c in representatives.columns if c not in PARAMETERS]
        rows = model(memo.reference_variants(representatives))
        spectra = F.struct(*[memo.array_scale(F.col(s), F.col("rescale")).alias(s) for s in ("left", "right")])
        once = rows.withColumn("_s", spectra).groupBy(*keys).agg(
            *[F.max(F.when(F.col("variant") == n, F.col("_s"))).alias(f"_{n}") for n in ("full", *VARIANTS)])
        out = {s: F.col(f"_full.{s}") for s in ("left", "right")}
        for n in ("full", *VARIANTS):
            left, right = F.col(f"_{n}.left"), F.col(f"_{n}.right")
            out |= {n: F.zip_with(left, right, lambda a, b: a + b), n + CIRCULAR: memo.array_subtract(right, left)}
        whole = once.withColumns(out)
        for c in ("", CIRCULAR):
            whole = whole.withColumn("background_only" + c, memo.array_zero(F.col("left")))
            for impact, variant in IMPACTS.items():
                whole = whole.withColumn(impact + c, memo.array_subtract(F.col(variant + c), F.col("full" + c)))
        return whole.drop("full", "full" + CIRCULAR, *[f"_{n}" for n in ("full", *VARIANTS)])
    return run


def image_cube(cells: DataFrame, model: Model, config: EmissionConfig,
               extra: tuple[str, ...] = ()) -> DataFrame:
    """Dense cube (frame, freq_hz, iy, ix) of left, right, total and circular flux.

    ``extra`` names further array outputs of the model, see ``reference_spectra``. The keyed cells are written
    once: the dense grid, the representatives and the join back read them.
    """
    keyed = materialize(keyed_cells(cells, config), "keyed-cells")
    arrays = ["left", "right", *extra]
    evaluated = memo.evaluate_once(
        keyed.filter(F.col("weight") > 0.0), KEYS, PARAMETERS, [F.col("iy"), F.col("ix")], model, arrays,
        ("frame",)).select(*CELL, *arrays)
    freqs = F.array(*[F.lit(f * 1.0e9) for f in config.frequencies_ghz])
    zeros = F.array_repeat(F.lit(0.0), len(config.frequencies_ghz))
    dense = keyed.select(*CELL).join(evaluated, CELL, "left").select(
        *CELL, *[F.coalesce(a, zeros).alias(a) for a in arrays])
    rows = dense.select(*CELL, *arrays, F.posexplode(freqs).alias("_k", "freq_hz"))
    flat = rows.select("frame", "freq_hz", "iy", "ix", *[F.get(a, F.col("_k")).alias(a) for a in arrays])
    return flat.withColumns({"i_flux": F.col("left") + F.col("right"), "v_flux": F.col("right") - F.col("left")})


def pixel_grid(spark: SparkSession, config: EmissionConfig) -> DataFrame:
    """Image cells with the centres of their pixels on the native axes."""
    x, y = config.image_axes
    cells = spark.range(config.nx * config.ny).select(
        F.floor(F.col("id") / config.nx).cast("int").alias("iy"), (F.col("id") % config.nx).cast("int").alias("ix"))
    return cells.withColumns({"x": x.center(F.col("ix")), "y": y.center(F.col("iy"))})


def diagnostics(cells: DataFrame) -> DataFrame:
    """Per frame: cells, occupied cells, accepted fits, range of indices and largest density."""
    occupied = F.col("weight") > 0.0
    index = F.when(occupied, F.col("power_law_index"))
    return cells.groupBy("frame").agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(occupied, 1)).alias("occupied_cells"),
        F.count(F.when(F.col("accepted"), 1)).alias("accepted_fits"), F.min(index).alias("index_min"), F.max(index).alias("index_max"),
        F.max("nonthermal_density_cm3").alias("peak_density_cm3"))


def run_emission(particles: DataFrame, field_table: DataFrame, model: Model, config: EmissionConfig,
                 background: DataFrame | None = None, references: bool = False) -> dict[str, DataFrame]:
    """All product tables (SNK9 payload): cells, cube, beam, roi, grid, calibration, diagnostics, config and meta.

    ``references`` adds the reference spectra of the full image, from the same evaluation of the model. Cells and cube feed
    several tables, so both are written to the scratch folder and read
    back: particles and model are evaluated once, whatever is used later.
    """
    spark = particles.sparkSession
    cells = materialize(cell_table(particles, field_table, config, background), "cells")
    extra = REFERENCES if references else ()
    cube = materialize(image_cube(cells, reference_spectra(model) if references else model, config, extra), "cube")
    area = config.pixel_arcsec ** 2
    keys = ["frame", "freq_hz"]
    slim = cube.select(*keys, "iy", "ix", "i_flux", "v_flux")
    beam = image.beam_convolve(slim, keys, ["i_flux", "v_flux"], config.beam_fwhm_pixels)
    center = ((config.nx - 1.0) / 2.0, (config.ny - 1.0) / 2.0)
    roi = image.roi_stokes(slim, keys, {
        "full_image": {"mode": "full_image"},
        "aperture": {"mode": "circular_aperture", "center": center, "radius": config.aperture_radius_pixels},
        "beam_center": {"mode": "gaussian_beam", "center": center, "fwhm": config.beam_fwhm_pixels}}, area)
    meta = cells.select("frame").distinct().withColumns({
        "transport_model": F.lit("parker"), "field_source_kind": F.lit("table"),
        "background_source_kind": F.lit("constant" if background is None else "table"),
        "coordinate_unit": F.lit("code_length"),
        "specific_intensity_unit": F.lit(C.UNIT_TOKENS[1][1]), "brightness_temperature_unit": F.lit("K")})
    calibration = cells.groupBy("frame").agg(F.max("per_weight").alias("per_weight")).withColumns({
        "target_density_cm3": F.lit(config.target_density_cm3), "voxel_volume_cm3": F.lit(voxel_volume_cm3(config.pixel_arcsec, config.depth_arcsec))})
    settings = spark.createDataFrame([(k, json.dumps(v)) for k, v in asdict(config).items() if k not in ("x_axis", "y_axis")], "name string, value string")
    stokes = cube.drop(*REFERENCES)
    tables = {"cells": cells, "cube": image.stokes_cube(stokes, area), "beam": image.stokes_cube(beam, area), "roi": roi, "meta": meta,
              "grid": pixel_grid(spark, config), "calibration": calibration, "diagnostics": diagnostics(cells), "config": settings}
    if references:
        tables["references"] = cube.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in REFERENCES])
    return tables


def movie_frames(particles: DataFrame, roi: DataFrame, config: EmissionConfig, threshold_ev: float,
                 calibration: DataFrame | None = None, energy_source: str | None = None) -> DataFrame:
    """Per-frame movie index with weights around a threshold and the spectrum peak (SNK5).

    ``sequence_index`` numbers the frames from 0. ``calibration`` adds the per-weight factor that each frame suggests.
    """
    x, y = config.image_axes
    inside: Column = ((F.col("status") == C.STATUS_ACTIVE) & x.contains(F.col("x")) & y.contains(F.col("y")))
    spectra = roi.select("frame", F.col("full_image_sfu").alias("value"))
    index = materialize(movie_index(particles.filter(inside), threshold_ev, ["frame"], spectra), "movie-index")
    out = row_numbers(index, [], ["frame"], "_n").withColumn("sequence_index", F.col("_n") - 1).drop("_n")
    if energy_source is not None:
        out = out.withColumn("energy_source", F.lit(energy_source))
    if calibration is not None:
        out = out.join(calibration.select("frame", F.col("per_weight").alias("suggested_per_weight")), "frame", "left")
    return out
