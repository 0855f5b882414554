"""Batch spectral fit: background, threshold mask, one fit per selected pixel, parameter maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.functions.radiometry import flux_uncertainty
from fieldframe.operators import fit, image
from fieldframe.session import materialize

PIXEL = ["frame", "iy", "ix"]


@dataclass(frozen=True)
class FitConfig:
    """Selection and error settings of a batch fit."""

    ny: int
    nx: int
    start_hz: float
    end_hz: float
    x_range: tuple[int, int]
    y_range: tuple[int, int]
    box: tuple[tuple[float, float], tuple[float, float]] = ((0.75, 0.75), (0.95, 0.95))
    rms_factor: float = 4.0
    threshold_sfu: float = 0.0


def observed_spectra(cube: DataFrame, config: FitConfig) -> DataFrame:
    """Selected pixels as (frame, iy, ix, freq, obs, err) inside the fitted band range."""
    freq_keys = ["frame", "freq_hz"]
    # one number per frame and band, used twice and small enough to leave the cube in place
    rms = materialize(image.background_rms(cube, freq_keys, config.ny, config.nx, config.box, config.rms_factor), "rms")
    excess = image.integrated_excess(cube, rms, freq_keys, PIXEL)
    mask = image.selection_mask(excess, config.threshold_sfu, config.x_range, config.y_range)
    chosen = mask.filter(~F.col("masked")).select(*PIXEL)
    banded = image.band_slice(cube, config.start_hz, config.end_hz, ["frame"])
    joined = banded.join(chosen, PIXEL).join(rms, freq_keys)
    ghz = F.col("freq_hz") / 1.0e9
    return joined.select(*PIXEL, ghz.alias("freq"), F.col("value").alias("obs"),
                         flux_uncertainty(F.col("rms"), config.rms_factor, ghz).alias("err"))


def fit_maps(cube: DataFrame, config: FitConfig, names: list[str],
             solver: fit.Solver | None = None) -> DataFrame:
    """Parameter and error maps of every frame, zeros where no pixel was fitted."""
    fits = fit.fit_spectra(observed_spectra(cube, config), PIXEL, solver)
    return image.parameter_maps(fits, cube.select(*PIXEL).distinct(), PIXEL, names)
