"""Flux, intensity, brightness temperature, beams and fit-derived energies."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions.numeric import finite

SIGMA_PER_FWHM = 1.0 / math.sqrt(8.0 * math.log(2.0))


def flux_to_intensity(flux_sfu: Column, pixel_area_arcsec2: float) -> Column:
    """Flux per pixel in sfu to specific intensity (PRJ11)."""
    return flux_sfu * (C.SFU / (pixel_area_arcsec2 * C.ARCSEC * C.ARCSEC))


def _checked_frequency(frequency_hz: Column) -> Column:
    good = finite(frequency_hz) & (frequency_hz > 0.0)
    failed = F.raise_error(F.lit("frequency_hz must be positive and finite")).cast("double")
    return F.when(good, frequency_hz).otherwise(failed)


def intensity_to_tb(intensity: Column, frequency_hz: Column) -> Column:
    """Specific intensity to brightness temperature, Rayleigh-Jeans (PRJ12)."""
    nu = _checked_frequency(frequency_hz)
    return intensity * (C.SPEED_OF_LIGHT ** 2 / (2.0 * C.BOLTZMANN)) / (nu * nu)


def tb_to_intensity(temperature: Column, frequency_hz: Column) -> Column:
    """Brightness temperature to specific intensity (PRJ12)."""
    nu = _checked_frequency(frequency_hz)
    return temperature * (2.0 * C.BOLTZMANN / C.SPEED_OF_LIGHT ** 2) * (nu * nu)


def flux_tb(value: Column, frequency_hz: Column, area_arcsec2: float,
            reverse: bool = False) -> Column:
    """sfu to K for a source of known area, or back with ``reverse`` (PRJ13)."""
    solid_angle = area_arcsec2 * C.ARCSEC ** 2
    nu = _checked_frequency(frequency_hz)
    kelvin_per_sfu = C.SFU * C.SPEED_OF_LIGHT ** 2 / (2.0 * C.BOLTZMANN * solid_angle)
    return value * (nu * nu) / kelvin_per_sfu if reverse else value * kelvin_per_sfu / (nu * nu)


def voxel_volume_cm3(pixel_arcsec: float, depth_arcsec: float) -> float:
    """Volume of one image voxel at 1 au (PRJ14)."""
    cm = C.ASTRONOMICAL_UNIT * C.ARCSEC
    return pixel_arcsec * pixel_arcsec * depth_arcsec * cm ** 3


def weight_to_density(weight: Column, per_weight: Column | float, pixel_arcsec: float,
                      depth_arcsec: float) -> Column:
    """Deposited weight to number density (PRJ15)."""
    return weight * per_weight / voxel_volume_cm3(pixel_arcsec, depth_arcsec)


def polarization(left: Column, right: Column) -> dict[str, Column]:
    """Stokes-like sums; circular is right minus left, the degree is 0 where I is 0 (PRJ22)."""
    total, circular = left + right, right - left
    return {
        "total": total,
        "circular": circular,
        "degree": F.when(F.abs(total) > 0.0, circular / total).otherwise(0.0),
    }


def beam_fwhm(base_fwhm: float, frequency: Column, reference: float,
              scaled: bool = True) -> Column:
    """Beam width in pixels, inversely proportional to frequency when scaled (PRJ32)."""
    if not scaled:
        return F.lit(float(base_fwhm))
    good = (frequency > 0.0) & F.lit(reference > 0.0)
    failed = F.raise_error(F.lit("beam frequencies must be positive")).cast("double")
    return F.when(good, F.lit(float(base_fwhm) * float(reference)) / frequency).otherwise(failed)


def beam_profile(ix: Column, iy: Column, center_x: float, center_y: float,
                 fwhm: Column | float) -> Column:
    """Unnormalized Gaussian beam value at a pixel (PRJ33)."""
    sigma = (fwhm if isinstance(fwhm, Column) else F.lit(float(fwhm))) * SIGMA_PER_FWHM
    dx, dy = ix - float(center_x), iy - float(center_y)
    return F.exp((dx * dx + dy * dy) * -0.5 / (sigma * sigma))


def wcs_extent(crval1, cdelt1, crpix1, naxis1, crval2, cdelt2, crpix2, naxis2) -> dict[str, Column]:
    """Image extent from the linear WCS keywords (PRJ37)."""
    left = crval1 - (crpix1 - 1) * cdelt1
    bottom = crval2 - (crpix2 - 1) * cdelt2
    return {"x_left": left, "x_right": left + naxis1 * cdelt1,
            "y_bottom": bottom, "y_top": bottom + naxis2 * cdelt2}


def band_bounds(freq_hz: Column, width_hz: Column) -> dict[str, Column]:
    """Band limits in GHz from centre and width (PRJ38)."""
    center, half = freq_hz / 1.0e9, width_hz / 1.0e9 / 2.0
    return {"center_ghz": center, "lo_ghz": center - half, "hi_ghz": center + half}


def fit_energies(params: Column, errors: Column, area_arcsec2: float, depth_arcsec: float,
                 emin_mev: float) -> dict[str, Column]:
    """Magnetic and nonthermal energy of a fitted pixel with propagated errors (PRJ42).

    Order of the fit parameters: 0 nonthermal density, 1 field strength, 4 index.
    An index of exactly 2 has no finite nonthermal energy and gives NULL.
    """
    volume = area_arcsec2 * depth_arcsec * C.FIT_ARCSEC_CM ** 3
    n, b, delta = F.get(params, 0), F.get(params, 1), F.get(params, 4)
    en, eb, ed = F.get(errors, 0), F.get(errors, 1), F.get(errors, 4)
    scale = volume * C.FIT_KEV_ERG * emin_mev * 1.0e3
    usable = delta != 2.0
    gap = F.when(usable, delta - 2.0)
    slope = (delta - 1.0) / gap
    first = ed * ed * en * en / (gap * gap * gap * gap)
    second = slope * en
    return {
        "wb": b * b * (volume / (8.0 * math.pi)),
        "wb_err": b * eb * (2.0 * volume / (8.0 * math.pi)),
        "wnth": slope * n * scale,
        "wnth_err": F.sqrt(first + second * second) * scale,
    }


def flux_uncertainty(rms: Column, factor: float, freq_ghz: Column) -> Column:
    """Measurement error: rms plus a part falling with frequency (PRJ43)."""
    return rms + rms * float(factor) / freq_ghz


def power_law_weight(lo: Column, hi: Column, delta: Column) -> Column:
    """Integral of E^-delta over a bin, logarithmic when delta is close to 1 (PRJ45)."""
    # Closeness limits 1e-8 absolute and 1e-5 relative.
    is_one = F.abs(delta - 1.0) <= 1.0e-8 + 1.0e-5
    exponent = F.when(is_one, F.lit(1.0)).otherwise(1.0 - delta)
    integral = F.abs((F.pow(hi, exponent) - F.pow(lo, exponent)) / exponent)
    return F.when(is_one, F.log(hi / lo)).otherwise(integral)
