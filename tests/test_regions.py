import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions.radiometry import SIGMA_PER_FWHM
from fieldframe.operators import compare, image

KEYS = ["frame", "freq_hz"]


def _cube(spark, planes):
    rows = [(f, freq, iy, ix, float(i[iy][ix]), float(v[iy][ix]))
            for (f, freq), (i, v) in planes.items() for iy in range(i.shape[0]) for ix in range(i.shape[1])]
    return spark.createDataFrame(rows, "frame int, freq_hz double, iy int, ix int, i_flux double, v_flux double")


def test_region_spectra_of_i_and_v(spark):
    random = np.random.default_rng(4)
    planes = {(f, freq): (random.random((5, 7)), random.random((5, 7)) - 0.5) for f in (0, 1) for freq in (1.0e9, 4.0e9)}
    center, radius, fwhm, area = (3.0, 2.0), 1.5, 2.0, 4.0
    out = image.roi_stokes(_cube(spark, planes), KEYS, {
        "all": {"mode": "full_image"}, "disk": {"mode": "circular_aperture", "center": center, "radius": radius},
        "beam": {"mode": "gaussian_beam", "center": center, "fwhm": fwhm}}, area)
    iy, ix = np.mgrid[0:5, 0:7]
    r2 = (ix - center[0]) ** 2 + (iy - center[1]) ** 2
    beam = np.exp(-0.5 * r2 / (fwhm * SIGMA_PER_FWHM) ** 2)
    weights = {"all": np.ones((5, 7)), "disk": (r2 <= radius ** 2).astype(float), "beam": beam / beam.sum()}
    rows = out.collect()
    assert len(rows) == 4
    for row in rows:
        for plane, sign in zip(planes[row["frame"], row["freq_hz"]], ("", "_v")):
            for name, w in weights.items():
                flux = (plane * w).sum()
                mean = flux / w.sum() * C.SFU / (area * C.ARCSEC ** 2)
                kelvin = mean * C.SPEED_OF_LIGHT ** 2 / (2 * C.BOLTZMANN * row["freq_hz"] ** 2)
                got = [row[f"{name}{sign}_{kind}"] for kind in ("sfu", "specific", "tb")]
                assert got == pytest.approx([flux, mean, kelvin], rel=1e-9, abs=1e-25)


def test_region_without_pixels_and_null_flux(spark):
    cube = spark.createDataFrame([(0, 1.0e9, 0, 0, None, 1.0), (0, 1.0e9, 0, 1, 2.0, math.nan)],
                                 "frame int, freq_hz double, iy int, ix int, i_flux double, v_flux double")
    row = image.roi_stokes(cube, KEYS, {"far": {"mode": "circular_aperture", "center": (50.0, 50.0), "radius": 1.0},
                                        "left": {"mode": "circular_aperture", "center": (0.0, 0.0), "radius": 0.5}}, 1.0).first()
    assert (row["far_sfu"], row["far_specific"], row["far_tb"]) == (0.0, None, None)
    # a NaN outside the aperture does not reach its sum
    assert (row["left_sfu"], row["left_v_sfu"]) == (0.0, 1.0)
    assert image.roi_stokes(cube.limit(0), KEYS, {"far": {"mode": "full_image"}}, 1.0).count() == 0
    with pytest.raises(ValueError):
        image.roi_stokes(cube, ["frame"], {"far": {"mode": "full_image"}}, 1.0)
    with pytest.raises(ValueError):
        image.roi_stokes(cube, KEYS, {"far": {"mode": "square"}}, 1.0)


def test_summary_in_one_pass_agrees_with_separate_spectra(spark):
    rows = [(f, iy, ix, t, c) for f in (0, 1) for iy in range(3) for ix in range(4)
            for t, c in [((iy * 4 + ix) * 0.5 - 1.0, (iy * 4 + ix) * 0.6 - 0.9)]]
    rows += [(0, 3, 0, None, 2.0), (1, 3, 1, math.nan, 1.0), (2, 0, 0, 0.0, 0.0), (1, 3, 2, 3.0, None)]
    pairs = spark.createDataFrame(rows, "frame int, iy int, ix int, truth double, candidate double")
    fits = spark.createDataFrame([(f, True, 3.0, 0.9) for f in (0, 1, 2)], "frame int, accepted boolean, global_delta double, global_r2 double")
    spectra = pairs.groupBy("frame", "ix").agg(F.sum("truth").alias("truth"), F.sum("candidate").alias("candidate"))
    apart = {r["frame"]: r.asDict() for r in compare.validation_summary(fits, pairs, spectra, ["frame"]).collect()}
    once = {r["frame"]: r.asDict() for r in compare.validation_summary(fits, pairs, ["ix"], ["frame"]).collect()}
    assert set(once) == {0, 1, 2}
    for frame, row in apart.items():
        assert set(row) == set(once[frame])
        for name, value in row.items():
            assert once[frame][name] == pytest.approx(value, rel=1e-12, nan_ok=True), name
