import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.functions.axes import Axis
from fieldframe.operators import binning
from fieldframe.plans import emission, spectral_fit

X, Y = Axis.uniform(0.0, 8.0, 8), Axis.uniform(0.0, 4.0, 4)


@pytest.fixture(scope="module")
def inputs(spark):
    r = np.random.default_rng(11)
    n = 4000
    rows = [(int(f), int(s), float(x), float(y), float(w), float(e)) for f, s, x, y, w, e in zip(
        r.integers(0, 2, n), r.integers(0, 2, n), r.choice([0.0, 8.0, 3.3, 5.1, 7.9, -1.0], n) + r.choice([0.0, 0.05], n), r.uniform(0, 4, n),
        r.integers(1, 5, n), 10 ** r.uniform(3, 5, n))]
    particles = spark.createDataFrame(rows, "frame int, status int, x double, y double, weight double, energy_ev double")
    cells = spark.range(64).select((F.col("id") / 32).cast("int").alias("frame"), (F.col("id") % 8).cast("int").alias("ix"),
                                   ((F.col("id") % 32) / 8).cast("int").alias("iy"), (F.col("id") * 1.0).alias("bx"), F.lit(1.0).alias("by"), F.lit(2.0).alias("bz"))
    return particles, cells


def model(df):
    flux = F.array(*[F.col("nonthermal_density_1e7") * F.col("magnetic_field_100g") / f for f in (1.0, 2.0)])
    return df.withColumns({"left": flux, "right": flux})


def test_one_pass_maps_equal_the_single_operators(spark, inputs):
    particles, _ = inputs
    config = emission.EmissionConfig(X, Y, (1.0, 2.0), nx=4, ny=2, energy_bins=6)
    weight, hist = emission.particle_maps(particles, config)
    x, y = config.image_axes
    active = particles.filter("status = 0")
    want = binning.deposit(active, x, y, dense=True)
    columns = ["frame", "iy", "ix", "weight"]
    assert sorted(map(tuple, weight.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    edges = binning.energy_edges(particles, 6)
    want = binning.cell_energy_histogram(active, x, y, edges)
    columns = ["frame", "iy", "ix", "ie", "weight"]
    assert sorted(map(tuple, hist.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_emission_tables(spark, inputs):
    particles, cells = inputs
    background = cells.select("frame", "ix", "iy", (F.col("ix") + 1.0).alias("thermal_density_cm3"), F.lit(2.0).alias("temperature_mk"))
    config = emission.EmissionConfig(X, Y, (1.0, 2.0), nx=4, ny=2, energy_bins=6, beam_fwhm_pixels=1.0)
    tables = emission.run_emission(particles, cells, model, config, background)
    assert tables["cells"].count() == 16 and tables["meta"].first()["background_source_kind"] == "table"
    densest = tables["cells"].groupBy("frame").agg(F.max("nonthermal_density_cm3").alias("m")).collect()
    assert [r["m"] for r in densest] == pytest.approx([config.target_density_cm3] * 2)
    cube = tables["cube"]
    assert cube.count() == 2 * 2 * 8
    empty = tables["cells"].filter("weight = 0").select("frame", "iy", "ix")
    assert cube.join(empty, ["frame", "iy", "ix"]).filter("i_flux <> 0").count() == 0
    roi = {(r["frame"], r["freq_hz"]): r["full_image_sfu"] for r in tables["roi"].collect()}
    sums = {(r["frame"], r["freq_hz"]): r["s"] for r in cube.groupBy("frame", "freq_hz").agg(F.sum("i_flux").alias("s")).collect()}
    assert roi == pytest.approx(sums)
    assert roi[(0, 1.0e9)] == pytest.approx(2 * roi[(0, 2.0e9)])


def test_spectral_fit_recovers_the_index(spark):
    # 6 x 6 pixels; one bright pixel falls as nu^-2, the rest is a faint constant
    rows = [(0, y, x, 1.0e9 * k, 100.0 * k ** -2.0 if (y, x) == (1, 2) else 0.001 * ((y + x) % 2)) for y in range(6) for x in range(6) for k in range(1, 9)]
    cube = spark.createDataFrame(rows, "frame int, iy int, ix int, freq_hz double, value double")
    config = spectral_fit.FitConfig(6, 6, 2.0e9, 7.0e9, (0, 6), (0, 6), ((0.5, 0.5), (1.0, 1.0)), 4.0, 1.0)
    maps = {(r["iy"], r["ix"]): r for r in spectral_fit.fit_maps(cube, config, ["slope", "level"]).collect()}
    assert len(maps) == 36 and maps[(1, 2)]["slope"] == pytest.approx(-2.0) and maps[(1, 2)]["level"] == pytest.approx(2.0)
    assert all(r["slope"] == 0.0 for k, r in maps.items() if k != (1, 2))
    observed = spectral_fit.observed_spectra(cube, config)
    assert sorted(r["freq"] for r in observed.collect()) == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
