import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.functions import geometry as G
from fieldframe.functions import units as U
from fieldframe.functions.axes import Axis, wrap
from fieldframe.operators import grid, image

X = Axis.uniform(1.0, 3.0, 10)
Y = Axis.linear_width(0.0, 0.1, 0.02, 8)
AXES = {"ix": X, "iy": Y}


def field(spark, axes=None, **columns):
    axes = axes or AXES
    df = spark.range(1).select(F.lit(0).alias("frame"))
    for d, a in axes.items():
        df = df.withColumn(d, F.explode(F.sequence(F.lit(0), F.lit(a.n - 1))))
    q = {d[1]: a.center(F.col(d)) for d, a in axes.items()}
    df = df.withColumns(q)
    return df.withColumns({k: v(F.col("x"), F.col("y")) for k, v in columns.items()})


def interior(df, axes=None, margin=1):
    for d, a in (axes or AXES).items():
        df = df.filter(F.col(d).between(margin, a.n - 1 - margin))
    return df


def test_gradient_of_quadratic_is_exact_inside(spark):
    f = field(spark, v=lambda x, y: x * x + y * 3.0 + y * y)
    rows = interior(grid.gradient(f, AXES, "v", ["frame"])).collect()
    for r in rows:
        assert r["grad_1"] == pytest.approx(2 * r["x"]) and r["grad_2"] == pytest.approx(3 + 2 * r["y"])


def test_curl_of_gradient_and_divergence_of_curl_vanish(spark):
    f = field(spark, v=lambda x, y: x * x * 2.0 + x * y + y * y)
    g = grid.gradient(f, AXES, "v", ["frame"]).withColumn("zero", F.lit(0.0))
    rows = interior(grid.curl(g, AXES, ["grad_1", "grad_2", "zero"], ["frame"]), margin=2).collect()
    assert rows and all(abs(r["curl_3"]) < 1e-9 for r in rows)


def test_polar_divergence_of_radial_field(spark):
    # div(r^2 e_r) = 3 r in polar coordinates; the centre formula is exact for the cubic weight only to second order
    f = field(spark, a=lambda x, y: x, b=lambda x, y: x * 0.0)
    rows = interior(grid.divergence(f, AXES, ["a", "b"], ["frame"], "polar")).collect()
    assert all(r["divergence"] == pytest.approx(2.0) for r in rows)


def test_periodic_sine(spark):
    axes = {"ix": Axis.uniform(0.0, 2 * math.pi, 64, periodic=True), "iy": Axis.uniform(0.0, 1.0, 2)}
    f = field(spark, axes, v=lambda x, y: F.sin(x))
    rows = grid.gradient(f, axes, "v", ["frame"]).collect()
    assert len(rows) == 128
    assert max(abs(r["grad_1"] - math.cos(r["x"])) for r in rows) < 2e-3


def test_current_matches_numpy(spark):
    f = field(spark, bx=lambda x, y: x * y * y, by=lambda x, y: F.sin(x) + y)
    rows = grid.current_proxy(f, ["frame"]).collect()
    ny, nx = Y.n, X.n
    bx, by, got = np.zeros((ny, nx)), np.zeros((ny, nx)), np.zeros((ny, nx))
    x, y = np.zeros(nx), np.zeros(ny)
    for r in rows:
        bx[r["iy"], r["ix"]], by[r["iy"], r["ix"]], got[r["iy"], r["ix"]] = r["bx"], r["by"], r["jz"]
        x[r["ix"]], y[r["iy"]] = r["x"], r["y"]
    want = np.gradient(by, x, axis=1, edge_order=2) - np.gradient(bx, y, axis=0, edge_order=2)
    assert np.allclose(got, want)


def test_linear_field_is_sampled_exactly(spark):
    axes = {"ix": X, "iy": Axis.uniform(0.0, 2.0, 6)}
    f = field(spark, axes, v=lambda x, y: x * 2.0 - y * 3.0 + 1.0)
    points = spark.range(200).select(F.lit(0).alias("frame"), "id", (F.lit(1.1) + F.col("id") / 200.0 * 1.79).alias("px"),
                                     (F.lit(0.17) + (F.col("id") * 37 % 200) / 200.0 * 1.65).alias("py"))
    rows = grid.multilinear_sample(points, f, axes, {"ix": "px", "iy": "py"}, ["v"], ["frame"], "inside").collect()
    assert len(rows) == 200
    for r in rows:
        assert r["s_v"] == pytest.approx(2 * r["px"] - 3 * r["py"] + 1)


def test_staged_corners_leave_the_points_in_place(spark):
    axes = {"ix": X, "iy": Axis.uniform(0.0, 2.0, 6)}
    f = field(spark, axes, v=lambda x, y: x * 2.0 - y * 3.0)
    points = spark.range(50).select(F.lit(0).alias("frame"), (F.col("id") / 50.0 + 1.5).alias("px"), F.lit(1.0).alias("py"))
    args = (f, axes, {"ix": "px", "iy": "py"}, ["v"], ["frame"], "inside")
    staged = grid.multilinear_sample(points, *args, stage=True)
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, grid.multilinear_sample(points, *args).collect()))
    assert "Exchange hashpartitioning" not in staged._jdf.queryExecution().executedPlan().toString()


def test_sampling_boundaries(spark):
    axes = {"ix": Axis.uniform(0.0, 4.0, 4, periodic=True), "iy": Axis.uniform(0.0, 2.0, 2)}
    f = field(spark, axes, v=lambda x, y: x)
    points = spark.createDataFrame([(0, 4.5, 1.0), (0, 0.1, 1.0), (0, 3.9, -5.0)], "frame int, px double, py double")
    kw = dict(coordinates={"ix": "px", "iy": "py"}, columns=["v"], keys=["frame"])
    assert [r["s_v"] for r in grid.multilinear_sample(points, f, axes, boundary="inside", **kw).collect()] == [0.5]
    wrapped = {r["px"]: r["s_v"] for r in grid.multilinear_sample(points, f, axes, boundary="wrap", **kw).collect()}
    assert wrapped == {4.5: 0.5, 0.1: 0.5}
    clamped = {r["px"]: r["s_v"] for r in grid.multilinear_sample(points, f, axes, boundary="clamp", **kw).collect()}
    assert clamped == {4.5: 0.5, 0.1: 0.5, 3.9: 3.5}


def test_three_dimensional_sampling(spark):
    axes = {d: Axis.uniform(0.0, 1.0, 3) for d in ("ix", "iy", "iz")}
    f = spark.range(27).select(F.lit(0).alias("frame"), (F.col("id") % 3).cast("int").alias("ix"), ((F.col("id") / 3).cast("int") % 3).alias("iy"),
                               (F.col("id") / 9).cast("int").alias("iz"))
    f = f.withColumn("v", axes["ix"].center(F.col("ix")) + axes["iy"].center(F.col("iy")) * 2 + axes["iz"].center(F.col("iz")) * 4)
    p = spark.createDataFrame([(0, 0.3, 0.4, 0.7)], "frame int, a double, b double, c double")
    row = grid.multilinear_sample(p, f, axes, {"ix": "a", "iy": "b", "iz": "c"}, ["v"], ["frame"]).first()
    assert row["s_v"] == pytest.approx(0.3 + 0.8 + 2.8)


def test_resample_extrapolates(spark):
    raw = {"ix": Axis.uniform(0.0, 4.0, 4), "iy": Axis.uniform(0.0, 4.0, 4)}
    f = field(spark, raw, v=lambda x, y: x + y * 10.0)
    target = {"ix": Axis.uniform(0.0, 4.0, 16), "iy": Axis.uniform(0.0, 4.0, 7)}
    for r in grid.bilinear_resample(f, raw, target, ["v"], ["frame"]).collect():
        x, y = (r["ix"] + 0.5) / 4.0, (r["iy"] + 0.5) * 4.0 / 7.0
        assert r["v"] == pytest.approx(x + 10 * y)


def test_cell_index_rules(spark):
    edges = [0.0, 1.0, 4.0]
    for axis in (Axis.stored(edges), Axis.linear_width(0.0, 1.0, 2.0, 2)):
        df = spark.createDataFrame([(-0.1,), (0.0,), (1.0,), (3.9,), (4.0,), (4.1,)], "x double")
        assert [r[0] for r in df.select(axis.cell_index(F.col("x"))).collect()] == [-1, 0, 1, 1, 1, 2]
    down = Axis.stored([4.0, 1.0, 0.0])
    df = spark.createDataFrame([(4.1,), (4.0,), (1.0,), (0.5,), (0.0,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(down.cell_index(F.col("x"))).collect()] == [-1, 0, 1, 1, 1, 2]
    log = Axis.log(1.0, 100.0, 2)
    df = spark.createDataFrame([(1.0,), (9.0,), (11.0,), (log.upper,)], "x double")
    assert [r[0] for r in df.select(log.cell_index(F.col("x"))).collect()] == [0, 0, 1, 1]


def test_wrap_stays_half_open(spark):
    values = [-1e-17, 0.0, 1.0, 2.5, -0.75, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(wrap(F.col("x"), 0.0, 1.0)).collect()]
    assert all(0.0 <= g < 1.0 for g in got)
    assert got[1:] == [0.0, 0.0, 0.5, 0.25, 0.0]


def test_time_interpolation_bounds(spark):
    f = spark.createDataFrame([(0, 0, 0.0, 1.0), (1, 0, 1.0, 3.0)], "frame int, ix int, t double, v double")
    half = grid.time_interpolate(f, ["v"], ["ix"], F.lit(0.25)).collect()
    assert [r["v"] for r in half] == [1.5]
    assert grid.time_interpolate(f, ["v"], ["ix"], F.lit(9.0), bounds="clamped").first()["v"] == 3.0
    assert grid.time_interpolate(f, ["v"], ["ix"], F.lit(2.0), bounds="extrapolate").first()["v"] == 5.0
    with pytest.raises(Exception, match="outside the frame pair"):
        grid.time_interpolate(f, ["v"], ["ix"], F.lit(2.0)).collect()


def test_alias_errors(spark):
    f = field(spark, Bcc1=lambda x, y: x)
    with pytest.raises(ValueError, match="for by"):
        grid.resolve_aliases(f)
    assert "bx" in grid.resolve_aliases(f, required=("bx",)).columns


def test_convolution_keeps_a_constant_plane_and_matches_numpy(spark):
    r = np.random.default_rng(5)
    plane = r.random((9, 7))
    rows = [(0, y, x, float(plane[y, x]), 2.0) for y in range(9) for x in range(7)]
    cube = spark.createDataFrame(rows, "freq int, iy int, ix int, value double, flat double")
    kernel = np.array(image.gaussian_kernel(3.0))
    k = len(kernel) // 2
    padded = np.pad(plane, ((k, k), (0, 0)), mode="edge")
    want = np.stack([np.convolve(padded[:, x], kernel, "valid") for x in range(7)], axis=1)
    padded = np.pad(want, ((0, 0), (k, k)), mode="edge")
    want = np.stack([np.convolve(padded[y], kernel, "valid") for y in range(9)])
    for out in (image.beam_convolve(cube, ["freq"], ["value", "flat"], 3.0),
                image.beam_convolve(cube, ["freq"], ["value", "flat"], F.lit(3.0), max_fwhm=4.0)):
        for row in out.collect():
            assert row["flat"] == pytest.approx(2.0)
            assert row["value"] == pytest.approx(want[row["iy"], row["ix"]])


def test_directions_and_volumes(spark):
    df = spark.createDataFrame([(3.0, 4.0), (0.1, 0.0)], "a double, b double")
    rows = df.select(*G.direction([F.col("a"), F.col("b")], 0.5)).collect()
    assert tuple(rows[0]) == pytest.approx((0.6, 0.8)) and tuple(rows[1]) == (0.0, 0.0)
    volume = df.select(G.cell_volume("polar", [F.col("a"), F.col("b")], [F.lit(2.0), F.lit(-0.5)])).collect()
    assert [r[0] for r in volume] == pytest.approx([3.0, 0.1])


def test_units():
    system = U.UnitSystem(length=2.0, mass=3.0, time=4.0, charge=5.0)
    assert system.scale("energy") == pytest.approx(4 * 3 / 16)
    assert U.UnitSystem.from_magnetic_field(2.0, 3.0, 4.0, 6.0).scale("magnetic_field") == pytest.approx(6.0)
    with pytest.raises(ValueError):
        U.UnitSystem(length=-1.0)
