import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldframe.functions import numeric as N
from fieldframe.functions.axes import Axis, edge_index, fixed_edge_index, log_edge_index
from fieldframe.operators import binning, fit

X, Y = Axis.uniform(0.0, 4.0, 4), Axis.uniform(0.0, 2.0, 2)


def particles(spark, rows):
    typed = [(r[0], r[1], *map(float, r[2:])) for r in rows]
    return spark.createDataFrame(typed, "frame int, status int, x double, y double, p double, weight double, energy_ev double")


def random_particles(spark, n=5000, seed=3):
    r = np.random.default_rng(seed)
    rows = [(int(f), int(s), float(x), float(y), float(p), float(w), float(e)) for f, s, x, y, p, w, e in zip(
        r.integers(0, 3, n), r.integers(0, 3, n), r.uniform(-1, 5, n), r.uniform(-1, 3, n), 10 ** r.uniform(-3, 2, n),
        r.integers(1, 9, n), 10 ** r.uniform(0, 3, n))]
    return particles(spark, rows), rows


def test_histogram_conserves_weight_and_partitioning(spark):
    df, rows = random_particles(spark)
    inside = sum(r[5] for r in rows if r[1] == 0 and 0.01 <= r[4] <= 10.0)
    results = []
    for parts in (1, 64):
        hist = binning.momentum_histogram(df.repartition(parts)).collect()
        assert len(hist) == 3 * 128
        assert sum(r["weight"] for r in hist) == inside
        results.append(sorted(map(tuple, hist)))
    assert results[0] == results[1]


def test_histogram_ends_and_golden_shape(spark):
    df = particles(spark, [(0, 0, 0, 0, 0.01, 1.0, 1.0), (0, 0, 0, 0, 10.0, 2.0, 1.0), (0, 0, 0, 0, 10.1, 4.0, 1.0),
                           (0, 1, 0, 0, 1.0, 8.0, 1.0), (1, 2, 0, 0, 1.0, 8.0, 1.0)])
    rows = {(r["frame"], r["bin"]): r["weight"] for r in binning.momentum_histogram(df).collect()}
    assert rows[(0, 0)] == 1.0 and rows[(0, 127)] == 2.0 and sum(rows.values()) == 3.0
    assert rows[(1, 5)] == 0.0  # a frame without active rows still has all bins
    # 262144 unit weights around p = 0.1 stay in three neighbouring bins
    width = (math.log(10) - math.log(0.01)) / 128
    centers = [math.exp(math.log(0.01) + (b + 0.5) * width) for b in (41, 42, 43)]
    golden = particles(spark, [(0, 0, 0, 0, c, float(w), 1.0) for c, w in zip(centers, (52, 261875, 217))])
    filled = binning.momentum_histogram(golden, dense=False).orderBy("bin").collect()
    assert [(r["bin"], r["weight"]) for r in filled] == [(41, 52.0), (42, 261875.0), (43, 217.0)]


def test_upper_edges_differ_between_deposit_and_energy_histogram(spark):
    df = particles(spark, [(0, 0, 4.0, 2.0, 1.0, 5.0, 8.0), (0, 0, 0.0, 0.0, 1.0, 1.0, 8.0), (0, 0, 0.5, 0.5, 1.0, 2.0, 1.0)])
    assert {(r["iy"], r["ix"]): r["weight"] for r in binning.deposit(df, X, Y).collect()} == {(1, 3): 5.0, (0, 0): 3.0}
    edges = [1.0, 2.0, 8.0]
    assert [tuple(r) for r in binning.cell_energy_histogram(df, X, Y, edges).collect()] == [(0, 0, 0, 0, 2.0)]
    top = binning.cell_energy_histogram(df, X, Y, edges, include_top=True).orderBy("ie").collect()
    assert [(r["ie"], r["weight"]) for r in top] == [(0, 2.0), (1, 1.0)]


def test_deposit_matches_numpy(spark):
    df, rows = random_particles(spark)
    a = np.array([r for r in rows if r[0] == 1 and r[1] == 0])
    want, _, _ = np.histogram2d(a[:, 3], a[:, 2], bins=(2, 4), range=((0, 2), (0, 4)), weights=a[:, 5])
    got = np.zeros((2, 4))
    active = df.filter((F.col("status") == 0) & (F.col("frame") == 1))
    for r in binning.deposit(active, X, Y, dense=True).collect():
        got[r["iy"], r["ix"]] = r["weight"]
    assert (got == want).all()


def test_energy_edges(spark):
    df = particles(spark, [(0, 0, 0, 0, 1, 1, 10.0), (0, 0, 0, 0, 1, 1, 1000.0), (1, 0, 0, 0, 1, 1, 5.0), (2, 1, 0, 0, 1, 1, 5.0)])
    rows = {r["frame"]: r["edges"] for r in binning.energy_edges(df, 2).collect()}
    assert rows[0] == pytest.approx([10, 100, 1000]) and rows[1][-1] == pytest.approx(5.005) and 2 not in rows
    with pytest.raises(ValueError):
        binning.require_rows(binning.energy_edges(df.filter("status = 1"), 2), "no active particles")
    with pytest.raises(ValueError):
        binning.cell_energy_histogram(df, X, Y, [1.0, 1.0])


def test_coarse_average_of_constant_and_empty(spark):
    field = spark.range(8).select(F.lit(0).alias("frame"), (F.col("id") % 4).cast("int").alias("ix"),
                                  (F.col("id") / 4).cast("int").alias("iy"), F.lit(3.0).alias("v"))
    rows = binning.coarse_average(field, X, Y, 8, 2, ["v"]).collect()
    values = {(r["iy"], r["ix"]): r["v"] for r in rows}
    assert len(values) == 16 and values[(0, 1)] == 3.0 and values[(0, 0)] == 0.0


def histogram(spark, weights, edges):
    return spark.createDataFrame([(k, e0, e1, float(w)) for k, (e0, e1, w) in enumerate(zip(edges, edges[1:], weights))],
                                 "ie int, lo double, hi double, weight double").withColumn("cell", F.lit(0))


def test_power_law_rules(spark):
    edges = [2.0 ** k for k in range(9)]
    centers = [math.sqrt(a * b) for a, b in zip(edges, edges[1:])]
    exact = [c ** -3.5 * (b - a) for c, a, b in zip(centers, edges, edges[1:])]
    row = fit.power_law_fit(histogram(spark, exact, edges), ["cell"]).first()
    assert row["delta"] == pytest.approx(3.5) and row["r2"] == pytest.approx(1.0) and row["accepted"]
    flat = [(b - a) for a, b in zip(edges, edges[1:])]
    row = fit.power_law_fit(histogram(spark, flat, edges), ["cell"], fallback=9.0).first()
    assert (row["delta"], row["r2"], row["accepted"]) == (8.0, 0.0, False)
    few = [1.0, 0, 0, 0, 0, 0, 0, 2.0]
    row = fit.power_law_fit(histogram(spark, few, edges), ["cell"]).first()
    assert (row["delta"], row["r2"], row["accepted"], row["bins"]) == (4.0, 0.0, False, 2)
    steep = [c ** -9.0 * (b - a) for c, a, b in zip(centers, edges, edges[1:])]
    row = fit.power_law_fit(histogram(spark, steep, edges), ["cell"]).first()
    assert row["r2"] == pytest.approx(1.0) and not row["accepted"] and row["delta"] == 4.0


def test_power_law_map_matches_numpy(spark):
    r = np.random.default_rng(1)
    edges = [2.0 ** k for k in range(9)]
    cube = r.integers(0, 40, (2, 3, 8)) * (r.random((2, 3, 8)) > 0.3) * np.linspace(40, 1, 8).astype(int) ** 2
    rows = [(0, y, x, k, edges[k], edges[k + 1], float(cube[y, x, k])) for y in range(2) for x in range(3) for k in range(8) if cube[y, x, k]]
    hist = spark.createDataFrame(rows, "frame int, iy int, ix int, ie int, lo double, hi double, weight double")

    def reference(counts, fallback):
        e = np.array(edges)
        used = counts > 0
        if used.sum() < 4:
            return min(max(fallback, 2), 8), 0.0, False
        x = np.log10(np.sqrt(e[:-1] * e[1:]))[used]
        y = np.log10(counts[used] / np.diff(e)[used])
        slope, level = np.polyfit(x, y, 1)
        quality = 1 - ((y - slope * x - level) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        good = quality >= 0.5 and 2 <= -slope <= 8
        return (-slope if good else min(max(fallback, 2), 8)), quality, good

    whole = reference(cube.sum(axis=(0, 1)), 4.0)[0]
    for row in fit.power_law_map(hist, ["frame"], 2, 3).collect():
        delta, quality, good = reference(cube[row["iy"], row["ix"]], whole)
        assert row["delta"] == pytest.approx(delta) and row["accepted"] == good and row["r2"] == pytest.approx(quality)


def test_quantize_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-1.0,), (2.0,), (0.625,)], "v double")
    assert [r[0] for r in df.select(N.quantize(F.col("v"), 5)).collect()] == [0, 2, 0, 4, 2]


def test_nan_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, float("inf")), (1.0, 2.0), (float("nan"), 1.0)], "a double, b double")
    ratio = [r[0] for r in df.select(N.safe_ratio(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(ratio[0]) and math.isnan(ratio[1]) and ratio[2] == 0.5 and math.isnan(ratio[3])
    assert [r[0] for r in df.select(N.finite(F.col("a"))).collect()] == [True, True, True, False]


def test_edge_index_forms_agree(spark):
    edges = [float(v) for v in np.logspace(0.3, 4.1, 14)]
    values = sorted(edges + [e * (1 + d) for e in edges for d in (-1e-9, 1e-9, 0.1)] + [0.0, -3.0, 1.0, 1e9])
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("edges", F.array(*[F.lit(e) for e in edges]))
    rows = df.select(edge_index(F.col("edges"), F.col("v")).alias("a"), fixed_edge_index(edges, F.col("v")).alias("b"),
                     log_edge_index(F.col("edges"), F.col("v")).alias("c"), "v").collect()
    for r in rows:
        want = int(np.searchsorted(edges, r["v"], side="right")) - 1
        assert r["a"] == r["b"] == want
        assert r["c"] == want or (r["v"] <= 0 and r["c"] < 0)


def test_densify_raises_for_rows_outside_the_cells(spark):
    rows = spark.createDataFrame([(1, 29, 1.0)], "frame int, ix int, w double")
    dense = binning.densify(rows, rows, ["frame"], {"ix": 30}, {"w": 0.0})
    assert dense.agg(F.sum("w"), F.count("*")).first()[:] == (1.0, 30)
    outside = spark.createDataFrame([(1, 29, 1.0), (1, 30, 5.0)], "frame int, ix int, w double")
    with pytest.raises(Exception, match="outside the declared cells"):
        binning.densify(outside, outside, ["frame"], {"ix": 30}, {"w": 0.0}).collect()


def test_log_line_equals_the_solver(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(f), float(rng.uniform(0.1, 9) if (k + f) % 5 else -1.0), 0.1) for k in range(6) for f in range(1, 9)]
    rows += [(7, 2.0, 1.0, 0.1), (8, 2.0, -1.0, 0.1), (8, 3.0, None, 0.1), (9, 0.0, 1.0, 0.1), (9, 1.0, 2.0, 0.1), (9, 4.0, 8.0, None)]
    df = spark.createDataFrame(rows, "k int, freq double, obs double, err double")
    native = {r["k"]: r for r in fit.fit_spectra(df, ["k"]).collect()}
    solved = {r["k"]: r for r in fit.fit_spectra(df, ["k"], fit.log_polynomial_fit).collect()}
    assert set(native) == set(solved)
    for k, r in native.items():
        for name in ("params", "errors"):
            np.testing.assert_allclose(r[name], solved[k][name], rtol=1e-7, atol=1e-7, err_msg=f"{k} {name}")
        np.testing.assert_allclose([s["fit"] for s in r["spec"]], [s["fit"] for s in solved[k]["spec"]], rtol=1e-7)
