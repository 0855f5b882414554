import math

import pytest
from pyspark.sql import functions as F

from fieldframe.functions import kinematics as K
from fieldframe.functions import predicates as P
from fieldframe.functions import radiometry as Q
from fieldframe.operators import catalog, compare, image, memo, quality, runs
from fieldframe.plans import image_queries, run_queries
from fieldframe.streaming import frames as ST


def test_frame_without_active_rows_reports_zeros(spark):
    df = spark.createDataFrame([(0, 1, 5.0, 2.0, 0.1, 3)], "frame int, status int, p double, weight double, dt double, split_level int")
    row = runs.frame_summary(df).first()
    assert (row["stored"], row["active"], row["inactive"]) == (1, 0, 1)
    assert [row[c] for c in ("weight_sum", "p_min", "p_max", "p_avg", "dt_min", "dt_max", "dt_avg", "max_split_level")] == [0.0] * 7 + [0]


def test_frame_inputs_name_what_is_missing(spark):
    wanted = runs.wanted_frames(spark, 1, 40)
    paths = wanted.filter("frame <= 5").withColumn("path", F.lit("x"))
    with pytest.raises(ValueError, match=r"field_path of frame 6.*\.\.\. 50 more"):
        runs.frame_inputs(wanted, paths, paths)
    ok = runs.frame_inputs(wanted.filter("frame <= 5"), paths, paths, paths.filter("frame = 2"))
    assert ok.filter("background_path is not null").count() == 1
    with pytest.raises(ValueError, match="background_path of frame 1"):
        runs.frame_inputs(wanted.filter("frame <= 5"), paths, paths, paths.filter("frame = 2"), require_background=True)


def test_step_without_count_is_an_error(spark):
    steps = spark.createDataFrame([("a", 1), ("a", 2)], "case string, frame int")
    with pytest.raises(ValueError, match="frame 2"):
        runs.join_counts(steps, steps.filter("frame = 1"), ["case"])


def test_energy_sources(spark):
    df = spark.createDataFrame([(3, 1.0)], "species int, p double")
    one = F.lit(1.0)
    source = df.select(K.energy_source(F.col("species"), one, one, one).alias("s")).first()["s"]
    assert source == "transport-p0-kinetic-kev"
    with pytest.raises(Exception, match="unsupported energy source"):
        df.select(K.energy_ev(F.col("p"), F.lit("wrong"), one, one, one)).collect()
    with pytest.raises(ValueError):
        K.transport_energy_kev(F.col("p"), 0.0, 1.0)
    assert df.select(K.transport_energy_kev(F.lit(0.1), 0.1, 7.0)).first()[0] == pytest.approx(7.0)


def test_brightness_temperature_round_trip_and_checks(spark):
    df = spark.createDataFrame([(2.0, 1.0e9)], "v double, f double")
    back = Q.tb_to_intensity(Q.intensity_to_tb(F.col("v"), F.col("f")), F.col("f"))
    assert df.select(back).first()[0] == pytest.approx(2.0)
    with pytest.raises(Exception, match="positive and finite"):
        df.select(Q.intensity_to_tb(F.col("v"), F.lit(0.0))).collect()


def test_cadence(spark):
    df = spark.range(1, 12).withColumnRenamed("id", "frame")

    def frames(*a, **k):
        return [r["frame"] for r in df.filter(P.on_cadence(F.col("frame"), *a, **k)).collect()]

    assert frames(0, 11, 4) == [4, 8, 11] and frames(0, 11, 0) == [] and frames(0, 11, 0, zero_means_final=True) == [11]


def test_metrics_on_empty_and_perfect_maps(spark):
    pairs = spark.createDataFrame([(0, 0, 0, 2.0, 2.0), (0, 0, 1, 0.0, 0.0), (1, 0, 0, float("nan"), 1.0)], "frame int, iy int, ix int, truth double, candidate double")
    rows = {r["frame"]: r.asDict() for r in compare.map_metrics(pairs, ["frame"]).collect()}
    assert rows[0]["rmse"] == 0.0 and rows[0]["peak_theory"] == 2.0
    assert all(v == 0.0 for k, v in rows[1].items() if k != "frame")
    images = {r["frame"]: r for r in compare.image_metrics(pairs, ["frame"]).collect()}
    assert images[0]["centroid_offset_pixels"] == 0.0 and images[1]["centroid_offset_pixels"] == 0.0


def test_bands_are_half_open_except_the_last(spark):
    pairs = spark.createDataFrame([("a", f, 1.0, 2.0) for f in (0.03, 0.3, 3.0, 10.0, 10.1)], "case string, freq_ghz double, truth double, candidate double")
    rows = {r["band"]: r["flux_theory"] for r in compare.band_metrics(pairs, ["case"]).collect()}
    assert rows == {"low_0.03_0.3GHz": 1.0, "mid_0.3_3GHz": 1.0, "high_3_10GHz": 2.0}


def test_model_sees_each_key_once_and_the_first_cell(spark):
    cells = spark.createDataFrame([(0, y, x, (y + x) % 3, float(10 * y + x)) for y in range(20) for x in range(20)], "frame int, iy int, ix int, k int, v double")
    seen = spark.sparkContext.accumulator(0)

    def model(df):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(out=b["v"] * 2)
        return df.mapInPandas(run, "frame int, k int, v double, out double")

    out = memo.evaluate_once(cells, ["k"], ["v"], [F.col("iy"), F.col("ix")], model, ["out"], ("frame",))
    rows = out.collect()
    assert len(rows) == 400 and seen.value == 3
    assert {r["k"]: r["out"] for r in rows} == {0: 0.0, 1: 2.0, 2: 4.0}


def test_kinds_keep_their_order(spark):
    rows = [("freq_hz", [18], True), ("a/I", [18, 4, 4], True), ("a/I", [7, 4, 4], True), ("m", [3, 3], True), ("s", [18], True), ("freq_bad", [18], False), ("x", [], True), ("x", [1], True), ("x", [5], True)]
    df = spark.createDataFrame(rows, "path string, shape array<int>, positive boolean")
    kinds = [r[0] for r in df.select(catalog.dataset_kind(F.col("path"), F.lit(False), F.col("shape"), F.col("positive"), F.lit(18))).collect()]
    assert kinds == ["vector", "cube", "vector", "map", "spectrum", "spectrum", "scalar", "scalar", "vector"]


def test_flatten_opens_only_objects(spark):
    text = '{"a.b": {"c": {"d": 1, "e": {"f": 2}}}, "t": "{x", "l": [1, 2], "n": null, "v": 1.5}'
    df = spark.createDataFrame([(1, text)], "id int, j string")
    got = {r["metric"]: r["value"] for r in catalog.flatten_json(df, ["id"], "j", depth=3).collect()}
    assert got == {"a.b/c/d": "1", "a.b/c/e": '{"f":2}', "t": "{x", "l": "[1,2]", "n": None, "v": "1.5"}
    more = spark.createDataFrame([(1, '{"a": {}, "b": {"c": {}}}'), (2, "{}"), (3, None), (4, '{"x": {"y": true}}')], "id int, j string")
    flat = catalog.flatten_json(more, ["id"], "j", depth=3)
    assert [tuple(r) for r in flat.collect()] == [(4, "x/y", "true")]
    assert flat._jdf.queryExecution().executedPlan().toString().count("parse_json") <= 2


def test_flatten_opens_all_levels_and_keeps_empty_keys(spark):
    text = '{"a": {"b": {"c": {"d": {"e": 5}}}}, "": 7, "x": {"": {"": 8}}, "l": [{"q": {"r": 1}}]}'
    df = spark.createDataFrame([(1, text), (2, None)], "id int, j string")
    got = {r["metric"]: r["value"] for r in catalog.flatten_json(df, ["id"], "j").collect()}
    assert got == {"a/b/c/d/e": "5", "": "7", "x//": "8", "l": '[{"q":{"r":1}}]'}
    none = spark.createDataFrame([(1, None)], "id int, j string")
    assert catalog.flatten_json(none, ["id"], "j").count() == 0


def test_nearest_frequency_tolerance(spark):
    bands = spark.createDataFrame([(0, 0, 1.0e9), (0, 1, 2.0e9), (0, 2, 3.0e9)], "frame int, freq_idx int, freq_hz double")
    assert image.nearest_frequency(bands, 1.5e9, ["frame"], tolerance=None).first()["freq_idx"] == 0
    with pytest.raises(Exception, match="within tolerance"):
        image.nearest_frequency(bands, 1.5e9, ["frame"]).collect()


def test_calibration_of_an_empty_map_fails(spark):
    empty = spark.createDataFrame([(0, 0.0)], "frame int, weight double")
    with pytest.raises(Exception, match="empty weight map"):
        image.calibration(empty, ["frame"], 1.0, 1.0).collect()


def test_wide_spectrum_has_every_series(spark):
    rows = spark.createDataFrame([(1, "b", 1.0), (1, "a", 2.0), (2, "c", 3.0)], "frame int, case string, v double")
    wide = catalog.wide_spectrum(rows, "frame", "case", "v")
    assert wide.columns == ["frame", "a", "b", "c"] and [tuple(r) for r in wide.collect()] == [(1, 2.0, 1.0, None), (2, None, None, 3.0)]
    assert catalog.wide_spectrum(rows, "frame", "case", "v", ["c", "b", "a"]).columns == ["frame", "c", "b", "a"]
    with pytest.raises(ValueError, match="no column for the series"):
        catalog.wide_spectrum(rows, "frame", "case", "v", ["a", "b"])
    with pytest.raises(ValueError, match="no name"):
        catalog.wide_spectrum(rows.withColumn("case", rows["case"].substr(1, 0)).selectExpr("frame", "nullif(case, '') AS case", "v"), "frame", "case", "v")


def test_wide_spectrum_refuses_endless_columns(spark, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_SERIES", 2)
    rows = spark.createDataFrame([(1, c, 1.0) for c in "abc"], "frame int, case string, v double")
    with pytest.raises(ValueError, match="more than 2 series"):
        catalog.wide_spectrum(rows, "frame", "case", "v")
    assert catalog.wide_spectrum(rows.filter("case < 'c'"), "frame", "case", "v").columns == ["frame", "a", "b"]


def test_wide_query_writes_all_series(spark, tmp_path, monkeypatch):
    orders = [(i, f"2000-01-{i + 1:02d}", name, 10.0 + i) for i, name in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEW"])]
    (spark.createDataFrame(orders, "o_orderkey long, o_orderdate string, o_orderpriority string, o_totalprice double")
     .withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(str(tmp_path / "in/orders.parquet")))
    monkeypatch.setattr(run_queries, "scratch_dir", lambda spark, purpose: str(tmp_path / purpose))
    assert run_queries.snk7_all(spark, str(tmp_path / "in")).columns == ["frame", *[o[2] for o in orders]]
    stored = spark.read.option("header", True).csv(str(tmp_path / "wide-spectrum"))
    assert stored.columns == ["frame", *[o[2] for o in orders]] and stored.count() == 1 and None not in stored.first()


def test_parameter_maps_fill_missing_fits_with_zero(spark):
    pixels = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "frame int, iy int, ix int")
    fits = spark.createDataFrame([(0, 0, 1, [2.0, 3.0], [0.2, 0.3])], "frame int, iy int, ix int, params array<double>, errors array<double>")
    maps = image.parameter_maps(fits, pixels, ["frame", "iy", "ix"], ["n", "b"]).orderBy("ix").collect()
    assert [tuple(r)[2:] for r in maps] == [(0, 0.0, 0.0, 0.0, 0.0), (1, 2.0, 0.2, 3.0, 0.3)]


def test_fit_maps_keep_every_label(spark, tmp_path):
    rows = [(k, label, [float(k + 1)] * 64) for k, label in enumerate([0, 3, None])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = image_queries.jon14_all(spark, str(tmp_path)).orderBy("ix").collect()
    assert [(r["n_nth"], r["err_b"]) for r in got] == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]


def test_edges_and_times(spark):
    rows = [("up", k, float(k)) for k in range(4)] + [("down", k, -float(k)) for k in range(3)] + [("same", 0, 1.0), ("same", 1, 1.0)] + [("uneven", 0, 0.0), ("uneven", 1, 1.0), ("uneven", 2, 5.0)]
    df = spark.createDataFrame(rows, "axis string, i int, edge double")
    assert sorted({r["key"].split("/")[0] for r in quality.edges(df, ["axis"]).collect()}) == ["down", "same"]
    uneven = quality.edges(df.filter("axis in ('up', 'uneven')"), ["axis"], uniform=True).collect()
    assert {r["check"] for r in uneven} == {"uniform"} and len(uneven) == 2
    with pytest.raises(ValueError, match="ascending"):
        quality.require_clean(quality.edges(df, ["axis"]))
    times = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3000001)], "frame int, time double")
    assert [r["key"] for r in quality.time_consistency(times, 0.1).collect()] == ["3"]


def test_uniform_edges_are_checked_at_every_place(spark, tmp_path):
    rows = [(k, [1.0 if i == place else 0.0 for i in range(1, 65)]) for k, place in enumerate([0, 2, 45, 63])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["key"] for r in run_queries.dq3_uniform_all(spark, str(tmp_path)).collect()}
    assert got == {"1/2", "1/3", "2/45", "2/46", "3/63", "3/64"}


def test_alfven_time():
    speed = 50.0 / math.sqrt(4 * math.pi * 1e10 * 1.6726219e-24) / 100.0
    assert K.alfven_time_seconds() == pytest.approx(5.0e6 / speed)


def test_stream_resumes_without_repeating(spark, tmp_path):
    def add(k, frame):
        df = spark.range(100).select(F.lit(frame).alias("frame"), (F.col("id") % 2).cast("int").alias("status"), (F.col("id") / 10.0 + 0.01).alias("p"), F.lit(1.0).alias("weight"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
        return df.schema

    schema = add(0, 0)
    add(1, 1)

    def run():
        stream = ST.read_frames(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
        ST.accumulate(stream, ST.summary_partial, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return {r["frame"]: r["stored"] for r in ST.merged_summary(spark.read.parquet(f"{tmp_path}/out")).collect()}

    assert run() == {0: 100, 1: 100}
    assert run() == {0: 100, 1: 100}
    add(2, 1)
    assert run() == {0: 100, 1: 200}
    hist = ST.merged_histogram(ST.histogram_partial()(spark.read.parquet(f"{tmp_path}/in/*")))
    assert hist.count() == 256


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from fieldframe.operators import binning
    from fieldframe.functions.axes import Axis
    from fieldframe.sources import tables as IO

    df = spark.range(100).select((F.col("id") % 3).cast("int").alias("frame"), (F.col("id") % 2).cast("int").alias("status"),
                                 F.lit(1.0).alias("p"), F.lit(2.0).alias("x"), F.lit(3.0).alias("y"), F.lit(1.0).alias("weight"),
                                 F.lit(9.0).alias("energy_ev"), F.lit(0.5).alias("mu"))
    IO.write_particles(df, f"{tmp_path}/p")
    stored = spark.read.schema(df.schema).parquet(f"{tmp_path}/p").filter("frame = 1")
    active = stored.filter(P.active_above(F.col("status"), F.col("energy_ev"), 1.0))
    out = binning.deposit(active, Axis.uniform(0, 4, 4), Axis.uniform(0, 4, 4))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(frame" in scan and "EqualTo(status,0)" in scan
    assert "GreaterThanOrEqual(energy_ev,1.0)" in scan and "GreaterThanOrEqual(x,0.0)" in scan
    assert "mu" not in scan.split("ReadSchema:")[1] and "p:double" not in scan.split("ReadSchema:")[1]
    assert plan.count("Exchange hashpartitioning") == 1
