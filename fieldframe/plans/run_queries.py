"""Queries on comparisons, run logs, catalogs, memoized models and data quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldframe.operators import catalog as K
from fieldframe.operators import compare as M
from fieldframe.operators import fit, memo, quality, runs
from fieldframe.plans import rollup
from fieldframe.plans import tables as T
from fieldframe.plans.particle_queries import _ACCEPT, _HIST_SQL, _cell_hist, _edged, _fit_sql, _quality
from fieldframe.plans.registry import SQL, query, snap
from fieldframe.plans.registry import sql_snap as S
from fieldframe.session import scratch_dir
from fieldframe.sources import tables as IO

CELL = ["frame", "iy", "ix"]
PAIRS = "pairs AS (SELECT t.frame, t.iy, t.ix, t.value AS t, c.value AS c FROM truth t JOIN candidate c ON c.frame=t.frame AND c.iy=t.iy AND c.ix=t.ix)"
TC = ("truth", "candidate")


def _pairs(spark, sf):
    return M.match_maps(T.truth(spark, sf), T.candidate(spark, sf), CELL)


def _rounded(df, digits, *columns):
    return df.withColumns({c: snap(F.col(c), digits) for c in columns})


@query("jon7_match_maps", f"WITH {PAIRS} SELECT frame, iy, ix, t AS truth, c AS candidate FROM pairs", TC)
def jon7(spark, sf):
    return _pairs(spark, sf)


_RELATIVE = "CASE WHEN t<>0 THEN (c-t)/nullif(t,0) END"


@query("agg14_masked_metrics", f"""WITH {PAIRS}
SELECT frame, {S('avg(abs(c-t))')} AS mae, {S('sqrt(avg((c-t)*(c-t)))')} AS rmse, {S(f'avg(abs({_RELATIVE}))')} AS relative_mae, {S(f'sqrt(avg(({_RELATIVE})*({_RELATIVE})))')} AS relative_rmse,
 max(t) AS peak_theory, max(c) AS peak_reconstructed, {S('abs(max(c)-max(t))/max(t)')} AS peak_relative_error FROM pairs WHERE ix>=2 AND iy<11 GROUP BY frame""", TC)
def agg14(spark, sf):
    out = M.map_metrics(_pairs(spark, sf), ["frame"], (F.col("ix") >= 2) & (F.col("iy") < 11))
    return _rounded(out, 6, "mae", "rmse", "relative_mae", "relative_rmse", "peak_relative_error")


@query("agg15_image_metrics", f"""WITH {PAIRS}
SELECT frame, {S(f'sqrt(avg(({_RELATIVE})*({_RELATIVE})))')} AS relative_rmse, {S(f'avg(abs({_RELATIVE}))')} AS relative_mae,
 {S('sqrt((sum(c*ix)/sum(c)-sum(t*ix)/sum(t))*(sum(c*ix)/sum(c)-sum(t*ix)/sum(t))+(sum(c*iy)/sum(c)-sum(t*iy)/sum(t))*(sum(c*iy)/sum(c)-sum(t*iy)/sum(t)))')} AS centroid_offset_pixels,
 {S('abs(max(c)-max(t))/max(t)')} AS peak_value_relative_error, {S('abs(sum(c)-sum(t))/sum(t)')} AS plane_flux_relative_error FROM pairs GROUP BY frame""", TC)
def agg15(spark, sf):
    out = M.image_metrics(_pairs(spark, sf), ["frame"])
    return _rounded(out, 6, "relative_rmse", "relative_mae", "centroid_offset_pixels", "peak_value_relative_error", "plane_flux_relative_error")


SERIES = f"{PAIRS}, s AS (SELECT iy, frame, sum(t) AS t, sum(c) AS c FROM pairs GROUP BY ALL)"


def _series(spark, sf):
    return _pairs(spark, sf).groupBy("iy", "frame").agg(F.sum("truth").alias("truth"), F.sum("candidate").alias("candidate"))


_BAND = "CASE WHEN f>=3e-2 AND f<3e-1 THEN 'low_0.03_0.3GHz' WHEN f>=3e-1 AND f<3e0 THEN 'mid_0.3_3GHz' WHEN f>=3e0 AND f<=1e1 THEN 'high_3_10GHz' END"


@query("agg16_band_metrics", f"""WITH {SERIES}, f AS (SELECT *, (frame*frame)/15e0 AS f FROM s), b AS (SELECT *, {_BAND} AS band FROM f),
m AS (SELECT iy, band, coalesce(sqrt(avg(({_RELATIVE})*({_RELATIVE}))),0e0) AS rms, sum(t) AS t, sum(c) AS c FROM b WHERE band IS NOT NULL GROUP BY ALL)
SELECT k.iy, n.band, {S('coalesce(rms,0e0)')} AS rms_relative_error, {S('coalesce(t,0e0)', 5)} AS flux_theory, {S('coalesce(c,0e0)', 5)} AS flux_reconstructed, {S('CASE WHEN t>0 THEN abs(c-t)/t ELSE 0e0 END')} AS flux_relative_error
FROM (SELECT DISTINCT iy FROM s) k CROSS JOIN (SELECT unnest(['low_0.03_0.3GHz','mid_0.3_3GHz','high_3_10GHz']) AS band) n LEFT JOIN m ON m.iy=k.iy AND m.band=n.band""", TC)
def agg16(spark, sf):
    out = M.band_metrics(_series(spark, sf).withColumn("freq_ghz", F.col("frame") * F.col("frame") / 15.0), ["iy"])
    return _rounded(_rounded(out, 6, "rms_relative_error", "flux_relative_error"), 5, "flux_theory", "flux_reconstructed")


@query("agg17_spectrum_error", f"WITH {SERIES} SELECT iy, {S(f'sqrt(avg(({_RELATIVE})*({_RELATIVE})))')} AS rms_relative_error FROM s GROUP BY iy", TC)
def agg17(spark, sf):
    return _rounded(M.spectrum_error(_series(spark, sf), ["iy"]), 6, "rms_relative_error")


@query("agg20_relative_l1", f"""WITH {SERIES}, m AS (SELECT iy, max(abs(t))*1e-12 AS fl FROM s GROUP BY iy)
SELECT s.iy, {S('sum(abs(c-t))/sum(abs(t))')} AS relative_l1, {S('max(abs(c-t)/greatest(abs(t),fl))')} AS max_relative FROM s JOIN m ON m.iy=s.iy GROUP BY s.iy""", TC)
def agg20(spark, sf):
    return _rounded(M.series_difference(_series(spark, sf), ["iy"]), 6, "relative_l1", "max_relative")


@query("jon9_series", f"SELECT t.ix, t.frame, t.value AS truth, c.value AS candidate FROM (SELECT ix, frame, max(value) AS value FROM truth GROUP BY ALL) t JOIN (SELECT ix, frame, max(value) AS value FROM candidate GROUP BY ALL) c ON c.ix=t.ix AND c.frame=t.frame", TC)
def jon9(spark, sf):
    def top(df: DataFrame) -> DataFrame:
        return df.groupBy("ix", "frame").agg(F.max("value").alias("value"))

    return M.match_series(top(T.truth(spark, sf)), top(T.candidate(spark, sf)), ["ix"], "frame", "value")


@query("agg28_latest_per_case", 'SELECT "case", frame, particle_count, frame_seconds FROM timing t WHERE frame=(SELECT max(frame) FROM timing u WHERE u."case"=t."case")', ("timing",))
def agg28(spark, sf):
    return M.latest_per_case(T.timing(spark, sf), ["case"], ["particle_count", "frame_seconds"])


@query("agg29_speedup", f"""WITH l AS (SELECT "case", sum(frame_seconds) AS s FROM timing GROUP BY 1)
SELECT "case", {S("(SELECT s FROM l WHERE \"case\"='1-URGENT')/s", 8)} AS speedup FROM l""", ("timing",))
def agg29(spark, sf):
    total = T.timing(spark, sf).groupBy("case").agg(F.sum("frame_seconds").alias("elapsed_seconds"))
    return M.speed_up(total, "1-URGENT").select("case", snap(F.col("speedup"), 8).alias("speedup"))


@query("agg31_spectra_range", "SELECT min(CASE WHEN l>0 THEN l END) AS x_min, max(CASE WHEN r>0 THEN r END) AS x_max FROM (SELECT value-1e1 AS l, value AS r FROM events)")
def agg31(spark, sf):
    edges = T.table(spark, sf, "events").select((F.col("value") - 10.0).alias("energy_left_kev"), F.col("value").alias("energy_right_kev"))
    return M.spectra_range(edges)


@query("agg33_validation_summary", f"""
WITH {_HIST_SQL}, g AS (SELECT frame, CASE WHEN {_ACCEPT} THEN -slope ELSE 4e0 END AS gd, q AS gr FROM ({_quality(_fit_sql('frame,', 'h'))})),
n AS (SELECT frame, count(*) FILTER ({_ACCEPT}) AS accepted FROM ({_quality(_fit_sql('frame, iy, ix,', 'h'))}) GROUP BY frame), {PAIRS},
m AS (SELECT frame, avg(abs(c-t)) AS mae, sqrt(avg((c-t)*(c-t))) AS rmse, avg(abs({_RELATIVE})) AS rmae, sqrt(avg(({_RELATIVE})*({_RELATIVE}))) AS rrmse, max(t) AS pt, max(c) AS pc FROM pairs GROUP BY frame),
x AS (SELECT frame, ix, sum(t) AS t, sum(c) AS c FROM pairs GROUP BY ALL), e AS (SELECT frame, sqrt(avg(({_RELATIVE})*({_RELATIVE}))) AS rms FROM x GROUP BY frame)
SELECT g.frame, coalesce(accepted,0) AS accepted_local_fits, {S('gd', 5)} AS global_power_law_index, {S('gr', 5)} AS global_power_law_r_squared, {S('mae', 5)} AS mae, {S('rmse', 5)} AS rmse, {S('rmae', 5)} AS relative_mae,
 {S('rrmse', 5)} AS relative_rmse, {S('pt', 5)} AS peak_theory, {S('pc', 5)} AS peak_reconstructed, {S('abs(pc-pt)/pt', 5)} AS peak_relative_error, {S('rms', 5)} AS rms_relative_error
FROM g JOIN n ON n.frame=g.frame JOIN m ON m.frame=g.frame JOIN e ON e.frame=g.frame""", ("particles", *TC))
def agg33(spark, sf):
    fits = fit.power_law_map(_edged(_cell_hist(spark, sf)), ["frame"], 12, 16)
    pairs = _pairs(spark, sf)
    out = M.validation_summary(fits, pairs, ["ix"], ["frame"])
    return out.select("frame", "accepted_local_fits", *[snap(F.col(c), 5).alias(c) for c in out.columns if c not in ("frame", "accepted_local_fits")])


_GROUP_METRICS = {"mae": "avg(abs(c-t))", "rmse": "sqrt(avg((c-t)*(c-t)))", "relative_mae": f"avg(abs({_RELATIVE}))", "relative_rmse": f"sqrt(avg(({_RELATIVE})*({_RELATIVE})))",
                  "peak_theory": "max(t)", "peak_reconstructed": "max(c)", "peak_relative_error": "abs(max(c)-max(t))/max(t)", "flux_relative_error": "abs(sum(c)-sum(t))/sum(t)",
                  "centroid_offset_pixels": "sqrt((sum(c*ix)/sum(c)-sum(t*ix)/sum(t))*(sum(c*ix)/sum(c)-sum(t*ix)/sum(t))+(sum(c*iy)/sum(c)-sum(t*iy)/sum(t))*(sum(c*iy)/sum(c)-sum(t*iy)/sum(t)))"}
_GROUP_SELECT = " UNION ALL ".join(f"SELECT frame, kind || '/' || name || '/{m}' AS metric, {m} AS value FROM g" for m in _GROUP_METRICS)


@query("validation_groups", f"""
WITH {PAIRS}, r AS (SELECT frame, iy, ix, 'parameter_metrics' AS kind, 'density' AS name, t, c FROM pairs UNION ALL SELECT frame, iy, ix, 'parameter_metrics', 'density_by_row', t*(iy+1), c*(iy+1) FROM pairs
 UNION ALL SELECT frame, iy, ix, 'morphology_metrics', 'plane ' || CAST(ix % 4 AS VARCHAR), t, c FROM pairs),
g AS (SELECT frame, CASE WHEN grouping(kind)=1 THEN 'all' ELSE kind END AS kind, CASE WHEN grouping(name)=1 THEN 'all' ELSE name END AS name, {', '.join(f'{e} AS {m}' for m, e in _GROUP_METRICS.items())}
 FROM r GROUP BY GROUPING SETS ((frame, kind, name), (frame, kind), (frame))),
m AS ({_GROUP_SELECT}) SELECT frame, 'groups/' || metric AS metric, {S('value', 5)} AS value FROM m UNION ALL SELECT frame, 'summary/pixels', CAST(count(*) AS DOUBLE) FROM pairs GROUP BY frame""", TC)
def validation_groups(spark, sf):
    """The validation report of each frame as one nested document, written and opened again."""
    pairs = _pairs(spark, sf)

    def of(kind: str, name, factor) -> DataFrame:
        return pairs.select("frame", "iy", "ix", F.lit(kind).alias("kind"), name.alias("name"), (F.col("truth") * factor).alias("truth"), (F.col("candidate") * factor).alias("candidate"))

    rows = (of("parameter_metrics", F.lit("density"), F.lit(1.0)).unionByName(of("parameter_metrics", F.lit("density_by_row"), F.col("iy") + 1.0))
            .unionByName(of("morphology_metrics", F.concat(F.lit("plane "), (F.col("ix") % 4).cast("string")), F.lit(1.0))))
    summary = pairs.groupBy("frame").agg(F.count(F.lit(1)).alias("pixels"))
    documents = M.validation_documents(M.validation_groups(rows, ["frame"]), ["frame"], summary)
    path = scratch_dir(spark, "validation")
    documents.select("frame", F.to_json("report").alias("value")).write.partitionBy("frame").text(path)
    flat = K.flatten_json(IO.read_metrics(spark, path).select(F.col("json"), IO.folder_name().cast("int").alias("frame")), ["frame"], "json")
    return flat.select("frame", "metric", snap(F.col("value").cast("double"), 5).alias("value"))


# -- run logs -----------------------------------------------------------------------------------------------

@query("src11_step_log", """
WITH l AS (SELECT o_orderpriority AS "case", o_orderkey, CAST((year(o_orderdate)-1995)*12+month(o_orderdate) AS INTEGER) AS frame, floor(o_totalprice)/1e3 AS s FROM orders WHERE o_orderkey % 3 <> 0)
SELECT "case", frame, arg_max(s, o_orderkey) AS frame_seconds FROM l GROUP BY ALL""")
def src11(spark, sf):
    o = T.table(spark, sf, "orders")
    frame = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    step = F.format_string(" Step %d  takes %s seconds, ok", frame, (F.floor("o_totalprice").cast("double") / 1.0e3).cast("string"))
    lines = o.select("o_orderpriority", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, step).otherwise(F.lit("Stepping takes no seconds")).alias("value"))
    path = scratch_dir(spark, "step-logs")
    IO.write_text(lines, path, "o_orderpriority", ["o_orderkey"])
    return IO.read_step_log(spark, path, by_folder=True)


@query("src12_counts", "SELECT l_returnflag AS \"case\", CAST(l_orderkey % 500 AS INTEGER) AS frame, max(l_quantity) AS particle_count FROM lineitem GROUP BY ALL")
def src12(spark, sf):
    t = T.table(spark, sf, "lineitem")
    rows = t.select(F.col("l_returnflag").alias("case"), (F.col("l_orderkey") % 500).alias("iframe"), F.col("l_quantity").alias("nptl"), F.lit("7.5 ").alias("dt"))
    path = scratch_dir(spark, "count-tables")
    # every file begins with the header; the rows of a case go up in quantity from file to file
    (rows.repartitionByRange("case", "nptl").sortWithinPartitions("case", "nptl").write.partitionBy("case")
     .option("header", True).option("sep", "\t").option("ignoreTrailingWhiteSpace", False).csv(path))
    return IO.read_counts(spark, path, by_folder=True)


@query("src13_manifest", "SELECT event_type AS run, 'key' || (user_id % 20) AS key, arg_max('a=' || event_id, event_id) AS value FROM events WHERE user_id % 9 <> 0 GROUP BY ALL")
def src13(spark, sf):
    e = T.table(spark, sf, "events")
    text = F.format_string(" key%d = a=%d ", F.col("user_id") % 20, F.col("event_id"))
    lines = e.select("event_type", "event_id", F.when(F.col("user_id") % 9 == 0, F.lit("# note")).otherwise(text).alias("value"))
    path = scratch_dir(spark, "manifests")
    IO.write_text(lines, path, "event_type", ["event_id"])
    return IO.read_manifest(spark, path, by_folder=True).withColumnRenamed("case", "run")


@query("src11_line_offsets", f"""
WITH l AS (SELECT *, octet_length(encode(t))+1 AS b FROM (SELECT o_orderpriority AS "case", o_orderkey, 'order ' || o_orderkey || ' of ' || o_orderpriority AS t FROM orders))
SELECT "case", o_orderkey, CAST(row_number() OVER w - 1 AS BIGINT) AS line_no, CAST(sum(b) OVER w - b AS BIGINT) AS first_byte FROM l WINDOW w AS (PARTITION BY "case" ORDER BY o_orderkey)""")
def src11_offsets(spark, sf):
    """Numbers and offsets of lines through all files of a case; small splits cut the files in many places."""
    o = T.table(spark, sf, "orders")
    path = scratch_dir(spark, "lines")
    told = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("o_orderpriority"))
    IO.write_text(o.select("o_orderpriority", "o_orderkey", told.alias("value")), path, "o_orderpriority", ["o_orderkey"])
    lines = IO.read_numbered_lines(spark, path).withColumn("case", IO.folder_name())
    sizes = lines.groupBy("case", "path").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("offset") + F.octet_length("value") + 1).alias("bytes"))
    earlier = Window.partitionBy("case").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("path", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "bytes")])
    return lines.join(before, "path").select(
        "case", F.regexp_extract("value", r"^order (\d+) ", 1).cast("long").alias("o_orderkey"),
        (F.col("line_no") + F.col("_n")).alias("line_no"), (F.col("offset") + F.col("_bytes")).alias("first_byte"))


@query("rollup_timing", f"""
SELECT "case", frame, CAST(frame AS DOUBLE)*25e-1 AS physical_time_seconds, particle_count, frame_seconds, {S('sum(frame_seconds) OVER (PARTITION BY "case" ORDER BY frame)', 5)} AS elapsed_seconds, NULL::VARCHAR AS absent FROM timing WHERE "case" <> '5-LOW'
UNION ALL SELECT '5-LOW', NULL, NULL, NULL, NULL, NULL, 'counts' UNION ALL SELECT 'none', NULL, NULL, NULL, NULL, NULL, unnest(['counts', 'steps'])""", ("timing",))
def rollup_timing(spark, sf):
    """Step logs and counts of all priorities but one, whose counts are absent, and a case without any file."""
    t = T.timing(spark, sf)
    root, out = scratch_dir(spark, "run-files"), scratch_dir(spark, "timing")
    step = F.format_string("Step %d takes %s seconds", "frame", F.col("frame_seconds").cast("string"))
    IO.write_text(t.withColumn("value", step), f"{root}/steps", "case", ["frame"])
    counts = t.filter(F.col("case") != "5-LOW").select("case", F.col("frame").alias("iframe"), "particle_count")
    counts.write.partitionBy("case").option("header", True).option("sep", " ").csv(f"{root}/counts")
    cases = [*sorted(_PRIORITIES), "none"]
    absent = rollup.rollup_timing(spark, root, cases, 2.5, out)
    stored = spark.read.option("header", True).schema(
        "case string, frame int, physical_time_seconds double, particle_count double, frame_seconds double, elapsed_seconds double").csv(out)
    return _rounded(stored.unionByName(absent.withColumnRenamed("kind", "absent"), allowMissingColumns=True), 5, "elapsed_seconds")


@query("src15_frame_names", "SELECT CAST((year(l_shipdate)-1995)*12+month(l_shipdate) AS INTEGER) AS frame, 'particles_' || lpad(CAST((year(l_shipdate)-1995)*12+month(l_shipdate) AS VARCHAR),5,'0') || '.bin' AS name, count(*) AS n FROM lineitem GROUP BY ALL")
def src15(spark, sf):
    named = T.particles(spark, sf).withColumn("name", runs.frame_name(F.col("frame")))
    parsed = named.withColumn("frame", runs.frame_number(F.concat(F.lit("/data/run/"), F.col("name"))))
    return parsed.groupBy("frame", "name").agg(F.count(F.lit(1)).alias("n"))


@query("set6_missing_frames", "SELECT DISTINCT frame FROM event_particles WHERE frame NOT IN (SELECT frame FROM event_particles WHERE p > 25e0)", ("event_particles",))
def set6(spark, sf):
    p = T.event_particles(spark, sf)
    return runs.missing_frames(p, p.filter(F.col("p") > 25.0))


@query("jon1_frame_inputs", """
WITH f AS (SELECT frame, min(particle_id) AS a FROM event_particles GROUP BY frame), b AS (SELECT frame, max(particle_id) AS b FROM event_particles WHERE p > 25e0 GROUP BY frame)
SELECT f.frame, 'field' || a AS field_path, 'part' || a AS particle_path, 'bg' || b AS background_path FROM f LEFT JOIN b ON b.frame=f.frame""", ("event_particles",))
def jon1(spark, sf):
    p = T.event_particles(spark, sf)
    first = p.groupBy("frame").agg(F.min("particle_id").alias("k"))

    def paths(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("frame", F.concat(F.lit(prefix), F.col("k").cast("string")).alias("path"))

    last = p.filter(F.col("p") > 25.0).groupBy("frame").agg(F.max("particle_id").alias("k"))
    return runs.frame_inputs(first.select("frame"), paths(first, "field"), paths(first, "part"), paths(last, "bg"))


@query("jon8_step_counts", """
WITH c AS (SELECT o_orderpriority AS "case", CAST((year(o_orderdate)-1995)*12+month(o_orderdate) AS INTEGER) AS frame, count(*) AS n FROM orders GROUP BY ALL)
SELECT t."case", t.frame, frame_seconds, n FROM timing t JOIN c ON c."case"=t."case" AND c.frame=t.frame""", ("timing",))
def jon8(spark, sf):
    t = T.timing(spark, sf)
    counts = t.select("case", "frame", F.col("particle_count").cast("long").alias("n"))
    return runs.join_counts(t.select("case", "frame", "frame_seconds"), counts, ["case"])


@query("srt3_latest_frame", "SELECT status, max(frame) AS frame FROM particles GROUP BY status", ("particles",))
def srt3(spark, sf):
    return runs.latest_frame(T.particles(spark, sf), ["status"])


@query("srt5_missing_preview", """
WITH i AS (SELECT frame, max(CASE WHEN p>25e0 THEN particle_id END) AS a, max(CASE WHEN p>2e1 THEN particle_id END) AS b FROM event_particles GROUP BY frame)
SELECT frame, 'a' AS input FROM i WHERE a IS NULL UNION ALL SELECT frame, 'b' FROM i WHERE b IS NULL ORDER BY frame, input LIMIT 20""", ("event_particles",))
def srt5(spark, sf):
    p = T.event_particles(spark, sf)
    inputs = p.groupBy("frame").agg(F.max(F.when(F.col("p") > 25.0, F.col("particle_id"))).alias("a"),
                                    F.max(F.when(F.col("p") > 20.0, F.col("particle_id"))).alias("b"))
    return runs.missing_inputs(inputs, ["a", "b"]).orderBy("frame", "input").limit(20)


@query("set1_union_cases", """
SELECT 'orders' AS source, "case", frame, frame_seconds, NULL::DOUBLE AS weight FROM timing UNION ALL
SELECT 'particles', 'all', frame, NULL::DOUBLE, sum(weight) FROM particles GROUP BY frame""", ("timing", "particles"))
def set1(spark, sf):
    a = T.timing(spark, sf).select(F.lit("orders").alias("source"), "case", "frame", "frame_seconds")
    b = T.particles(spark, sf).groupBy("frame").agg(F.sum("weight").alias("weight")).withColumns({"source": F.lit("particles"), "case": F.lit("all")})
    return runs.union_cases(a, None, b, columns=["source", "case", "frame", "frame_seconds", "weight"])


@query("snk4_timing_table", f"""
SELECT "case", frame, CAST(frame AS DOUBLE)*25e-1 AS physical_time_seconds, particle_count, frame_seconds, {S('sum(frame_seconds) OVER (PARTITION BY "case" ORDER BY frame)', 5)} AS elapsed_seconds FROM timing""", ("timing",))
def snk4(spark, sf):
    elapsed = runs.running_elapsed(T.timing(spark, sf), ["case"])
    return _rounded(runs.timing_table(elapsed, 2.5), 5, "elapsed_seconds")


@query("snk6_speed_accuracy", f"""WITH {SERIES}, l AS (SELECT "case", max(frame) AS frame, sum(frame_seconds) AS s FROM timing GROUP BY 1), m AS (SELECT iy, max(abs(t))*1e-12 AS fl FROM s GROUP BY iy)
SELECT 'timing' AS metric_type, "case", frame, {S("(SELECT s FROM l WHERE \"case\"='5-LOW')/s", 8)} AS speedup, NULL::DOUBLE AS relative_l1 FROM l UNION ALL
SELECT 'spectrum', CAST(s.iy AS VARCHAR), NULL, NULL, {S('sum(abs(c-t))/sum(abs(t))')} FROM s GROUP BY s.iy""", ("timing", *TC))
def snk6(spark, sf):
    total = T.timing(spark, sf).groupBy("case").agg(F.max("frame").alias("frame"), F.sum("frame_seconds").alias("elapsed_seconds"))
    speed = M.speed_up(total, "5-LOW").select(F.lit("timing").alias("metric_type"), "case", "frame", snap(F.col("speedup"), 8).alias("speedup"))
    error = M.series_difference(_series(spark, sf), ["iy"])
    spectra = error.select(F.lit("spectrum").alias("metric_type"), F.col("iy").cast("string").alias("case"), snap(F.col("relative_l1")).alias("relative_l1"))
    path = scratch_dir(spark, "speed-accuracy")
    IO.write_speed_accuracy(runs.union_cases(speed, spectra), path)
    return spark.read.option("header", True).schema("metric_type string, case string, frame int, speedup double, relative_l1 double").csv(path)


def _wide_csv(spark, sf):
    """All series of the timing table, written as CSV and read back."""
    wide = K.wide_spectrum(T.timing(spark, sf), "frame", "case", "frame_seconds")
    path = scratch_dir(spark, "wide-spectrum")
    IO.write_wide_spectrum(wide, path)
    return spark.read.schema(wide.schema).option("header", True).option("enforceSchema", False).csv(path)


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_WIDE = ", ".join(f"max(CASE WHEN \"case\"='{p}' THEN frame_seconds END) AS \"{p}\"" for p in _PRIORITIES)


@query("snk7_wide_spectrum", f"SELECT frame, {_WIDE} FROM timing GROUP BY frame", ("timing",))
@query("snk7_wide_all_series", f"SELECT frame, {_WIDE} FROM timing GROUP BY frame", ("timing",))
def snk7_all(spark, sf):
    return _wide_csv(spark, sf)


@query("snk1_run_summary", f"""
SELECT frame, CAST(frame AS DOUBLE)*125e-3 AS time, count(*) AS stored, count(*) FILTER (status=0) AS active, coalesce(sum(weight) FILTER (status=0),0e0) AS weight_sum, 0::BIGINT AS injected, 0e0 AS read_seconds FROM particles GROUP BY frame""", ("particles",))
def snk1(spark, sf):
    out = runs.run_summary(runs.frame_summary(T.particles(spark, sf)), 0.125)
    assert len(out.columns) == 22
    return out.select("frame", "time", "stored", "active", "weight_sum", "injected", "read_seconds")


# -- memoized models ------------------------------------------------------------------------------------------

def _cells(spark, sf):
    t = T.truth(spark, sf)
    cells = memo.normalized(t.withColumn("nth", F.col("value") + F.col("iy")), ["nth"], of_peak={"value": F.lit(True)})
    return memo.quantize_keys(cells, {"k1": (F.col("value_norm"), 6), "k2": (F.col("nth_norm"), 5)})


_CELLS_SQL = """n AS (SELECT *, value+iy AS nth FROM truth), m AS (SELECT frame, max(value) AS top, min(nth) AS lo, max(nth) AS hi FROM n GROUP BY frame),
q AS (SELECT n.*, CAST(round_even(greatest(least(value/top,1e0),0e0)*5e0,0) AS INTEGER) AS k1, CAST(round_even(greatest(least((nth-lo)/greatest(hi-lo,1e-12),1e0),0e0)*4e0,0) AS INTEGER) AS k2 FROM n JOIN m ON m.frame=n.frame),
r AS (SELECT frame, k1, k2, arg_min(value, iy*16+ix) AS v0, arg_min(nth, iy*16+ix) AS n0 FROM q GROUP BY ALL)"""


def _model(representatives: DataFrame) -> DataFrame:
    """A user-supplied source model: one vectorized pandas function."""
    @F.pandas_udf(DoubleType())
    def flux(value: pd.Series, nth: pd.Series) -> pd.Series:
        return value * 3.0 + nth / (value + 1.0)

    return representatives.withColumn("flux", flux("value", "nth"))


@query("jon13_memo_join", f"WITH {_CELLS_SQL} SELECT q.frame, iy, ix, q.k1, q.k2, {S('v0*3e0+n0/(v0+1e0)')} AS flux FROM q JOIN r ON r.frame=q.frame AND r.k1=q.k1 AND r.k2=q.k2", ("truth",))
def jon13(spark, sf):
    order = [F.col("iy") * 16 + F.col("ix")]
    out = memo.evaluate_once(_cells(spark, sf), ["k1", "k2"], ["value", "nth"], order,
                             _model, ["flux"], ("frame",))
    return out.select("frame", "iy", "ix", "k1", "k2", snap(F.col("flux")).alias("flux"))


@query("jon13_rounded_keys", """SELECT round_even(value,0) AS key, count(*) AS n, arg_min(value, event_id) AS representative FROM events GROUP BY 1""")
def jon13_rounded(spark, sf):
    e = memo.rounded_keys(T.table(spark, sf, "events"), {"key": "value"}, 0)
    return e.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "event_id").alias("representative"))


@query("udf3_reference_variants", f"""
WITH p AS (SELECT p_partkey, p_retailprice-9e2 AS n, p_size/1e1 AS t, CAST(p_size AS DOUBLE) AS d FROM part)
SELECT p_partkey, variant, {S("CASE variant WHEN 'thermal_only' THEN 1e-9 ELSE n END", 10)} AS n, {S("CASE variant WHEN 'no_razin_density_proxy' THEN least(t,1e-6) ELSE t END", 8)} AS t, {S("CASE variant WHEN 'optically_thin_proxy' THEN greatest(d*1e-5,8e-5) ELSE d END", 9)} AS depth,
 {S("CASE variant WHEN 'optically_thin_proxy' THEN d/greatest(d*1e-5,8e-5) ELSE 1e0 END", 3)} AS rescale
FROM p CROSS JOIN (SELECT unnest(['full','thermal_only','no_razin_density_proxy','optically_thin_proxy']) AS variant)""")
def udf3(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") - 900.0).alias("nonthermal_density_1e7"),
                                          (F.col("p_size") / 10.0).alias("thermal_density_1e9"), F.col("p_size").cast("double").alias("los_depth_arcsec"))
    out = memo.reference_variants(p)
    return out.select("p_partkey", "variant", snap(F.col("nonthermal_density_1e7"), 10).alias("n"), snap(F.col("thermal_density_1e9"), 8).alias("t"),
                      snap(F.col("los_depth_arcsec"), 9).alias("depth"), snap(F.col("rescale"), 3).alias("rescale"))


@query("jon10_assemble_cells", """
SELECT t.frame, t.iy, t.ix, t.value AS density, c.value AS field, 5e0 AS thermal, t.value+1e0 AS index FROM truth t JOIN candidate c ON c.frame=t.frame AND c.iy=t.iy AND c.ix=t.ix""", TC)
def jon10(spark, sf):
    t, c = T.truth(spark, sf), T.candidate(spark, sf)
    background = memo.constant_provider(thermal=5.0)(t.select(*CELL))
    return memo.assemble_cells(CELL, t.withColumnRenamed("value", "density"), c.withColumnRenamed("value", "field"), background,
                               t.select(*CELL, (F.col("value") + 1.0).alias("index")))


@query("jon12_spectrum_algebra", f"""
WITH a AS (SELECT frame, ix, iy, value AS l, value*2e0 AS r FROM truth), b AS (SELECT frame, ix, iy, value*5e-1 AS l, value AS r FROM candidate)
SELECT a.frame, a.iy, a.ix, {S('a.l*3e0-b.l')} AS left_flux, {S('(a.l+a.r)*3e0-(b.l+b.r)')} AS total, {S('((a.r-a.l)*3e0-(b.r-b.l))/nullif((a.l+a.r)*3e0-(b.l+b.r),0)')} AS degree FROM a JOIN b ON b.frame=a.frame AND b.iy=a.iy AND b.ix=a.ix""", TC)
def jon12(spark, sf):
    def spectrum(df: DataFrame, left: float, right: float) -> DataFrame:
        lo, hi = F.col("value") * left, F.col("value") * right
        return df.select(*CELL, lo.alias("left"), hi.alias("right"), (lo + hi).alias("total"), (hi - lo).alias("circular"))

    a, b = spectrum(T.truth(spark, sf), 1.0, 2.0), spectrum(T.candidate(spark, sf), 0.5, 1.0)
    out = memo.spectrum_difference(memo.scale_spectrum(a, 3.0), b, CELL)
    return out.select(*CELL, snap(F.col("left")).alias("left_flux"), snap(F.col("total")).alias("total"), snap(F.col("degree")).alias("degree"))


@query("udf5_providers", f"""
SELECT t.frame, t.iy, t.ix, 7e0 AS temperature, {S('t.ix*2e0+t.iy', 6)} AS field, c.value AS thermal FROM truth t LEFT JOIN candidate c ON c.frame=t.frame AND c.iy=t.iy AND c.ix=t.ix""", TC)
def udf5(spark, sf):
    cells = T.truth(spark, sf).select(*CELL, F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"))
    cells = memo.constant_provider(temperature=7.0)(cells)
    cells = memo.function_provider(field=lambda x, y: x * 2.0 + y)(cells)
    cells = memo.table_provider(T.candidate(spark, sf).withColumnRenamed("value", "thermal"), CELL)(cells)
    return cells.select(*CELL, "temperature", snap(F.col("field")).alias("field"), "thermal")


@query("udf4_spectral_fit", f"""
WITH o AS (SELECT vec_id, CAST(k AS DOUBLE) AS freq, abs(CAST(embedding[k] AS DOUBLE)) AS obs FROM (SELECT vec_id, embedding, unnest(range(1,65)) AS k FROM embeddings))
SELECT vec_id, {S('regr_slope(log10(obs),log10(freq))')} AS slope, {S('regr_intercept(log10(obs),log10(freq))')} AS intercept, 64 AS points FROM o WHERE obs>0 GROUP BY vec_id""")
def udf4(spark, sf, solver=None):
    t = T.table(spark, sf, "embeddings")
    obs = t.select("vec_id", F.posexplode("embedding").alias("k", "v")).select(
        "vec_id", (F.col("k") + 1).cast("double").alias("freq"), F.abs(F.col("v").cast("double")).alias("obs"), F.lit(0.1).alias("err"))
    out = fit.fit_spectra(obs, ["vec_id"], solver)
    return out.select("vec_id", snap(F.get("params", F.lit(0))).alias("slope"), snap(F.get("params", F.lit(1))).alias("intercept"), F.size("spec").alias("points"))


@query("udf4_user_solver", SQL["udf4_spectral_fit"])
def udf4_user_solver(spark, sf):
    return udf4(spark, sf, fit.log_polynomial_fit)


# -- catalogs ----------------------------------------------------------------------------------------------------

_UNIT = """CASE WHEN lower(path) LIKE '%brightness\\_temperature%' ESCAPE '\\' THEN 'K' WHEN lower(path) LIKE '%specific%' THEN 'erg s^-1 cm^-2 Hz^-1 sr^-1' WHEN lower(path) LIKE '%flux\\_sfu%' ESCAPE '\\' THEN 'sfu'
 WHEN lower(path) LIKE '%density\\_cm3%' ESCAPE '\\' THEN 'cm^-3' WHEN lower(path) LIKE '%freq\\_hz%' ESCAPE '\\' THEN 'Hz' WHEN lower(path) LIKE '%index%' THEN '' ELSE '' END"""


@query("prj34_units", f"SELECT product, path, {_UNIT} AS unit, regexp_matches(lower(path), 'references/|diagnostics/|components/') AS component FROM catalog", ("catalog",))
def prj34(spark, sf):
    return T.catalog(spark, sf).select("product", "path", K.infer_unit(F.col("path")).alias("unit"), K.is_component_path(F.col("path")).alias("component"))


@query("prj36_kinds", """
SELECT product, path, CASE WHEN is_text THEN 'text' WHEN lower(path) LIKE '%freq%' AND len(shape)=1 AND shape[1]>1 AND positive THEN 'vector' WHEN len(shape)=3 AND shape[1]=18 THEN 'cube' WHEN len(shape)=2 THEN 'map'
 WHEN len(shape)=1 AND shape[1]=18 THEN 'spectrum' WHEN len(shape)=0 THEN 'scalar' WHEN len(shape)=1 AND shape[1]=1 THEN 'scalar' ELSE 'vector' END AS kind FROM catalog""", ("catalog",))
def prj36(spark, sf):
    kind = K.dataset_kind(F.col("path"), F.col("is_text"), F.col("shape"), F.col("positive"), F.lit(18))
    return T.catalog(spark, sf).select("product", "path", kind.alias("kind"))


@query("src18_frequency_path", "SELECT product, coalesce(min(path) FILTER (suffix(path,'freq_hz')), min(path)) AS frequency_path FROM catalog WHERE lower(path) LIKE '%freq%' AND len(shape)=1 AND shape[1]>1 AND positive GROUP BY product", ("catalog",))
def src18(spark, sf):
    return K.frequency_path(T.catalog(spark, sf), ["product"])


_LEAF = "regexp_extract({p}, '[^/]*$')"


@query("flt11_same_leaf", f"""
WITH s AS (SELECT product, min(path) AS selected FROM catalog GROUP BY product)
SELECT c.product, s.selected, c.path FROM s JOIN catalog c ON c.product=s.product AND c.path<>s.selected AND {_LEAF.format(p='c.path')}={_LEAF.format(p='s.selected')}""", ("catalog",))
def flt11(spark, sf):
    c = T.catalog(spark, sf)
    return K.same_leaf(c, c.groupBy("product").agg(F.min("path").alias("path")), ["product"])


@query("jon11_pairs", f"""
WITH c AS (SELECT product, path, CASE WHEN path LIKE 'reconstruction/%' THEN 'truth/' || substr(path,16) WHEN path LIKE 'truth/%' THEN 'reconstruction/' || substr(path,7) WHEN path LIKE 'image/full/%' THEN 'image/beam/' || substr(path,12)
  WHEN path LIKE 'image/beam/%' THEN 'image/full/' || substr(path,12) END AS swap FROM catalog)
SELECT c.product, c.path, coalesce((SELECT path FROM catalog d WHERE d.product=c.product AND d.path=c.swap), (SELECT min(path) FROM catalog e WHERE e.product=c.product AND e.path<>c.path AND {_LEAF.format(p='e.path')}={_LEAF.format(p='c.path')})) AS comparison FROM c""", ("catalog",))
def jon11(spark, sf):
    return K.comparison_pairs(T.catalog(spark, sf), ["product"])


@query("prj23_polarization_entries", f"""
WITH s(k, i, p, n) AS (VALUES (0,'I_flux_sfu','V_flux_sfu','circular_degree'),(1,'I_specific','V_specific','circular_degree'),(2,'I_brightness_temperature','V_brightness_temperature','circular_degree'),(3,'I_flux_sfu','linear_flux_sfu','linear_degree'),(4,'I_specific','linear_specific','linear_degree')),
j AS (SELECT a.product, substr(a.path,1,len(a.path)-len(s.i)) || n AS path, s.k, CASE WHEN a.value<>0 THEN b.value/nullif(a.value,0) END AS r FROM catalog a JOIN s ON suffix(a.path, s.i) JOIN catalog b ON b.product=a.product AND b.path=substr(a.path,1,len(a.path)-len(s.i)) || s.p)
SELECT product, path, CASE WHEN arg_max(CASE WHEN r IS NULL THEN -1e0 ELSE r END, k)=-1e0 THEN -1e0 ELSE {S('arg_max(CASE WHEN r IS NULL THEN -1e0 ELSE r END, k)', 7)} END AS value FROM j GROUP BY ALL""", ("catalog",))
def prj23(spark, sf):
    out = K.polarization_entries(T.catalog(spark, sf), ["product"])
    return out.select("product", "path", F.when(F.isnan("value"), -1.0).otherwise(snap(F.col("value"), 7)).alias("value"))


@query("jsn1_flatten", """
SELECT event_id, 'props/k' AS metric, CAST(props->>'$.k' AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'band.GHz/deep/user', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'name', '{' || event_type FROM events""")
def jsn1(spark, sf):
    nested = F.format_string('{"props": %s, "band.GHz": {"deep": {"user": %d}}, "name": "{%s"}', "props", "user_id", "event_type")
    return K.flatten_json(T.table(spark, sf, "events").select("event_id", nested.alias("j")), ["event_id"], "j")


@query("src14_metrics", """SELECT event_type, 'props/k' AS metric, sum(CAST(props->>'$.k' AS BIGINT))::BIGINT AS total FROM events GROUP BY ALL""")
def src14(spark, sf):
    """One document of nested sums a file, by type and day of the week; a document is bounded, their number is too."""
    e = T.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    sums = e.groupBy("event_type", F.dayofweek("ts").alias("day")).agg(F.sum(k).alias("k"))
    path = scratch_dir(spark, "metrics")
    document = F.to_json(F.struct(F.struct("k").alias("props"), F.struct(F.struct("day").alias("of")).alias("about")))
    sums.select("event_type", "day", document.alias("value")).repartition("event_type", "day").write.partitionBy("event_type", "day").text(path)
    flat = K.flatten_json(IO.read_metrics(spark, path), ["path"], "json").filter(F.col("metric") == "props/k")
    event_type = F.regexp_extract("path", "event_type=([^/]*)/", 1)
    return flat.groupBy(event_type.alias("event_type"), "metric").agg(F.sum(F.col("value").cast("long")).alias("total"))


@query("src16_file_listing", "SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status FROM lineitem WHERE l_returnflag <> 'R'")
def src16_files(spark, sf):
    """Files found below a folder by suffix and keywords, without reading them."""
    path = scratch_dir(spark, "products")
    T.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).write.partitionBy("l_returnflag", "l_linestatus").parquet(path)
    found = K.product_listing(IO.list_files(spark, path), (".parquet",), ("l_linestatus=",), "l_returnflag=R")
    return found.select(F.regexp_extract("path", "l_returnflag=([^/]*)", 1).alias("flag"), F.regexp_extract("path", "l_linestatus=([^/]*)", 1).alias("status")).distinct()


@query("src16_listing", "SELECT DISTINCT url AS path FROM pages WHERE (suffix(lower(url),'=x') OR suffix(lower(url),'#top')) AND contains(url,'example') AND NOT contains(url,'/de/')")
def src16(spark, sf):
    return K.product_listing(T.table(spark, sf, "pages"), ("=x", "#top"), ("example",), "/de/", path="url").withColumnRenamed("url", "path")


# -- data quality ---------------------------------------------------------------------------------------------------

@query("dq1_headers", """
WITH h AS (SELECT p_partkey, p_size % 5 AS dim, p_size AS n, CASE WHEN p_size % 7=0 THEN p_size-1 ELSE p_size END AS cap, p_retailprice-950e0 AS mass FROM part)
SELECT 'space_dim' AS "check", CAST(p_partkey AS VARCHAR) AS key, CAST(dim AS VARCHAR) AS detail FROM h WHERE NOT dim BETWEEN 1 AND 3 UNION ALL SELECT 'particle_capacity', CAST(p_partkey AS VARCHAR), CAST(cap AS VARCHAR) FROM h WHERE cap<n
UNION ALL SELECT 'rest_mass', CAST(p_partkey AS VARCHAR), 'bad' FROM h WHERE mass<=0""")
def dq1(spark, sf):
    size = F.col("p_size")
    headers = T.table(spark, sf, "part").select("p_partkey", (size % 5).alias("space_dim"), size.alias("particle_count"), F.when(size % 7 == 0, size - 1).otherwise(size).alias("particle_capacity"),
                                                (F.col("p_retailprice") - 950.0).alias("rest_mass"), F.lit(1.0).alias("charge"), F.lit(1.0).alias("speed_of_light"), F.lit(1.0).alias("energy_scale_erg"))
    out = quality.header_ranges(headers, "p_partkey")
    return out.withColumn("detail", F.when(F.col("check") == "rest_mass", "bad").otherwise(F.col("detail")))


@query("dq2_values", """
WITH v AS (SELECT c_custkey, c_acctbal FROM customer)
SELECT 'c_acctbal' AS "check", CAST(c_custkey AS VARCHAR) AS key FROM v WHERE c_acctbal<0 UNION ALL
SELECT 'cell_count', CAST(c_nationkey AS VARCHAR) FROM customer GROUP BY c_nationkey HAVING count(*)<>60""")
def dq2(spark, sf):
    c = T.table(spark, sf, "customer")
    return quality.value_columns(c, F.col("c_custkey"), ["c_acctbal"]).unionByName(quality.cell_counts(c, ["c_nationkey"], 60)).select("check", "key")


@query("dq3_edges", """
WITH a AS (SELECT vec_id, k AS i, CAST(embedding[k] AS DOUBLE)+k*2e-1 AS edge FROM (SELECT vec_id, embedding, unnest(range(1,65)) AS k FROM embeddings)), l AS (SELECT *, lag(edge) OVER (PARTITION BY vec_id ORDER BY i) AS prev FROM a)
SELECT 'ascending' AS "check", vec_id || '/' || i AS key FROM l WHERE edge<=prev""")
def dq3(spark, sf):
    t = T.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    axes = t.select("vec_id", (F.col("k") + 1).alias("i"), (F.col("v").cast("double") + (F.col("k") + 1) * 0.2).alias("edge"))
    return quality.edges(axes, ["vec_id"]).select("check", "key")


_UNIFORM = """
WITH a AS (SELECT vec_id, k AS i, CAST(embedding[k] AS DOUBLE)*1e-2+k*25e-2 AS edge FROM (SELECT vec_id, embedding, unnest(range(1,65)) AS k FROM embeddings)),
l AS (SELECT *, edge-lag(edge) OVER (PARTITION BY vec_id ORDER BY i) AS here FROM a), s AS (SELECT vec_id, max(edge)-min(edge) AS span, count(edge) AS n FROM a GROUP BY vec_id)
SELECT 'uniform' AS "check", l.vec_id || '/' || i AS key FROM l JOIN s ON s.vec_id=l.vec_id
WHERE abs(here-span/greatest(n-1,1)) > greatest(abs(span), abs(span/greatest(n-1,1)), abs(here), 1e0)*1024e0/4503599627370496e0"""


@query("dq3_uniform_edges", _UNIFORM)
@query("dq3_uniform_all_edges", _UNIFORM)
def dq3_uniform_all(spark, sf):
    t = T.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    axes = t.select("vec_id", (F.col("k") + 1).alias("i"), (F.col("v").cast("double") * 0.01 + (F.col("k") + 1) * 0.25).alias("edge"))
    return quality.edges(axes, ["vec_id"], uniform=True).filter(F.col("check") == "uniform").select("check", "key")


@query("dq4_frequency_grid", """
WITH a AS (SELECT vec_id, k AS freq_idx, CAST(embedding[k] AS DOUBLE)+k*2e-1-5e-1 AS f FROM (SELECT vec_id, embedding, unnest(range(1,65)) AS k FROM embeddings)), l AS (SELECT *, lag(f) OVER (PARTITION BY vec_id ORDER BY freq_idx) AS prev FROM a)
SELECT "check", count(*) AS n FROM (SELECT 'positive' AS "check" FROM l WHERE f<=0 UNION ALL SELECT 'increasing' FROM l WHERE f<=prev) GROUP BY 1""")
def dq4(spark, sf):
    t = T.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    bands = t.select("vec_id", (F.col("k") + 1).alias("freq_idx"), (F.col("v").cast("double") + (F.col("k") + 1) * 0.2 - 0.5).alias("freq_hz"))
    return quality.frequency_grid(bands, ["vec_id"]).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


@query("dq5_time", """
WITH s AS (SELECT o_orderkey, CAST((year(o_orderdate)-1995)*12+month(o_orderdate) AS INTEGER) AS frame FROM orders)
SELECT 'time' AS "check", CAST(o_orderkey AS VARCHAR) AS key FROM s WHERE o_orderkey % 10=7 AND frame<>0""")
def dq5(spark, sf):
    frame = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("int")
    s = T.table(spark, sf, "orders").select("o_orderkey", frame.alias("frame"))
    s = s.withColumn("time", F.col("frame") * 0.5 * F.when(F.col("o_orderkey") % 10 == 7, 1.0 + 1.0e-9).otherwise(1.0))
    return quality.time_consistency(s, 0.5, F.col("o_orderkey")).select("check", "key")


@query("dq5_last_frame", """
WITH l AS (SELECT user_id, max(frame) AS frame FROM event_particles GROUP BY user_id)
SELECT 'last_frame' AS "check", CAST(l.user_id AS VARCHAR) AS key, CAST(l.frame AS VARCHAR) AS detail FROM l WHERE NOT EXISTS (SELECT 1 FROM event_particles e WHERE e.user_id=l.user_id AND e.frame=l.frame AND e.status=0)""", ("event_particles",))
def dq5_last(spark, sf):
    p = T.event_particles(spark, sf)
    return quality.last_frame_present(p, p.filter(F.col("status") == 0), ["user_id"])


@query("dq6_metadata", """SELECT 'p_size' AS "check", CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_size<>25 UNION ALL SELECT 'p_retailprice', CAST(p_partkey AS VARCHAR) FROM part WHERE abs(p_retailprice-95e1)>1e-6""")
def dq6(spark, sf):
    t = T.table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return quality.metadata(t, {"p_size": 25.0, "p_retailprice": 950.0}, "p_partkey").select("check", "key")


@query("dq7_regions", """
SELECT 'x' AS "check", CAST(event_id AS VARCHAR) AS key FROM events WHERE value<=2e1 UNION ALL SELECT 'weight', CAST(user_id AS VARCHAR) FROM events GROUP BY user_id HAVING sum(value-3e1)<-1e-3""")
def dq7(spark, sf):
    e = T.table(spark, sf, "events")
    regions = quality.region_bounds(e.select("event_id", F.lit(20.0).alias("x_lo"), F.col("value").alias("x_hi")), "event_id", ["x"])
    moments = e.groupBy("user_id").agg(F.sum(F.col("value") - 30.0).alias("weight_sum"), F.min("value").alias("min_energy_ev"), F.max("value").alias("max_energy_ev")).withColumns(
        {"mean_mu": F.lit(0.0), "var_mu": F.lit(0.0), "viewing_angle": F.lit(1.0)})
    return regions.unionByName(quality.particle_moments(moments, F.col("user_id"))).select("check", "key")


@query("dq8_singularities", """SELECT 'singular' AS "check", CAST(event_id AS VARCHAR) AS key FROM events WHERE user_id % 6=0 OR value<1e0""")
def dq8(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.when(F.col("value") < 1.0, 0.0).otherwise(F.col("value")).alias("r"), (F.col("user_id") % 6).cast("double").alias("theta"))
    return quality.grid_singularities(e, F.col("event_id"), "spherical", ["r", "theta"]).select("check", "key")


@query("dq9_payload", """SELECT CASE WHEN length(text)<500 THEN 'short' ELSE 'trailing' END AS "check", CAST(doc_id AS VARCHAR) AS key FROM documents WHERE length(text)<>500""")
def dq9(spark, sf):
    files = T.table(spark, sf, "documents").select("doc_id", F.length("text").alias("length"))
    return quality.payload_size(files, F.lit(500), "doc_id").select("check", "key")
