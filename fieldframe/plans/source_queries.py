"""Queries that write files from the tables and read them back, streams and whole pipelines."""

from __future__ import annotations

from dataclasses import fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from fieldframe.functions import constants as C
from fieldframe.functions import kinematics as K
from fieldframe.functions.axes import Axis
from fieldframe.operators import binning as B
from fieldframe.operators import compare, runs
from fieldframe.plans import emission, rollup, sample_files, spectral_fit
from fieldframe.plans import tables as T
from fieldframe.plans.grid_queries import X, Y
from fieldframe.functions.radiometry import SIGMA_PER_FWHM, voxel_volume_cm3
from fieldframe.plans.particle_queries import _ACCEPT, HISTOGRAM_SQL, _fit_sql, _quality, histogram_rounded
from fieldframe.plans.registry import number as D
from fieldframe.plans.registry import query, snap
from fieldframe.plans.registry import sql_snap as S
from fieldframe.session import materialize, scratch_dir
from fieldframe.sources import register_all
from fieldframe.sources import tables as IO
from fieldframe.streaming import frames as ST
from fieldframe.streaming.store import FrameStore

NX, NY = T.GRID_NX, T.GRID_NY


@query("src1_particle_snapshot", """
SELECT frame, count(*) AS n, sum(weight) AS weight, max(p) AS p_max, min(x) AS x_min, max(y) AS y_max, sum(particle_id)::BIGINT AS ids, count(*) FILTER (status=0) AS active, min(x)-1e0 AS prev_min FROM particles GROUP BY frame""", ("particles",))
def src1(spark, sf):
    folder = scratch_dir(spark, "particles")
    sample_files.write_particles(T.particles(spark, sf), folder)
    register_all(spark)
    rows = spark.read.format("particle_snapshot").option("targetBytes", 100_000).option("pieces", 256).schema(
        "frame int, particle_id bigint, status int, x double, y double, prev_x double, p double, weight double").load(folder)
    return rows.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.max("p").alias("p_max"), F.min("x").alias("x_min"),
        F.max("y").alias("y_max"), F.sum("particle_id").alias("ids"), F.count(F.when(F.col("status") == 0, 1)).alias("active"),
        F.min("prev_x").alias("prev_min"))


@query("src2_snapshot_headers", "SELECT frame, count(*) AS particle_count, 4 AS version, 2e0 AS speed_of_light FROM particles GROUP BY frame", ("particles",))
def src2(spark, sf):
    folder = scratch_dir(spark, "particles")
    sample_files.write_particles(T.particles(spark, sf), folder)
    register_all(spark)
    headers = spark.read.format("particle_snapshot").option("what", "header").load(folder)
    return headers.groupBy("frame").agg(F.sum("particle_count").alias("particle_count"), F.max("version").alias("version"),
                                        F.max("speed_of_light").alias("speed_of_light"))


def _field_files(spark, sf, prefix, encode) -> str:
    folder = scratch_dir(spark, prefix)
    sample_files.write_frames(T.grid(spark, sf), folder, prefix, encode)
    register_all(spark)
    return folder


def _compact(rows: pd.DataFrame) -> bytes:
    return sample_files.compact_field_bytes(rows, np.linspace(0.0, 15.0, NX + 1), np.linspace(0.0, 6.0, NY + 1))


@query("src3_compact_field", "SELECT frame, ix, iy, (ix+ix+1)*25e-2 AS x, (iy+iy+1)*125e-3 AS y, bx, vz FROM grid", ("grid",))
def src3(spark, sf):
    folder = _field_files(spark, sf, "field", _compact)
    return spark.read.format("compact_field").option("targetBytes", 10_000).schema(
        "frame int, ix int, iy int, x double, y double, bx double, vz double").load(folder)


@query("src4_field_snapshot", "SELECT frame, ix, iy, ix*2e0 AS x, bx*5e-1 AS v1, bz*5e-1 AS v3, 'cm' AS coordinate_unit, 'cgs_value' AS value_unit FROM grid", ("grid",))
def src4(spark, sf):
    from fieldframe.functions.units import dimensionalize_field

    folder = _field_files(spark, sf, "snapshot_", lambda rows: sample_files.field_snapshot_bytes(rows, NX, NY))
    rows = spark.read.format("field_snapshot").option("targetBytes", 10_000).load(folder)
    out = dimensionalize_field(rows, ["x", "y", "z"], ["v1", "v2", "v3"])
    return out.select("frame", "ix", "iy", "x", "v1", "v3", "coordinate_unit", "value_unit")


@query("src5_mhd_raw", "SELECT frame, ix, iy, CAST(CAST(bx AS FLOAT) AS DOUBLE) AS bx, CAST(CAST(vy AS FLOAT) AS DOUBLE) AS vy FROM grid", ("grid",))
def src5(spark, sf):
    folder = _field_files(spark, sf, "mhd_data_", lambda rows: sample_files.mhd_raw_bytes(rows, NX, NY))
    reader = spark.read.format("mhd_raw").option("nx", NX).option("ny", NY).option("targetBytes", 20_000)
    return reader.schema("frame int, ix int, iy int, bx double, vy double").load(folder)


@query("src8_background", f"""
SELECT frame, iy, ix, {S('avg(bx)')} AS thermal_density, {S('avg(by)')} AS temperature FROM (SELECT frame, CAST(least(floor((iy+5e-1)/24e0*4e0),3e0) AS INTEGER) AS iy, CAST(least(floor((ix+5e-1)/30e0*6e0),5e0) AS INTEGER) AS ix, bx, by FROM grid) GROUP BY ALL""", ("grid",))
def src8(spark, sf):
    from fieldframe.operators import quality

    maps = T.grid(spark, sf).select("frame", "ix", "iy", F.col("bx").alias("thermal_density_cm3"), F.col("by").alias("temperature_mk"))
    path = scratch_dir(spark, "background")
    IO.write_table(maps, path, ["frame"])
    stored = spark.read.schema("ix int, iy int, thermal_density_cm3 double, temperature_mk double, frame int").parquet(path)
    quality.require_clean(quality.value_columns(stored, F.col("frame"), ["thermal_density_cm3", "temperature_mk"]))
    quality.require_clean(quality.cell_counts(stored, ["frame"], NX * NY))
    coarse = B.coarse_average(stored, Axis.uniform(0, 30, 30), Axis.uniform(0, 24, 24), 6, 4, ["thermal_density_cm3", "temperature_mk"])
    return coarse.select("frame", "iy", "ix", snap(F.col("thermal_density_cm3")).alias("thermal_density"), snap(F.col("temperature_mk")).alias("temperature"))


@query("snk2_histogram_files", HISTOGRAM_SQL, ("particles",))
def snk2(spark, sf):
    path = scratch_dir(spark, "histograms")
    IO.write_histograms(B.momentum_histogram(T.particles(spark, sf)), path)
    stored = spark.read.schema("bin int, p_left double, p_right double, weight double, frame int").option("header", True).csv(path)
    return histogram_rounded(stored.select("frame", "bin", "p_left", "p_right", "weight"))


@query("src9_histogram_scan", "SELECT frame, sum(weight) FILTER (status=0 AND p BETWEEN 1e-2 AND 1e1) AS weight, 128 AS bins FROM particles GROUP BY frame", ("particles",))
def src9(spark, sf):
    path = scratch_dir(spark, "histogram-files")
    hist = B.momentum_histogram(T.particles(spark, sf))

    def text(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name = f"{path}/momentum_histogram_{int(key[0]):05d}.csv"
        body = rows.sort_values("bin")[["bin", "p_left", "p_right", "weight"]].to_csv(index=False)
        return pd.DataFrame({"size": [sample_files.put(name, body.encode())]})

    hist.groupBy("frame").applyInPandas(text, "size long").count()
    stored = IO.read_histograms(spark, path)
    return stored.groupBy("frame").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).cast("int").alias("bins"))


@query("src10_run_summary", "SELECT frame, count(*) FILTER (status=0) AS active, CAST(frame AS DOUBLE)*25e-2 AS time, coalesce(sum(weight) FILTER (status=0),0e0) AS weight_sum FROM particles GROUP BY frame", ("particles",))
def src10(spark, sf):
    path = scratch_dir(spark, "summary")
    IO.write_run_summary(runs.run_summary(runs.frame_summary(T.particles(spark, sf)), 0.25), path)
    return IO.read_run_summary(spark, path).select("frame", "active", "time", "weight_sum")


@query("snk11_particle_table", f"""
SELECT frame, count(*) AS n, {S('max((sqrt(p*p+1e0)-1e0))', 7)} AS energy, count(*) FILTER (species=1) AS electrons, count(*) FILTER (status=1) AS escaped FROM particles GROUP BY frame""", ("particles",))
def snk11(spark, sf):
    one = F.lit(1.0)
    p = T.particles(spark, sf)
    ready = p.withColumns({"gamma": K.gamma(F.col("p"), one, one), "kinetic": K.kinetic_energy(F.col("p"), one, one),
                           "species_name": K.species_name(F.col("species"))} | K.status_flags(F.col("status")))
    path = scratch_dir(spark, "particle-table")
    IO.write_particles(ready, path)
    stored = spark.read.schema(ready.schema).parquet(path)
    return stored.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), snap(F.max("kinetic"), 7).alias("energy"),
        F.count(F.when(F.col("species_name") == "electron", 1)).alias("electrons"), F.sum("is_escaped").alias("escaped"))


_SPECTRA = ("case string, frame int, p_left double, p_right double, p_center double, energy_left_kev double, energy_right_kev double, "
            "energy_center_kev double, weight double, dndlog10p double, dndlog10e double")


@query("snk3_spectra_table", f"""
WITH base AS ({HISTOGRAM_SQL}) SELECT 'lineitem' AS "case", frame, count(*) AS rows, sum(weight) AS weight FROM base GROUP BY frame""", ("particles",))
def snk3(spark, sf):
    spectra = B.spectrum_columns(B.momentum_histogram(T.particles(spark, sf))).withColumn("case", F.lit("lineitem"))
    path = scratch_dir(spark, "spectra")
    IO.write_spectra(runs.union_cases(spectra, None), path)
    stored = spark.read.option("header", True).schema(_SPECTRA).csv(path)
    return stored.groupBy("case", "frame").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight"))


@query("rollup_spectra", f"""
WITH base AS ({HISTOGRAM_SQL}) SELECT CASE WHEN frame % 2 = 0 THEN 'even' ELSE 'odd' END AS "case", frame, count(*) AS rows, sum(weight) AS weight, NULL AS absent FROM base GROUP BY frame
UNION ALL SELECT 'lost', NULL, NULL, NULL, 'spectra'""", ("particles",))
def rollup_spectra(spark, sf):
    """Histogram files of two cases, and a third that has none."""
    root, out = scratch_dir(spark, "case-files"), scratch_dir(spark, "spectra")
    hist = B.momentum_histogram(T.particles(spark, sf)).withColumn("case", F.when(F.col("frame") % 2 == 0, "even").otherwise("odd"))
    IO.write_table(hist, f"{root}/spectra", ["case", "frame"], format="csv")
    absent = rollup.rollup_spectra(spark, root, ["even", "lost", "odd"], out)
    counted = spark.read.option("header", True).schema(_SPECTRA).csv(out).groupBy("case", "frame").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight"))
    return counted.unionByName(absent.withColumnRenamed("kind", "absent"), allowMissingColumns=True)


@query("snk12_field_table", "SELECT frame, ix, iy, bx FROM grid UNION ALL SELECT frame, ix+30, iy, bx FROM grid WHERE ix<1 UNION ALL SELECT frame, ix-30, iy, bx FROM grid WHERE ix>=29", ("grid",))
def snk12(spark, sf):
    from fieldframe.operators.grid import add_ghosts

    path = scratch_dir(spark, "field-table")
    table = add_ghosts(T.grid(spark, sf), {"ix": X, "iy": Y}, 1, "periodic_only").select("frame", "ix", "iy", "bx")
    IO.write_table(table, path, ["frame"])
    return spark.read.schema("ix int, iy int, bx double, frame int").parquet(path)


@query("set3_merge_results", 'SELECT l_returnflag AS "group", count(*) AS n, sum(weight) AS weight FROM (SELECT l_returnflag, floor(l_discount*1e2+5e-1) AS weight FROM lineitem) GROUP BY ALL')
def set3(spark, sf):
    path = scratch_dir(spark, "results")
    weights = T.table(spark, sf, "lineitem").select("l_returnflag", F.floor(F.col("l_discount") * 100.0 + 0.5).cast("double").alias("weight"))
    IO.write_table(weights.withColumn("case", F.concat("l_returnflag", F.lit(".res"))).select("case", "weight"), path, ["case"])
    merged = IO.merge_results(spark, path, "weight double")
    return merged.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


# -- streams -------------------------------------------------------------------------------------------------

def _frames_of(rows: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    return rows.select(
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("int").alias("frame"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("status"), (F.col("l_extendedprice") / 1.0e4).alias("p"),
        F.floor(F.col("l_discount") * 100.0 + 0.5).cast("double").alias("weight"))


def _stream(spark, sf, partial, merge, late: bool = False) -> DataFrame:
    """Three arrivals, one a micro-batch, each with rows of all frames; with ``late`` the last comes after the query has stopped.

    Every task that reads the table writes a file of an arrival, and a micro-batch takes as many files as the largest has.
    """
    rows = T.table(spark, sf, "lineitem")
    folder, checkpoint = scratch_dir(spark, "stream-input"), scratch_dir(spark, "stream-checkpoint")

    def arrive(part: int) -> int:
        path = f"{folder}/part={part}"
        rows.filter(F.col("l_orderkey") % 3 == part).write.parquet(path)
        return len(spark.read.schema(rows.schema).parquet(path).inputFiles())

    files = max(arrive(part) for part in ((0, 1) if late else (0, 1, 2)))
    store = FrameStore(spark, scratch_dir(spark, "stream"), merge)
    for last in (False, True) if late else (True,):
        if late and last:
            files = max(files, arrive(2))
        store.follow(_frames_of(ST.read_frames(spark, f"{folder}/*", rows.schema, files_per_batch=files)), partial, checkpoint).awaitTermination()
    return store.read()


@query("str1_stream_histogram", f"WITH base AS ({HISTOGRAM_SQL}) SELECT frame, bin, weight FROM base", ("particles",))
def str1(spark, sf):
    return ST.merged_histogram(_stream(spark, sf, ST.histogram_partial(), ST.merge_histogram))


@query("str1_stream_summary", f"""
SELECT frame, count(*)::BIGINT AS stored, count(*) FILTER (status=0) AS active, count(*) FILTER (status<>0) AS inactive, coalesce(sum(weight) FILTER (status=0),0e0) AS weight_sum,
 coalesce(min(p) FILTER (status=0),0e0) AS p_min, coalesce(max(p) FILTER (status=0),0e0) AS p_max, {S('coalesce(avg(p) FILTER (status=0),0e0)', 7)} AS p_avg FROM particles GROUP BY frame""", ("particles",))
def str2(spark, sf):
    out = ST.merged_summary(_stream(spark, sf, ST.summary_partial, ST.merge_summary))
    return out.withColumn("p_avg", snap(F.col("p_avg"), 7))


@query("str2_resume", f"""
SELECT frame, count(*)::BIGINT AS stored, count(*) FILTER (status=0) AS active, coalesce(sum(weight) FILTER (status=0),0e0) AS weight_sum FROM particles GROUP BY frame""", ("particles",))
def str2_resume(spark, sf):
    """The query stops, a late file comes for frames that are stored already, and the query goes on from its checkpoint."""
    out = ST.merged_summary(_stream(spark, sf, ST.summary_partial, ST.merge_summary, late=True))
    return out.select("frame", "stored", "active", "weight_sum")


_FIT_LIMIT = "6e0"

# -- whole pipelines -------------------------------------------------------------------------------------------

FREQUENCIES = (1.0, 2.0, 4.0, 8.0)


def power_law_source(representatives: DataFrame) -> DataFrame:
    """A simple vectorized stand-in for a radiation model: flux falls with frequency by the index."""
    ghz = np.asarray(FREQUENCIES)

    @F.pandas_udf(ArrayType(DoubleType()))
    def left(n: pd.Series, b: pd.Series, t: pd.Series, d: pd.Series) -> pd.Series:
        flux = (n * b + t * 0.01).to_numpy()[:, None] * ghz[None, :] ** (-d.to_numpy()[:, None] / 4.0)
        return pd.Series(list(flux))

    flux = left("nonthermal_density_1e7", "magnetic_field_100g", "thermal_density_1e9", "power_law_index")
    return representatives.withColumn("left", flux).withColumn("right", F.transform("left", lambda v: v * 1.25))


def emission_inputs(spark, sf):
    """Event particles and field on the day-hour grid, frames 0 to 3."""
    p = T.event_particles(spark, sf)
    particles = p.select((F.col("user_id") % 4).cast("int").alias("frame"), (F.col("frame") - 0.5).alias("x"), "y", "weight", "status",
                         (F.col("energy") * 1.0e3).alias("energy_ev"))
    return particles, T.grid(spark, sf)


def emission_config() -> emission.EmissionConfig:
    return emission.EmissionConfig(
        Axis.uniform(0.0, 30.0, 30), Axis.uniform(0.0, 24.0, 24), FREQUENCIES, nx=10, ny=8, energy_edges=tuple(1.0e3 * 2.0 ** k for k in range(10)),
        minimum_energy_ev=10.0, beam_fwhm_pixels=2.0)


_IN = "p AS (SELECT CAST(user_id % 4 AS INTEGER) AS frame, frame-5e-1 AS x, y, weight, status, energy*1e3 AS e FROM event_particles)"


@query("emission_cells", f"""WITH {_IN},
w AS (SELECT frame, CAST(least(floor((y-0e0)/24e0*8e0),7e0) AS INTEGER) AS iy, CAST(least(floor((x-0e0)/30e0*10e0),9e0) AS INTEGER) AS ix, sum(weight) AS w FROM p WHERE status=0 AND e>=1e1 AND x BETWEEN 0e0 AND 3e1 AND y BETWEEN 0e0 AND 24e0 GROUP BY ALL),
m AS (SELECT frame, max(w) AS top FROM w GROUP BY frame),
b AS (SELECT frame, CAST(least(floor((iy+5e-1)/24e0*8e0),7e0) AS INTEGER) AS iy, CAST(least(floor((ix+5e-1)/30e0*10e0),9e0) AS INTEGER) AS ix, avg(sqrt(bx*bx+by*by+bz*bz)) AS b FROM grid GROUP BY ALL),
r AS (SELECT frame, min(b) AS lo, max(b) AS hi FROM b GROUP BY frame)
SELECT b.frame, b.iy, b.ix, coalesce(w.w,0e0) AS weight, {S('coalesce(w.w,0e0)*3e7/top/1e7', 6)} AS density_1e7, {S('5e1+(b.b-lo)/greatest(hi-lo,1e-12)*35e1', 5)} AS gauss
FROM b JOIN r ON r.frame=b.frame JOIN m ON m.frame=b.frame LEFT JOIN w ON w.frame=b.frame AND w.iy=b.iy AND w.ix=b.ix""", ("event_particles", "grid"))
def emission_cells(spark, sf):
    cells = emission.cell_table(*emission_inputs(spark, sf), emission_config())
    return cells.select("frame", "iy", "ix", "weight", snap(F.col("nonthermal_density_cm3") / 1.0e7).alias("density_1e7"),
                        snap(F.col("magnetic_field_gauss"), 5).alias("gauss"))


# The emission chain in SQL: cells, keys, one representative per key, model, image sums.
_VOLUME = voxel_volume_cm3(2.0, 8.0)
_EDGES = [1.0e3 * 2.0 ** k for k in range(10)]
_EDGE_LIST = "[" + ",".join(D(v) for v in _EDGES) + "]"
_BIN = "(" + "+".join(f"CAST(e>={D(v)} AS INTEGER)" for v in _EDGES) + "-1)"
_ROUND = "CAST(round_even(greatest(least({v},1e0),0e0)*7e0,0) AS INTEGER)"
_EMISSION = f"""{_IN},
a AS (SELECT *, CAST(least(floor(y/24e0*8e0),7e0) AS INTEGER) AS iy, CAST(least(floor(x/30e0*10e0),9e0) AS INTEGER) AS ix FROM p WHERE status=0 AND e>=1e1 AND x BETWEEN 0e0 AND 3e1 AND y BETWEEN 0e0 AND 24e0),
w AS (SELECT frame, iy, ix, sum(weight) AS w FROM a GROUP BY ALL),
h AS (SELECT frame, iy, ix, {_BIN} AS ie, sum(weight) AS weight FROM a WHERE x<3e1 AND y<24e0 AND e>={D(_EDGES[0])} AND e<{D(_EDGES[-1])} GROUP BY ALL),
g AS (SELECT frame, CASE WHEN {_ACCEPT} THEN -slope ELSE 4e0 END AS gd FROM ({_quality(_fit_sql('frame,', 'h', _EDGE_LIST))})),
c AS ({_quality(_fit_sql('frame, iy, ix,', 'h', _EDGE_LIST))}),
b AS (SELECT frame, CAST(least(floor((iy+5e-1)/24e0*8e0),7e0) AS INTEGER) AS iy, CAST(least(floor((ix+5e-1)/30e0*10e0),9e0) AS INTEGER) AS ix, avg(sqrt(bx*bx+by*by+bz*bz)) AS b FROM grid GROUP BY ALL),
br AS (SELECT frame, min(b) AS lo, max(b) AS hi FROM b GROUP BY frame), wt AS (SELECT frame, max(w) AS top FROM w GROUP BY frame),
wd AS (SELECT w.frame, w.iy, w.ix, w.w*({D(3.0e7 * _VOLUME)}/top)/{D(_VOLUME)} AS dens FROM w JOIN wt ON wt.frame=w.frame), wr AS (SELECT frame, max(dens) AS top FROM wd GROUP BY frame),
cells AS (SELECT b.frame, b.iy, b.ix, w.dens/1e7 AS n, (5e1+(b.b-lo)/greatest(hi-lo,1e-12)*35e1)/1e2 AS field, (b.b-lo)/greatest(hi-lo,1e-12) AS bn, w.dens/top AS nn,
 CASE WHEN {_ACCEPT} THEN -slope ELSE least(greatest(gd,2e0),8e0) END AS d FROM b JOIN br ON br.frame=b.frame JOIN wr ON wr.frame=b.frame JOIN g ON g.frame=b.frame JOIN wd w ON w.frame=b.frame AND w.iy=b.iy AND w.ix=b.ix LEFT JOIN c ON c.frame=b.frame AND c.iy=b.iy AND c.ix=b.ix),
keyed AS (SELECT *, {_ROUND.format(v='nn')} AS k1, {_ROUND.format(v='bn')} AS k2, {_ROUND.format(v='(d-2e0)/6e0')} AS k3 FROM cells),
reps AS (SELECT frame, k1, k2, k3, arg_min(n, iy*10+ix) AS n, arg_min(field, iy*10+ix) AS field, arg_min(d, iy*10+ix) AS d FROM keyed GROUP BY ALL),
flux AS (SELECT k.frame, k.iy, k.ix, f.ghz*1e9 AS freq_hz, f.ghz, r.n, r.field, r.d, power(f.ghz,-r.d/4e0) AS fall FROM keyed k JOIN reps r ON r.frame=k.frame AND r.k1=k.k1 AND r.k2=k.k2 AND r.k3=k.k3
 CROSS JOIN (SELECT unnest([1e0,2e0,4e0,8e0]) AS ghz) f)"""


_BEAM = f"exp(((ix-45e-1)*(ix-45e-1)+(iy-35e-1)*(iy-35e-1))*-5e-1/({D(2.0 * SIGMA_PER_FWHM)}*{D(2.0 * SIGMA_PER_FWHM)}))"


@query("emission_product", f"""WITH {_EMISSION}, norm AS (SELECT sum({_BEAM}) AS total FROM (SELECT unnest(range(10)) AS ix) CROSS JOIN (SELECT unnest(range(8)) AS iy))
SELECT frame, freq_hz, {S('sum((n*field+1e-2)*fall*225e-2)', 4)} AS full_image_sfu, {S(f'sum((n*field+1e-2)*fall*225e-2*{_BEAM})/max(total)', 5)} AS beam_center_sfu FROM flux CROSS JOIN norm GROUP BY ALL""", ("event_particles", "grid"))
def emission_product(spark, sf):
    """Cells and region spectra through a written product (SNK9)."""
    tables = emission.run_emission(*emission_inputs(spark, sf), power_law_source, emission_config())
    path = scratch_dir(spark, "product")
    IO.write_product(tables, path)
    roi = IO.read_product(spark, path)["roi"]
    return roi.select("frame", "freq_hz", snap(F.col("full_image_sfu"), 4).alias("full_image_sfu"), snap(F.col("beam_center_sfu"), 5).alias("beam_center_sfu"))


_TB = f"*{D(C.SFU / (4.0 * C.ARCSEC * C.ARCSEC))}*{D(C.SPEED_OF_LIGHT ** 2 / (2.0 * C.BOLTZMANN))}/(freq_hz*freq_hz)"
_APERTURE = "((ix-45e-1)*(ix-45e-1)+(iy-35e-1)*(iy-35e-1)<=9e0)"
_REGIONS = {"full_image": ("sum({0})", "sum({0})/count(*)"), "aperture": (f"sum({{0}}) FILTER {_APERTURE}", f"sum({{0}}) FILTER {_APERTURE}/count(*) FILTER {_APERTURE}"),
            "beam_center": (f"sum({{0}}*{_BEAM})/sum({_BEAM})",) * 2}
_REGION_COLUMNS = [(name, f"{name}{sign}", factor) for name in _REGIONS for sign, factor in (("", "225e-2"), ("_v", "25e-2"))]


@query("emission_regions", f"""WITH {_EMISSION} SELECT frame, freq_hz, {', '.join(f"{S(_REGIONS[r][0].format(f'(n*field+1e-2)*fall*{k}'), 5)} AS {c}_sfu, {S('(' + _REGIONS[r][1].format(f'(n*field+1e-2)*fall*{k}') + ')' + _TB + '/1e9', 5)} AS {c}_tb_gk" for r, c, k in _REGION_COLUMNS)}
FROM flux GROUP BY frame, freq_hz""", ("event_particles", "grid"))
def emission_regions(spark, sf):
    """Flux and brightness temperature of I and V over the whole image, an aperture and the central beam."""
    particles, field = emission_inputs(spark, sf)
    config = replace(emission_config(), aperture_radius_pixels=3.0)
    roi = emission.run_emission(particles, field, power_law_source, config)["roi"]
    told = [part for _, c, _ in _REGION_COLUMNS for part in (snap(F.col(f"{c}_sfu"), 5).alias(f"{c}_sfu"), snap(F.col(f"{c}_tb") / 1.0e9, 5).alias(f"{c}_tb_gk"))]
    return roi.select("frame", "freq_hz", *told)


_SUM = "sum((n*field+1e-2)*fall{0})"


@query("emission_product_groups", f"""WITH {_EMISSION}, f AS (SELECT count(DISTINCT frame) AS n FROM b),
sums AS (SELECT {_SUM.format('*225e-2')} AS i, {_SUM.format('*25e-2')} AS v, sum((1e-9*field+1e-2)*fall*25e-2) AS cool FROM flux)
SELECT 'cells' AS "group", n*80 AS rows, {S('(SELECT sum(w) FROM w)', 3)} AS value FROM f UNION ALL SELECT 'cube', n*320, {S('i', 2)} FROM f, sums UNION ALL SELECT 'cube_v', n*320, {S('v', 2)} FROM f, sums
UNION ALL SELECT 'beam', n*320, NULL FROM f UNION ALL SELECT 'roi', n*4, {S('i', 2)} FROM f, sums UNION ALL SELECT 'roi_v', n*4, {S('v', 2)} FROM f, sums UNION ALL SELECT 'meta', n, NULL FROM f
UNION ALL SELECT 'grid', 80, {S('12e0*80+15e0*80', 6)} UNION ALL SELECT 'calibration', n, {S(f'(SELECT sum({D(3.0e7 * _VOLUME)}/top)/1e30 FROM wt)', 5)} FROM f UNION ALL SELECT 'diagnostics', n, CAST((SELECT count(*) FROM w) AS DOUBLE) FROM f
UNION ALL SELECT 'config', {len(fields(emission.EmissionConfig)) - 2}, NULL UNION ALL SELECT 'references', n*4, {S('cool', 3)} FROM f, sums""", ("event_particles", "grid"))
def emission_product_groups(spark, sf):
    """Every group of a product, written, published by its manifest and read back (SNK9)."""
    path = scratch_dir(spark, "product")
    IO.write_product(emission.run_emission(*emission_inputs(spark, sf), power_law_source, emission_config(), references=True), path)
    stored = IO.read_product(spark, path)

    def told(group: str, value=None, name: str | None = None, digits: int = 2) -> DataFrame:
        number = F.lit(None).cast("double") if value is None else snap(F.sum(value), digits)
        return stored[group].agg(F.lit(name or group).alias("group"), F.count(F.lit(1)).alias("rows"), number.alias("value"))

    parts = [told("cells", F.col("weight"), digits=3), told("cube", F.col("i_flux")), told("cube", F.col("v_flux"), "cube_v"), told("beam"),
             told("roi", F.col("full_image_sfu")), told("roi", F.col("full_image_v_sfu"), "roi_v"), told("meta"), told("grid", F.col("x") + F.col("y"), digits=6),
             told("calibration", F.col("per_weight") / 1.0e30, digits=5), told("config"), told("references", F.col("thermal_only_circular"), digits=3)]
    occupied = stored["diagnostics"].agg(F.lit("diagnostics").alias("group"), F.count(F.lit(1)).alias("rows"), F.sum("occupied_cells").cast("double").alias("value"))
    out = occupied
    for part in parts:
        out = out.unionByName(part)
    return out


@query("emission_references", f"""WITH {_EMISSION}
SELECT frame, freq_hz, {S('sum((n*field+1e-2)*fall*225e-2)', 3)} AS i_flux, {S('sum((1e-9*field+1e-2)*fall*225e-2)', 3)} AS thermal_only, {S('sum((1e-9*field+1e-2)*fall*25e-2)', 3)} AS thermal_only_circular, {S('sum((n*field+1e-2)*fall*225e-2*(8e0/8e-5))/1e5', 3)} AS optically_thin_e5,
 0e0 AS background_only, {S('sum(((n*field+1e-6*1e-2)-(n*field+1e-2))*fall*225e-2)', 6)} AS razin_impact FROM flux GROUP BY ALL""", ("event_particles", "grid"))
def emission_references(spark, sf):
    """Reference variants and their differences summed over the image (UDF3)."""
    particles, field = emission_inputs(spark, sf)
    config = emission_config()
    extra = ("thermal_only", "thermal_only_circular", "optically_thin_proxy", "background_only", "razin_impact")
    cells = materialize(emission.cell_table(particles, field, config), "cells")
    cube = emission.image_cube(cells, emission.reference_spectra(power_law_source), config, extra)
    sums = cube.groupBy("frame", "freq_hz").agg(*[F.sum(c).alias(c) for c in ("i_flux", *extra)])
    return sums.select("frame", "freq_hz", snap(F.col("i_flux"), 3).alias("i_flux"), snap(F.col("thermal_only"), 3).alias("thermal_only"), snap(F.col("thermal_only_circular"), 3).alias("thermal_only_circular"),
                       snap(F.col("optically_thin_proxy") / 1.0e5, 3).alias("optically_thin_e5"), "background_only",
                       snap(F.col("razin_impact"), 6).alias("razin_impact"))


@query("snk5_movie_frames", f"""WITH {_EMISSION}, s AS (SELECT frame, freq_hz, {_SUM.format('*225e-2')} AS v FROM flux GROUP BY ALL), peak AS (SELECT frame, max(v) AS high FROM s GROUP BY frame)
SELECT p.frame, row_number() OVER (ORDER BY p.frame) - 1 AS sequence_index, count(*) AS particle_count, sum(weight) AS active_weight, sum(CASE WHEN e<2e4 THEN weight ELSE 0e0 END) AS below_threshold_weight, sum(CASE WHEN e<2e4 THEN 0e0 ELSE weight END) AS above_threshold_weight,
 {S('max(high)', 4)} AS spectrum_peak_sfu, 'table' AS energy_source, {S(f'max({D(3.0e7 * _VOLUME)}/top)/1e30', 5)} AS suggested_per_weight_e30
FROM p JOIN peak ON peak.frame=p.frame JOIN wt ON wt.frame=p.frame WHERE status=0 AND x BETWEEN 0e0 AND 3e1 AND y BETWEEN 0e0 AND 24e0 GROUP BY p.frame""", ("event_particles", "grid"))
def snk5(spark, sf):
    """The movie index of a product, its peaks from the region spectra, written as CSV and read back."""
    particles, field_table = emission_inputs(spark, sf)
    config = emission_config()
    tables = emission.run_emission(particles, field_table, power_law_source, config)
    index = emission.movie_frames(particles, tables["roi"], config, 2.0e4, tables["calibration"], "table")
    path = scratch_dir(spark, "movie")
    IO.write_movie_frames(index, path)
    stored = spark.read.option("header", True).schema(index.schema).csv(path)
    return stored.withColumns({"spectrum_peak_sfu": snap(F.col("spectrum_peak_sfu"), 4), "suggested_per_weight_e30": snap(F.col("suggested_per_weight") / 1.0e30, 5)}).drop("suggested_per_weight")


@query("spectral_fit_maps", f"""
WITH a AS (SELECT frame, freq_idx, freq_hz, iy, ix, abs(value) AS v FROM cube),
r AS (SELECT frame, freq_idx, stddev_pop(v)*1e-1 AS rms FROM a WHERE iy>=2 AND iy<11 AND ix>=2 AND ix<12 GROUP BY ALL),
e AS (SELECT a.frame, iy, ix, sum(v-rms) AS excess FROM a JOIN r ON r.frame=a.frame AND r.freq_idx=a.freq_idx GROUP BY ALL),
f AS (SELECT a.frame, a.iy, a.ix, regr_slope(log10(v), log10(freq_hz/1e9)) AS slope, regr_intercept(log10(v), log10(freq_hz/1e9)) AS level FROM a JOIN e ON e.frame=a.frame AND e.iy=a.iy AND e.ix=a.ix
 WHERE excess>{_FIT_LIMIT} AND v>0 AND freq_idx<40 GROUP BY ALL)
SELECT p.frame, p.iy, p.ix, {S('coalesce(slope,0e0)')} AS slope, {S('coalesce(level,0e0)')} AS level FROM (SELECT DISTINCT frame, iy, ix FROM a) p LEFT JOIN f ON f.frame=p.frame AND f.iy=p.iy AND f.ix=p.ix""", ("cube",))
def spectral_fit_maps(spark, sf):
    """Batch fit of the cube: background, mask, fits and maps."""
    config = spectral_fit.FitConfig(20, 20, 1.0e9, 4.0e10, (0, 20), (0, 20), ((0.1, 0.1), (0.6, 0.55)), 0.1, float(_FIT_LIMIT))
    cube = T.cube(spark, sf).withColumn("value", F.abs("value"))
    maps = spectral_fit.fit_maps(cube, config, ["slope", "level"])
    return maps.select("frame", "iy", "ix", snap(F.col("slope")).alias("slope"), snap(F.col("level")).alias("level"))


@query("agg29_case_speedup", f"""WITH l AS (SELECT "case", max(frame) AS frame, sum(frame_seconds) AS s FROM timing GROUP BY 1)
SELECT "case", frame, {S("(SELECT s FROM l WHERE \"case\"='5-LOW')/s", 7)} AS speedup FROM l""", ("timing",))
def case_speedup(spark, sf):
    elapsed = runs.running_elapsed(T.timing(spark, sf), ["case"])
    latest = compare.latest_per_case(elapsed, ["case"], ["elapsed_seconds"])
    return compare.speed_up(latest, "5-LOW").select("case", "frame", snap(F.col("speedup"), 7).alias("speedup"))
