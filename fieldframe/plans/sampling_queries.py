"""Queries on ordered rows, random points, weighted picks and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldframe.functions.axes import Axis
from fieldframe.operators import blocks, layout, lookup, runs
from fieldframe.operators import sampling as P
from fieldframe.plans import tables as T
from fieldframe.plans.grid_queries import AXES, X, Y
from fieldframe.plans.registry import number as D
from fieldframe.plans.registry import query, snap
from fieldframe.plans.registry import sql_snap as S
from fieldframe.session import scratch_dir


def digest_uniform(row_id, attempt, dim):
    """Uniform numbers from a digest that the SQL side can compute as well."""
    text = F.concat_ws("-", row_id.cast("string"), attempt.cast("string"), F.lit(str(dim)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _draw(row_id: str, attempt: str, dim: int) -> str:
    return f"(CAST(CAST('0x' || substr(md5(CAST({row_id} AS VARCHAR) || '-' || CAST({attempt} AS VARCHAR) || '-{dim}'),1,12) AS BIGINT) AS DOUBLE)/{D(1 << 48)})"


@query("smp1_uniform_points", f"""
WITH d AS (SELECT c_custkey, c_nationkey, k, 1e1+{_draw('c_custkey', 'k', 0)}*3e1 AS x, -2e0+{_draw('c_custkey', 'k', 1)}*4e0 AS y FROM customer CROSS JOIN (SELECT unnest(range(64)) AS k)),
a AS (SELECT *, x*y>25e0 AND x<36e0 AS ok FROM d), p AS (SELECT c_custkey, coalesce(min(k) FILTER (ok),63) AS k, bool_or(ok) AS hit FROM a GROUP BY c_custkey)
SELECT a.c_custkey, {S('x', 8)} AS x, {S('y', 8)} AS y, CASE WHEN hit THEN 0 ELSE 2 END AS status FROM p JOIN a ON a.c_custkey=p.c_custkey AND a.k=p.k""")
def smp1(spark, sf):
    ids = T.table(spark, sf, "customer").select("c_custkey")
    out = P.uniform_points(ids, "c_custkey", {"x": (10.0, 40.0), "y": (-2.0, 2.0)},
                           lambda q: (q["x"] * q["y"] > 25.0) & (q["x"] < 36.0), max_attempts=64, uniform=digest_uniform)
    return out.select("c_custkey", snap(F.col("x"), 8).alias("x"), snap(F.col("y"), 8).alias("y"), "status")


_VOLUME_SQL = f"(({D(X.start)}+ix*{D(X.step)})+({D(X.start)}+(ix+1)*{D(X.step)}))*5e-1"


@query("smp2_candidate_cells", f"""
WITH g AS (SELECT *, (frame*30+ix)*24+iy AS cell, {_VOLUME_SQL}*{D(X.step)}*{D(Y.step)} AS w FROM grid WHERE ix BETWEEN 3 AND 20 AND iy BETWEEN 2 AND 19 AND abs(bx)>3e1)
SELECT frame, ix, iy, {S('w', 9)} AS cell_weight, {S('sum(w) OVER (ORDER BY cell)', 7)} AS cum_hi FROM g""", ("grid",))
def smp2(spark, sf):
    g = T.grid(spark, sf).withColumn("cell", (F.col("frame") * 30 + F.col("ix")) * 24 + F.col("iy"))
    from fieldframe.functions.geometry import cell_volume

    i, j = F.col("ix"), F.col("iy")
    volume = cell_volume("polar", [X.center(i), Y.center(j)], [X.cell_width(i), Y.cell_width(j)])
    out = P.candidate_cells(g, {"ix": (3, 20), "iy": (2, 19)}, F.col("bx"), 30.0, "abs_greater", volume, ["cell"])
    return out.select("frame", "ix", "iy", snap(F.col("cell_weight"), 9).alias("cell_weight"), snap(F.col("cum_hi"), 7).alias("cum_hi"))


_WEIGHTED_SQL = """w AS (SELECT c_custkey, CAST(greatest(floor(c_acctbal*1e2+5e-1),0e0) AS DOUBLE) AS w FROM customer),
c AS (SELECT c_custkey, w, sum(w) OVER (ORDER BY c_custkey) AS hi FROM w)"""


def _weighted(spark, sf):
    return T.table(spark, sf, "customer").select("c_custkey", F.greatest(F.floor(F.col("c_acctbal") * 100.0 + 0.5), F.lit(0)).cast("double").alias("w"))


@query("win3_cumulative_weight", f"WITH {_WEIGHTED_SQL} SELECT c_custkey, w, hi-w AS cum_lo, hi AS cum_hi FROM c")
def win3(spark, sf):
    return P.cumulative_weight(_weighted(spark, sf), "w", ["c_custkey"])


@query("smp3_weighted_pick", f"""WITH {_WEIGHTED_SQL}, t AS (SELECT o_orderkey, (CAST((o_orderkey*7919) % 100003 AS DOUBLE)/100003e0)*(SELECT sum(w) FROM w) AS target FROM orders)
SELECT o_orderkey, c_custkey FROM t JOIN c ON target>=hi-w AND target<hi AND w>0""")
def smp3(spark, sf):
    draws = T.table(spark, sf, "orders").select("o_orderkey", (((F.col("o_orderkey") * 7919) % 100003).cast("double") / 100003.0).alias("u"))
    return P.weighted_pick(draws, _weighted(spark, sf), "u", "w", ["c_custkey"]).select("o_orderkey", "c_custkey")


@query("smp3_point_in_cell", f"""
WITH g AS (SELECT frame, ix, iy, (frame*30+ix)*24+iy AS cell FROM grid)
SELECT frame, ix, iy, {S(f"{D(X.start)}+ix*{D(X.step)}+{_draw('cell', '0', 0)}*(({D(X.start)}+(ix+1)*{D(X.step)})-({D(X.start)}+ix*{D(X.step)}))", 8)} AS u_ix,
 {S(f"{D(Y.start)}+iy*{D(Y.step)}+{_draw('cell', '0', 1)}*(({D(Y.start)}+(iy+1)*{D(Y.step)})-({D(Y.start)}+iy*{D(Y.step)}))", 8)} AS u_iy FROM g""", ("grid",))
def smp3_points(spark, sf):
    g = T.grid(spark, sf).select("frame", "ix", "iy", ((F.col("frame") * 30 + F.col("ix")) * 24 + F.col("iy")).alias("cell"))
    out = P.point_in_cell(g, AXES, "cell", digest_uniform)
    return out.select("frame", "ix", "iy", snap(F.col("u_ix"), 8).alias("u_ix"), snap(F.col("u_iy"), 8).alias("u_iy"))


_SPLIT_SQL = """m AS (SELECT *, CASE WHEN status<>0 THEN 'inactive' WHEN initial_kinetic_energy<=0 THEN 'skipped_baseline' WHEN energy/nullif(initial_kinetic_energy,0)<2e0 THEN 'kept'
 WHEN floor(ln(energy/nullif(initial_kinetic_energy,0))/ln(2e0))<=split_level THEN 'kept' WHEN weight*5e-1<1e0 THEN 'skipped_minimum_weight' ELSE 'split' END AS o0 FROM event_particles),
r AS (SELECT *, count(*) OVER (PARTITION BY frame)+sum(CASE WHEN o0='split' THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY particle_id)-1 AS child FROM m),
k AS (SELECT *, CASE WHEN o0='split' AND child>=400 THEN 'skipped_capacity' ELSE o0 END AS outcome FROM r)"""


def _split(spark, sf):
    return P.split_on_energy_growth(T.event_particles(spark, sf), "energy", ["frame"], ratio=2.0, minimum_child_weight=1.0, capacity=400)


@query("smp4_split", f"""WITH {_SPLIT_SQL}
SELECT frame, CAST(CASE WHEN is_child THEN child ELSE particle_id END AS BIGINT) AS particle_id, CASE WHEN outcome='split' THEN weight*5e-1 ELSE weight END AS weight, CAST(CASE WHEN outcome='split' THEN split_level+1 ELSE split_level END AS INTEGER) AS split_level,
 CASE WHEN outcome='skipped_baseline' AND energy>0 THEN energy ELSE initial_kinetic_energy END AS initial_kinetic_energy, outcome, is_child
FROM k JOIN (SELECT false AS is_child UNION ALL SELECT true) c ON NOT is_child OR outcome='split'""", ("event_particles",))
def smp4(spark, sf):
    return _split(spark, sf).select("frame", F.col("particle_id").cast("long"), "weight", "split_level", "initial_kinetic_energy", "outcome", "is_child")


@query("agg26_split_counters", f"""WITH {_SPLIT_SQL}
SELECT frame, count(*) FILTER (outcome<>'inactive') AS active, count(*) FILTER (outcome='split') AS split, count(*) FILTER (outcome='skipped_capacity') AS skipped_capacity,
 count(*) FILTER (outcome='skipped_baseline') AS skipped_baseline, count(*) FILTER (outcome='skipped_minimum_weight') AS skipped_minimum_weight FROM k GROUP BY frame""", ("event_particles",))
def agg26(spark, sf):
    return P.split_counters(_split(spark, sf), ["frame"])


@query("smp5_split_momentum", """
WITH m AS (SELECT *, status=0 AND p>15e-1*power(2e0,split_level) AND p<=2e1 AS w FROM event_particles)
SELECT frame, count(*) AS rows, count(*) FILTER (is_child) AS children, sum(CASE WHEN w THEN power(5e-1, split_level+1) ELSE weight END) AS weight, CAST(max(CASE WHEN w THEN split_level+1 ELSE split_level END) AS INTEGER) AS top
FROM m JOIN (SELECT false AS is_child UNION ALL SELECT true) c ON NOT is_child OR w GROUP BY frame""", ("event_particles",))
def smp5(spark, sf):
    out = P.split_on_momentum(T.event_particles(spark, sf), ["frame"], 1.5, 2.0, 20.0)
    return out.groupBy("frame").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("is_child"), 1)).alias("children"),
                                    F.sum("weight").alias("weight"), F.max("split_level").alias("top"))


@query("smp7_boundaries", f"""
WITH q AS (SELECT *, x-1e0 AS prev_x, (x-5e0)-floor((x-5e0)/4e1)*4e1 AS o FROM event_particles), w AS (SELECT *, CASE WHEN o>=4e1 THEN o-4e1 ELSE o END+0e0 AS wrapped FROM q)
SELECT particle_id, {S('CASE WHEN status=0 THEN wrapped+5e0 ELSE x END', 7)} AS x, {S('CASE WHEN status=0 THEN prev_x+(wrapped+5e0-x) ELSE prev_x END', 7)} AS prev_x, CASE WHEN status=0 AND NOT (y BETWEEN 2e0 AND 2e1) THEN 1 ELSE status END AS status FROM w""", ("event_particles",))
def smp7(spark, sf):
    p = T.event_particles(spark, sf).withColumn("prev_x", F.col("x") - 1.0)
    out = P.apply_boundaries(p, {"x": Axis.uniform(5.0, 45.0, 8, periodic=True), "y": Axis.uniform(2.0, 20.0, 4)})
    return out.select("particle_id", snap(F.col("x"), 7).alias("x"), snap(F.col("prev_x"), 7).alias("prev_x"), "status")


@query("srt1_bucket_order", "SELECT CAST(user_id % 10 AS INTEGER) AS sort_key, event_id, value FROM events")
def srt1(spark, sf):
    e = T.table(spark, sf, "events")
    return P.bucket_order(e, (F.col("user_id") % 10).cast("int"), ["event_id"]).select("sort_key", "event_id", "value")


@query("srt1_box_layout", """
WITH c AS (SELECT frame, CAST(floor(x/1e1) AS INTEGER) AS ix, CAST(floor(y) AS INTEGER) AS iy, weight FROM event_particles)
SELECT frame, ix, iy, count(*) AS n, sum(weight) AS weight, true AS skips_files FROM c WHERE frame BETWEEN 5 AND 9 AND ix BETWEEN 0 AND 3 AND iy BETWEEN 6 AND 11 GROUP BY ALL""", ("event_particles",))
def srt1_box(spark, sf):
    """A box of cells from a layout by cell, and whether files were left unopened."""
    path = scratch_dir(spark, "cell-layout")
    cells = T.event_particles(spark, sf).select("frame", F.floor(F.col("x") / 10.0).cast("int").alias("ix"), F.floor("y").cast("int").alias("iy"), "weight")
    layout.write_cells(cells, path, files=16)
    box = {"frame": (5, 9), "ix": (0, 3), "iy": (6, 11)}
    skips = layout.files_of_box(spark, path, box).count() < spark.read.parquet(f"{path}/files").count()
    return layout.read_box(spark, path, box).groupBy("frame", "ix", "iy").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.lit(skips).alias("skips_files"))


@query("win7_row_numbers", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events")
def win7(spark, sf):
    return blocks.row_numbers(T.table(spark, sf, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], "rn")


@query("win2_previous_value", """
SELECT user_id, event_id, value, lag(value,1) OVER w AS prev_value, lag(value,2) OVER w AS step_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def win2(spark, sf):
    e = T.table(spark, sf, "events").select("user_id", "event_id", "value")
    return runs.previous_positions(e, ["user_id"], ["event_id"], ["value"])


@query("win1_running_elapsed", f"""
SELECT "case", frame, {S('sum(frame_seconds) OVER (PARTITION BY "case" ORDER BY frame)', 5)} AS elapsed_seconds FROM timing""", ("timing",))
def win1(spark, sf):
    out = runs.running_elapsed(T.timing(spark, sf), ["case"])
    return out.select("case", "frame", snap(F.col("elapsed_seconds"), 5).alias("elapsed_seconds"))


@query("jon2_asof_prev", """
WITH a AS (SELECT DISTINCT frame FROM event_particles WHERE p>22e0)
SELECT p.frame, count(*) AS n, max(coalesce(s.frame, b.frame)) AS field_frame FROM event_particles p LEFT JOIN a s ON s.frame=p.frame LEFT JOIN a b ON b.frame=p.frame-1 GROUP BY p.frame""", ("event_particles",))
def jon2(spark, sf):
    p = T.event_particles(spark, sf)
    available = p.filter(F.col("p") > 22.0)
    return lookup.asof_frame(p, available).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.max("field_frame").alias("field_frame"))
