"""Queries on particles: histograms, deposits, fits, summaries, filters, kinematics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions import kinematics as K
from fieldframe.functions import predicates as P
from fieldframe.functions.axes import Axis
from fieldframe.operators import binning as B
from fieldframe.operators import compare, fit, lookup, runs
from fieldframe.plans import tables as T
from fieldframe.plans.registry import number as D
from fieldframe.plans.registry import query, snap
from fieldframe.plans.registry import sql_snap as S

X_AXIS = Axis.uniform(1000.0, 100000.0, 16)
Y_AXIS = Axis.uniform(1.0, 50.0, 12)
EDGES = [2.0e4 * 2.0 ** (k / 2.0) for k in range(12)]

# SQL fragments of the image bins: closed and open upper edge.
IX = "CASE WHEN x BETWEEN 1e3 AND 1e5 THEN CAST(least(floor((x-1e3)/9.9e4*16e0),15e0) AS INTEGER) END"
IY = "CASE WHEN y BETWEEN 1e0 AND 5e1 THEN CAST(least(floor((y-1e0)/4.9e1*12e0),11e0) AS INTEGER) END"
IX_OPEN = "CAST(floor((x-1e3)/9.9e4*16e0) AS INTEGER)"
IY_OPEN = "CAST(floor((y-1e0)/4.9e1*12e0) AS INTEGER)"
IE = "(" + "+".join(f"CAST(energy_ev>={D(e)} AS INTEGER)" for e in EDGES) + "-1)"
EDGE_LIST = "[" + ",".join(D(e) for e in EDGES) + "]"

_PMIN, _PMAX, _BINS = 0.01, 10.0, 128
_SCALE = _BINS / (math.log(_PMAX) - math.log(_PMIN))
_STEP = (math.log(_PMAX) - math.log(_PMIN)) / _BINS
_LOG = D(math.log(_PMIN))


def _histogram_sql(bins: str = "128") -> str:
    return f"""
WITH hist AS (SELECT frame, least(greatest(CAST(trunc((ln(p)-({_LOG}))*{D(_SCALE)}) AS INTEGER),0),127) AS bin, sum(weight) AS weight
 FROM particles WHERE status=0 AND p BETWEEN 1e-2 AND 1e1 GROUP BY ALL),
dense AS (SELECT f.frame, CAST(b.bin AS INTEGER) AS bin FROM (SELECT DISTINCT frame FROM particles) f CROSS JOIN (SELECT unnest(range({bins})) AS bin) b)
SELECT d.frame, d.bin, {S(f'exp({_LOG}+d.bin*{D(_STEP)})', 9)} AS p_left, {S(f'exp({_LOG}+(d.bin+1)*{D(_STEP)})', 9)} AS p_right,
 coalesce(h.weight,0e0) AS weight FROM dense d LEFT JOIN hist h ON h.frame=d.frame AND h.bin=d.bin"""


HISTOGRAM_SQL = _histogram_sql()


def histogram_rounded(df):
    return df.withColumns({c: snap(F.col(c), 9) for c in ("p_left", "p_right")})


@query("agg3_momentum_histogram", HISTOGRAM_SQL, ("particles",))
def agg3(spark, sf):
    return histogram_rounded(B.momentum_histogram(T.particles(spark, sf)))


@query("agg1_frame_summary", f"""
SELECT frame, count(*) AS stored, count(*) FILTER (status=0) AS active, count(*) FILTER (status<>0) AS inactive,
 coalesce(sum(weight) FILTER (status=0),0e0) AS weight_sum, coalesce(min(p) FILTER (status=0),0e0) AS p_min,
 coalesce(max(p) FILTER (status=0),0e0) AS p_max, {S('coalesce(avg(p) FILTER (status=0),0e0)', 7)} AS p_avg,
 coalesce(min(dt) FILTER (status=0),0e0) AS dt_min, coalesce(max(dt) FILTER (status=0),0e0) AS dt_max,
 {S('coalesce(avg(dt) FILTER (status=0),0e0)', 7)} AS dt_avg, coalesce(max(split_level) FILTER (status=0),0) AS max_split_level
FROM particles GROUP BY frame""", ("particles",))
def agg1(spark, sf):
    out = runs.frame_summary(T.particles(spark, sf))
    return out.withColumns({c: snap(F.col(c), 7) for c in ("p_avg", "dt_avg")})


_MASS, _LIGHT, _SCALE_ERG = 1.0, 2.0, 3.0e-9
_CONSTANTS = {"rest_mass": _MASS, "speed_of_light": _LIGHT, "energy_scale_erg": _SCALE_ERG}
_GAMMA = "sqrt((p/2e0)*(p/2e0)+1e0)"
_ENERGY = f"(({_GAMMA}-1e0)*1e0*2e0*2e0*3e-9/{D(C.ELECTRON_VOLT)})"


def _with_constants(df):
    return df.withColumns({k: F.lit(v) for k, v in _CONSTANTS.items()})


@query("agg2_weighted_stats", f"""
SELECT frame, count(*) AS total, count(*) FILTER (status=0) AS active, count(*) FILTER (status=1) AS escaped,
 count(*) FILTER (status=2) AS inactive, coalesce(sum(weight) FILTER (status=0 AND weight>0),0e0) AS weight_sum,
 {S(f'coalesce(avg({_GAMMA}) FILTER (status=0),0e0)', 7)} AS mean_gamma, {S(f'coalesce(max({_GAMMA}) FILTER (status=0),0e0)', 7)} AS max_gamma,
 {S(f'coalesce(avg(p/{_GAMMA}) FILTER (status=0),0e0)', 7)} AS mean_speed, {S(f'coalesce(max(p/{_GAMMA}) FILTER (status=0),0e0)', 7)} AS max_speed,
 {S(f'coalesce(min({_ENERGY}) FILTER (status=0),0e0)', 3)} AS min_energy_ev, {S(f'coalesce(max({_ENERGY}) FILTER (status=0),0e0)', 3)} AS max_energy_ev,
 {S(f'coalesce(sum(weight*{_ENERGY}) FILTER (status=0 AND weight>0)/nullif(sum(weight) FILTER (status=0 AND weight>0),0),0e0)', 3)} AS mean_energy_ev
FROM particles GROUP BY frame""", ("particles",))
def agg2(spark, sf):
    out = runs.particle_statistics(_with_constants(T.particles(spark, sf)))
    seven, three = ("mean_gamma", "max_gamma", "mean_speed", "max_speed"), ("min_energy_ev", "max_energy_ev", "mean_energy_ev")
    return out.withColumns({c: snap(F.col(c), 7) for c in seven} | {c: snap(F.col(c), 3) for c in three})


@query("agg5_deposit", f"""
WITH b AS (SELECT frame, {IY} AS iy, {IX} AS ix, weight FROM particles WHERE status=0 AND energy_ev>=1e4)
SELECT frame, iy, ix, sum(weight) AS weight FROM b WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY ALL""", ("particles",))
def agg5(spark, sf):
    p = T.particles(spark, sf)
    return B.deposit(p.filter(P.active_above(F.col("status"), F.col("energy_ev"), 1.0e4)), X_AXIS, Y_AXIS)


@query("agg4_dense_deposit", f"""
WITH b AS (SELECT frame, {IY} AS iy, {IX} AS ix, weight FROM particles WHERE status=0),
d AS (SELECT frame, iy, ix, sum(weight) AS weight FROM b WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY ALL)
SELECT f.frame, CAST(y.iy AS INTEGER) AS iy, CAST(x.ix AS INTEGER) AS ix, coalesce(d.weight,0e0) AS weight
FROM (SELECT DISTINCT frame FROM b) f CROSS JOIN (SELECT unnest(range(12)) AS iy) y CROSS JOIN (SELECT unnest(range(16)) AS ix) x
LEFT JOIN d ON d.frame=f.frame AND d.iy=y.iy AND d.ix=x.ix""", ("particles",))
def agg4(spark, sf):
    p = T.particles(spark, sf).filter(F.col("status") == C.STATUS_ACTIVE)
    return B.deposit(p, X_AXIS, Y_AXIS, dense=True)


_HIST_SQL = f"""b AS (SELECT frame, {IY_OPEN} AS iy, {IX_OPEN} AS ix, {IE} AS ie, weight FROM particles WHERE status=0),
h AS (SELECT frame, iy, ix, ie, sum(weight) AS weight FROM b WHERE ix BETWEEN 0 AND 15 AND iy BETWEEN 0 AND 11 AND ie BETWEEN 0 AND {len(EDGES) - 2} GROUP BY ALL)"""


def _cell_hist(spark, sf):
    p = T.particles(spark, sf).filter(F.col("status") == C.STATUS_ACTIVE)
    return B.cell_energy_histogram(p, X_AXIS, Y_AXIS, EDGES)


def _edged(hist):
    edges = F.array(*[F.lit(e) for e in EDGES])
    return hist.withColumns({"lo": F.get(edges, F.col("ie")), "hi": F.get(edges, F.col("ie") + 1)})


@query("agg6_cell_energy_hist", f"WITH {_HIST_SQL} SELECT * FROM h", ("particles",))
def agg6(spark, sf):
    return _cell_hist(spark, sf)


@query("agg7_energy_edges", f"""
WITH e AS (SELECT frame, min(energy_ev) AS lo, max(energy_ev) AS hi FROM particles WHERE status=0 AND energy_ev>0 GROUP BY frame)
SELECT frame, CAST(k AS INTEGER) AS k, {S('power(10e0, log10(lo)+k*((log10(CASE WHEN hi>lo THEN hi ELSE lo*1.001e0 END)-log10(lo))/8e0))', 3)} AS edge
FROM e CROSS JOIN (SELECT unnest(range(9)) AS k)""", ("particles",))
def agg7(spark, sf):
    edges = B.energy_edges(T.particles(spark, sf), 8)
    return edges.select("frame", F.posexplode("edges").alias("k", "e")).select("frame", "k", snap(F.col("e"), 3).alias("edge"))


def _fit_sql(keys: str, source: str, edges: str = EDGE_LIST) -> str:
    return f"""SELECT {keys} count(y) AS bins, regr_slope(y,x) AS slope, regr_r2(y,x) AS r2, var_pop(y) AS spread FROM
 (SELECT {keys} CASE WHEN w>0 THEN log10(sqrt(lo*hi)) END AS x, CASE WHEN w>0 THEN log10(w/(hi-lo)) END AS y FROM
  (SELECT {keys} ie, sum(weight) AS w, {edges}[ie+1] AS lo, {edges}[ie+2] AS hi FROM {source} GROUP BY ALL)) GROUP BY ALL"""


_ACCEPT = "coalesce(bins>=4 AND abs(slope)<1e300 AND q>=5e-1 AND -slope BETWEEN 2e0 AND 8e0, false)"


def _quality(source: str) -> str:
    return f"SELECT *, CASE WHEN bins>=4 AND spread>0 THEN coalesce(r2,0e0) ELSE 0e0 END AS q FROM ({source})"


@query("agg10_power_law_global", f"""
WITH {_HIST_SQL}
SELECT frame, {S(f'CASE WHEN {_ACCEPT} THEN -slope ELSE 4e0 END')} AS delta, {S('q')} AS r2, {_ACCEPT} AS accepted, bins
FROM ({_quality(_fit_sql('frame,', 'h'))})""", ("particles",))
def agg10(spark, sf):
    hist = _edged(_cell_hist(spark, sf)).groupBy("frame", "ie", "lo", "hi").agg(F.sum("weight").alias("weight"))
    out = fit.power_law_fit(hist, ["frame"])
    return out.withColumns({c: snap(F.col(c)) for c in ("delta", "r2")})


@query("agg11_power_law_map", f"""
WITH {_HIST_SQL}, g AS (SELECT frame, CASE WHEN {_ACCEPT} THEN -slope ELSE 4e0 END AS gdelta, q AS gr2, {_ACCEPT} AS gacc FROM ({_quality(_fit_sql('frame,', 'h'))})),
c AS ({_quality(_fit_sql('frame, iy, ix,', 'h'))})
SELECT g.frame, CAST(yy.iy AS INTEGER) AS iy, CAST(xx.ix AS INTEGER) AS ix, {S(f'CASE WHEN {_ACCEPT} THEN -slope ELSE least(greatest(gdelta,2e0),8e0) END')} AS delta,
 {S('coalesce(q,0e0)')} AS r2, {_ACCEPT} AS accepted, coalesce(bins,0) AS bins,
 {S('gdelta')} AS global_delta, {S('gr2')} AS global_r2, gacc AS global_accepted
FROM g CROSS JOIN (SELECT unnest(range(12)) AS iy) yy CROSS JOIN (SELECT unnest(range(16)) AS ix) xx
LEFT JOIN c ON c.frame=g.frame AND c.iy=yy.iy AND c.ix=xx.ix""", ("particles",))
def agg11(spark, sf):
    out = fit.power_law_map(_edged(_cell_hist(spark, sf)), ["frame"], Y_AXIS.n, X_AXIS.n)
    return out.withColumns({c: snap(F.col(c)) for c in ("delta", "r2", "global_delta", "global_r2")})


@query("agg13_axis_projection", f"WITH {_HIST_SQL} SELECT frame, ie, sum(weight) AS weight FROM h GROUP BY ALL", ("particles",))
def agg13(spark, sf):
    return B.project_axis(_cell_hist(spark, sf), ["frame", "ie"], "weight")


@query("agg27_cell_moments", f"""
WITH b AS (SELECT frame, {IY} AS iy, {IX} AS ix, weight AS w, mu, energy_ev AS e FROM particles WHERE status=0),
m AS (SELECT frame, iy, ix, count(*) AS n, sum(w) AS weight_sum, min(e) AS min_e, max(e) AS max_e,
 coalesce(sum(w*mu)/nullif(sum(w),0),0e0) AS mean, coalesce(sum(w*mu*mu)/nullif(sum(w),0),0e0) AS square
 FROM b WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY ALL)
SELECT frame, iy, ix, n, weight_sum, {S('min_e', 3)} AS min_energy_ev, {S('max_e', 3)} AS max_energy_ev,
 {S('mean', 7)} AS mean_mu, {S('greatest(square-mean*mean,0e0)', 7)} AS var_mu FROM m""", ("particles",))
def agg27(spark, sf):
    p = T.particles(spark, sf).filter(F.col("status") == 0).withColumns(
        {"iy": Y_AXIS.histogram_index(F.col("y")), "ix": X_AXIS.histogram_index(F.col("x"))})
    out = runs.cell_moments(p.filter(F.col("ix").isNotNull() & F.col("iy").isNotNull()), ["frame", "iy", "ix"])
    return out.withColumns({"min_energy_ev": snap(F.col("min_energy_ev"), 3), "max_energy_ev": snap(F.col("max_energy_ev"), 3),
                            "mean_mu": snap(F.col("mean_mu"), 7), "var_mu": snap(F.col("var_mu"), 7)})


@query("agg30_movie_index", """
SELECT frame, count(*) AS particle_count, sum(weight) AS active_weight, sum(CASE WHEN energy_ev<2e5 THEN weight ELSE 0e0 END) AS below_threshold_weight,
 sum(CASE WHEN energy_ev<2e5 THEN 0e0 ELSE weight END) AS above_threshold_weight FROM particles
WHERE status=0 AND x BETWEEN 1e3 AND 1e5 AND y BETWEEN 1e0 AND 5e1 GROUP BY frame""", ("particles",))
def agg30(spark, sf):
    p = T.particles(spark, sf).filter((F.col("status") == 0) & X_AXIS.contains(F.col("x")) & Y_AXIS.contains(F.col("y")))
    return compare.movie_index(p, 2.0e5, ["frame"])


@query("flt1_active_above", "SELECT frame, particle_id, p, weight FROM particles WHERE status=0 AND energy_ev>=5e5", ("particles",))
def flt1(spark, sf):
    p = T.particles(spark, sf)
    return p.filter(P.active_above(F.col("status"), F.col("energy_ev"), 5.0e5)).select("frame", "particle_id", "p", "weight")


@query("flt2_threshold_split", f"""
WITH b AS (SELECT frame, {IY} AS iy, {IX} AS ix, energy_ev, weight FROM particles WHERE status=0)
SELECT frame, iy, ix, sum(weight) AS weight, sum(CASE WHEN energy_ev<2e5 THEN weight ELSE 0e0 END) AS below,
 sum(CASE WHEN energy_ev>=2e5 THEN weight ELSE 0e0 END) AS above FROM b WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY ALL""", ("particles",))
def flt2(spark, sf):
    p = T.particles(spark, sf).filter(F.col("status") == 0)
    hot = F.col("energy_ev") >= 2.0e5
    return B.deposit(p, X_AXIS, Y_AXIS, values={"below": F.when(hot, 0.0).otherwise(F.col("weight")),
                                                "above": F.when(hot, F.col("weight")).otherwise(0.0)})


@query("flt3_region", "SELECT frame, count(*) AS n, sum(weight) AS weight FROM particles WHERE x BETWEEN 2e4 AND 5e4 AND y BETWEEN 1e1 AND 2e1 GROUP BY frame", ("particles",))
def flt3(spark, sf):
    inside = P.in_region({"x": (2.0e4, 5.0e4), "y": (10.0, 20.0)})
    return T.particles(spark, sf).filter(inside).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


_MODE_SQL = {"greater": "mu>5e-1", "greater_equal": "mu>=5e-1", "less": "mu<5e-1", "less_equal": "mu<=5e-1",
             "abs_greater": "abs(mu)>5e-1", "abs_less": "abs(mu)<5e-1"}


@query("flt4_threshold", "SELECT frame, " + ", ".join(f"count(*) FILTER ({c}) AS n_{m}" for m, c in _MODE_SQL.items())
       + " FROM particles GROUP BY frame", ("particles",))
def flt4(spark, sf):
    return T.particles(spark, sf).groupBy("frame").agg(*[
        F.count(F.when(P.compare(F.col("mu"), 0.5, m), 1)).alias(f"n_{m}") for m in P.COMPARISONS])


@query("flt5_field_threshold", """
WITH pts AS (SELECT particle_id, frame % 4 AS frame, user_id, x/1.5e1 AS gx, y FROM event_particles),
hit AS (SELECT p.particle_id, p.frame, p.user_id, coalesce(g.bx>=3e1, false) AS passes FROM pts p
 LEFT JOIN grid g ON g.frame=p.frame AND g.iy=CAST(floor(p.y) AS INTEGER) AND p.gx<=3e1 AND g.ix=CASE WHEN p.gx=3e1 THEN 29 ELSE CAST(floor(p.gx) AS INTEGER) END)
SELECT frame, user_id, count(*) AS n, count(*) FILTER (passes) AS passing FROM hit GROUP BY ALL""", ("event_particles", "grid"))
def flt5(spark, sf):
    pts = T.event_particles(spark, sf).select("particle_id", (F.col("frame") % 4).alias("frame"), "user_id", (F.col("x") / 15.0).alias("gx"), "y")
    axes = {"ix": Axis.uniform(0.0, 30.0, 30), "iy": Axis.uniform(0.0, 24.0, 24)}
    out = lookup.field_threshold(pts, T.grid(spark, sf), axes, {"ix": "gx", "iy": "y"}, P.compare(F.col("bx"), 30.0, "greater_equal"))
    return out.groupBy("frame", "user_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("passes"), 1)).alias("passing"))


@query("flt6_lifecycle", "SELECT frame, count(*) FILTER (status=1) AS escaped, count(*) FILTER (status=2) AS inactive, count(*) FILTER (status IN (1,2)) AS recyclable FROM particles GROUP BY frame", ("particles",))
def flt6(spark, sf):
    return T.particles(spark, sf).groupBy("frame").agg(*[
        F.count(F.when(P.lifecycle(F.col("status"), s), 1)).alias(s) for s in ("escaped", "inactive", "recyclable")])


@query("flt14_cadence", """
WITH e AS (SELECT max(frame) AS last FROM particles)
SELECT frame, count(*) AS n FROM particles, e WHERE (frame-1) % 7 = 0 OR frame=last GROUP BY frame""", ("particles",))
def flt14(spark, sf):
    p = T.particles(spark, sf)
    end = runs.latest_frame(p).first()["frame"]
    return p.filter(P.on_cadence(F.col("frame"), 1, end, 7)).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("flt10_finite_positive", "SELECT frame, count(*) FILTER (weight>0) AS positive, count(*) FILTER (log10(CASE WHEN weight>0 THEN weight END) IS NOT NULL) AS loggable FROM particles GROUP BY frame", ("particles",))
def flt10(spark, sf):
    from fieldframe.functions.numeric import finite, finite_positive

    log = F.log10(F.when(F.col("weight") > 0, F.col("weight")))
    return T.particles(spark, sf).groupBy("frame").agg(
        F.count(F.when(finite_positive(F.col("weight")), 1)).alias("positive"), F.count(F.when(finite(log), 1)).alias("loggable"))


# -- kinematics ---------------------------------------------------------------------------------------

@query("prj1_kinematics", f"""
SELECT particle_id, p, {S(_GAMMA, 9)} AS gamma, {S(f'p/({_GAMMA}*1e0)', 9)} AS speed, {S(f'({_GAMMA}-1e0)*1e0*2e0*2e0', 8)} AS energy, {S(_ENERGY, 2)} AS energy_kin_ev FROM particles""", ("particles",))
def prj1(spark, sf):
    m, c, e, p = F.lit(_MASS), F.lit(_LIGHT), F.lit(_SCALE_ERG), F.col("p")
    return T.particles(spark, sf).select(
        "particle_id", "p", snap(K.gamma(p, m, c), 9).alias("gamma"), snap(K.speed(p, m, c), 9).alias("speed"),
        snap(K.kinetic_energy(p, m, c), 8).alias("energy"), snap(K.kinetic_energy_ev(p, m, c, e), 2).alias("energy_kin_ev"))


@query("prj2_vector_momentum", f"""
SELECT particle_id, {S('CASE WHEN split_level>0 THEN p ELSE sqrt((p*mu)*(p*mu)+(p/2e0)*(p/2e0)+y*y) END', 8)} AS p_abs FROM particles""", ("particles",))
def prj2(spark, sf):
    p = F.col("p")
    stored = F.when(F.col("split_level") > 0, p)
    return T.particles(spark, sf).select("particle_id", snap(K.momentum_magnitude(stored, p * F.col("mu"), p / 2.0, F.col("y")), 8).alias("p_abs"))


_REF = D(math.sqrt(1.0 + 0.1 * 0.1) - 1.0)
_TRANSPORT = f"((sqrt(p*p+1e0)-1e0)/{_REF}*1e0)"


@query("prj3_energy_source", f"""
WITH s AS (SELECT *, CASE WHEN species=3 AND split_level=1 THEN 'transport-p0-kinetic-kev' WHEN split_level=2 THEN 'momentum-kev' ELSE 'snapshot-kinetic' END AS source FROM particles)
SELECT frame, source, count(*) AS n, {S(f"max(CASE source WHEN 'momentum-kev' THEN p*1e3 WHEN 'snapshot-kinetic' THEN (sqrt((p/split)*(p/split)+1e0)-1e0)*split*1e0*1e0*1e0/{D(C.ELECTRON_VOLT)}*1e-12 ELSE {_TRANSPORT}*1e3 END)", 4)} AS top
FROM (SELECT *, CAST(greatest(split_level,1) AS DOUBLE) AS split FROM s) GROUP BY ALL""", ("particles",))
def prj3(spark, sf):
    p = T.particles(spark, sf).withColumns({
        "mass": F.greatest(F.col("split_level"), F.lit(1)).cast("double"), "c": F.lit(1.0),
        "scale": F.when((F.col("split_level") == 1) & (F.col("species") == 3), 1.0).otherwise(1.0e-12)})
    auto = K.energy_source(F.col("species"), F.col("mass"), F.col("c"), F.col("scale"))
    source = F.when(F.col("split_level") == 2, "momentum-kev").otherwise(auto)
    energy = K.energy_ev(F.col("p"), F.col("source"), F.col("mass"), F.col("c"), F.col("scale"))
    return p.withColumn("source", source).withColumn("e", energy).groupBy("frame", "source").agg(
        F.count(F.lit(1)).alias("n"), snap(F.max("e"), 4).alias("top"))


@query("prj5_energy_kev", f"SELECT particle_id, {S(_TRANSPORT, 5)} AS energy_kev FROM particles", ("particles",))
def prj5(spark, sf):
    return T.particles(spark, sf).select("particle_id", snap(K.transport_energy_kev(F.col("p"), 0.1, 1.0), 5).alias("energy_kev"))


@query("prj6_status_flags", "SELECT frame, sum(CAST(status=0 AS INTEGER))::BIGINT AS active, sum(CAST(status=1 AS INTEGER))::BIGINT AS escaped, sum(CAST(status=2 AS INTEGER))::BIGINT AS inactive FROM particles GROUP BY frame", ("particles",))
def prj6(spark, sf):
    flags = K.status_flags(F.col("status"))
    return T.particles(spark, sf).select("frame", *[c.alias(n) for n, c in flags.items()]).groupBy("frame").agg(
        F.sum("is_active").alias("active"), F.sum("is_escaped").alias("escaped"), F.sum("is_inactive").alias("inactive"))


@query("prj7_species", f"""
SELECT species, CASE species WHEN 0 THEN 'proton' WHEN 1 THEN 'electron' WHEN 2 THEN 'alpha' ELSE 'custom' END AS name,
 CASE species WHEN 0 THEN {D(C.PROTON_MASS)} WHEN 1 THEN {D(C.ELECTRON_MASS)} WHEN 2 THEN {D(C.ALPHA_MASS)} ELSE 1e0 END AS mass,
 CASE species WHEN 0 THEN {D(C.ELEMENTARY_CHARGE)} WHEN 1 THEN {D(-C.ELEMENTARY_CHARGE)} WHEN 2 THEN {D(2 * C.ELEMENTARY_CHARGE)} ELSE 1e0 END AS charge,
 count(*) AS n FROM particles GROUP BY species""", ("particles",))
def prj7(spark, sf):
    s = F.col("species")
    return T.particles(spark, sf).groupBy("species").agg(F.count(F.lit(1)).alias("n")).select(
        "species", K.species_name(s).alias("name"), K.species_mass(s).alias("mass"), K.species_charge(s).alias("charge"), "n")


@query("prj24_spectrum", f"""
WITH base AS ({HISTOGRAM_SQL.replace('WITH hist', 'WITH hist')}),
e AS (SELECT frame, bin, exp({_LOG}+bin*{D(_STEP)}) AS l, exp({_LOG}+(bin+1)*{D(_STEP)}) AS r, weight FROM base),
k AS (SELECT *, (sqrt(l*l+1e0)-1e0)/{_REF} AS el, (sqrt(r*r+1e0)-1e0)/{_REF} AS er FROM e)
SELECT frame, bin, {S('sqrt(l*r)', 8)} AS p_center, {S('sqrt(el*er)', 6)} AS energy_center_kev, {S('weight/(log10(r)-log10(l))', 4)} AS dndlog10p,
 {S('weight/(log10(er)-log10(el))', 4)} AS dndlog10e FROM k""", ("particles",))
def prj24(spark, sf):
    out = B.spectrum_columns(B.momentum_histogram(T.particles(spark, sf)))
    return out.select("frame", "bin", snap(F.col("p_center"), 8).alias("p_center"), snap(F.col("energy_center_kev"), 6).alias("energy_center_kev"),
                      snap(F.col("dndlog10p"), 4).alias("dndlog10p"), snap(F.col("dndlog10e"), 4).alias("dndlog10e"))


@query("prj40_pitch_policy", """
SELECT frame, CASE WHEN frame % 2 = 0 THEN 'pitch_angle_cosine' ELSE 'unavailable' END AS mode, CASE WHEN frame % 2 = 0 THEN max(mu) ELSE 0e0 END AS top FROM particles GROUP BY frame""", ("particles",))
def prj40(spark, sf):
    model = F.when(F.col("frame") % 2 == 0, "focused").otherwise("parker")
    out = T.particles(spark, sf).groupBy("frame").agg(F.max("mu").alias("m"))
    policy = K.pitch_angle_policy(model, F.lit("pitch_angle_cosine"), F.col("m"), F.lit(0.0))
    return out.select("frame", policy["pitch_angle_mode"].alias("mode"), policy["mean_mu"].alias("top"))
