"""Queries on gridded fields: stencils, resampling, sampling at points, time, blocks."""

from __future__ import annotations


from pyspark.sql import functions as F

from fieldframe.functions import geometry as G
from fieldframe.functions import units as U
from fieldframe.functions.axes import Axis, linear_edges, pixel_centers
from fieldframe.operators import binning as B
from fieldframe.operators import grid as R
from fieldframe.operators import lookup
from fieldframe.plans import tables as T
from fieldframe.plans.registry import number as D
from fieldframe.plans.registry import query, snap
from fieldframe.plans.registry import sql_snap as S
from fieldframe.session import scratch_dir
from fieldframe.sources import tables as IO

X = Axis.uniform(0.5, 6.5, 30, periodic=True)
Y = Axis.uniform(0.2, 2.6, 24)
AXES = {"ix": X, "iy": Y}
COMPONENTS = ["bx", "by", "bz", "vx", "vy", "vz"]


def _x(i: str = "ix") -> str:
    step = D(X.step)
    return f"((({D(X.start)}+({i})*{step})+({D(X.start)}+(({i})+1)*{step}))*5e-1)"


def _y(i: str = "iy") -> str:
    step = D(Y.step)
    return f"((({D(Y.start)}+({i})*{step})+({D(Y.start)}+(({i})+1)*{step}))*5e-1)"


def _around(columns: list[str], extra: str = "") -> str:
    """Neighbour values by self-join: periodic in x, clamped in y."""
    parts = []
    for c in columns:
        parts += [f"xl.{c} AS {c}_xl", f"xr.{c} AS {c}_xr", f"yl.{c} AS {c}_yl", f"yr.{c} AS {c}_yr"]
    return f"""n AS (SELECT g.*, {', '.join(parts)}{extra} FROM grid g
 JOIN grid xl ON xl.frame=g.frame AND xl.iy=g.iy AND xl.ix=(g.ix+29) % 30 JOIN grid xr ON xr.frame=g.frame AND xr.iy=g.iy AND xr.ix=(g.ix+1) % 30
 JOIN grid yl ON yl.frame=g.frame AND yl.ix=g.ix AND yl.iy=greatest(g.iy-1,0) JOIN grid yr ON yr.frame=g.frame AND yr.ix=g.ix AND yr.iy=least(g.iy+1,23))"""


def _slope(c, l, m, r) -> str:
    """Three-point derivative from positions (xl, xc, xr) and values."""
    xl, xc, xr = c
    return (f"(((({m})-({l}))/(({xc})-({xl})))*(({xr})-({xc}))+((({r})-({m}))/(({xr})-({xc})))*(({xc})-({xl})))"
            f"/((({xc})-({xl}))+(({xr})-({xc})))")


XP = (_x("ix-1"), _x("ix"), _x("ix+1"))
YP = (_y("iy-1"), _y("iy"), _y("iy+1"))


@query("grd3_gradient", f"""WITH {_around(['bx'])}
SELECT frame, ix, iy, {S(_slope(XP, 'bx_xl', 'bx', 'bx_xr'))} AS grad_1, {S(f"({_slope(YP, 'bx_yl', 'bx', 'bx_yr')})/{_x()}")} AS grad_2 FROM n""", ("grid",))
def grd3(spark, sf):
    out = R.gradient(T.grid(spark, sf), AXES, "bx", ["frame"], "polar")
    return out.select("frame", "ix", "iy", snap(F.col("grad_1")).alias("grad_1"), snap(F.col("grad_2")).alias("grad_2"))


@query("grd4_divergence", f"""WITH {_around(['bx', 'by'])}
SELECT frame, ix, iy, {S(f"(({_slope(XP, f'bx_xl*({XP[0]})', f'bx*({XP[1]})', f'bx_xr*({XP[2]})')})+({_slope(YP, 'by_yl', 'by', 'by_yr')}))/({XP[1]})")} AS divergence FROM n""", ("grid",))
def grd4(spark, sf):
    out = R.divergence(T.grid(spark, sf), AXES, ["bx", "by"], ["frame"], "polar")
    return out.select("frame", "ix", "iy", snap(F.col("divergence")).alias("divergence"))


@query("grd5_curl", f"""WITH {_around(['bx', 'by', 'bz'])}
SELECT frame, ix, iy, {S(f"({_slope(YP, 'bz_yl', 'bz', 'bz_yr')})/({XP[1]})")} AS curl_1, {S(f"-({_slope(XP, 'bz_xl', 'bz', 'bz_xr')})")} AS curl_2,
 {S(f"(({_slope(XP, f'by_xl*({XP[0]})', f'by*({XP[1]})', f'by_xr*({XP[2]})')})-({_slope(YP, 'bx_yl', 'bx', 'bx_yr')}))/({XP[1]})")} AS curl_3 FROM n""", ("grid",))
def grd5(spark, sf):
    out = R.curl(T.grid(spark, sf), AXES, ["bx", "by", "bz"], ["frame"], "polar")
    return out.select("frame", "ix", "iy", *[snap(F.col(f"curl_{k}")).alias(f"curl_{k}") for k in (1, 2, 3)])


# unequal positions for the one-sided derivative
_QX, _QY = "(1e-2*ix*ix+ix)", "(5e-1*iy+1e-3*iy*iy*iy)"


def _parabola(v, q) -> str:
    (v0, v1, v2), (q0, q1, q2) = v, q
    near, far = f"(({v1}-{v0})/({q1}-{q0}))", f"(({v2}-{v1})/({q2}-{q1}))"
    return f"({near}+({near}-{far})*({q1}-{q0})/({q2}-{q0}))"


def _np_gradient(v: str, q: str, order: str, part: str) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY {order})"

    def at(c, k):
        return c if k == 0 else (f"lag({c},{-k}) {w}" if k < 0 else f"lead({c},{k}) {w}")

    inner = _slope((at(q, -1), q, at(q, 1)), at(v, -1), v, at(v, 1))
    first = _parabola([at(v, k) for k in (0, 1, 2)], [at(q, k) for k in (0, 1, 2)])
    last = _parabola([at(v, -k) for k in (0, 1, 2)], [at(q, -k) for k in (0, 1, 2)])
    return f"CASE WHEN lag({v}) {w} IS NULL THEN {first} WHEN lead({v}) {w} IS NULL THEN {last} ELSE {inner} END"


@query("grd6_jz", f"""WITH q AS (SELECT *, {_QX} AS x, {_QY} AS y FROM grid),
d AS (SELECT frame, ix, iy, {_np_gradient('by', 'x', 'ix', 'frame, iy')} AS dby, {_np_gradient('bx', 'y', 'iy', 'frame, ix')} AS dbx FROM q)
SELECT frame, ix, iy, {S('dby-dbx')} AS jz FROM d""", ("grid",))
def grd6(spark, sf):
    ix, iy = F.col("ix"), F.col("iy")
    g = T.grid(spark, sf).withColumns({"x": ix * ix * 0.01 + ix, "y": iy * 0.5 + iy * iy * iy * 0.001})
    return R.current_proxy(g, ["frame"]).select("frame", "ix", "iy", snap(F.col("jz")).alias("jz"))


_FULL = ["vx", "vy", "vz", "bx", "by", "bz", "bmag"]


@query("grd7_gradient_table", f"""WITH grid2 AS (SELECT *, sqrt(bx*bx+by*by+bz*bz) AS bmag FROM grid), {_around(_FULL).replace('grid', 'grid2')}
SELECT frame, ix, iy, vx, vy, vz, bx, by, bz, {S('bmag')} AS bmag, {', '.join(S(f'({c}_x_r-{c}_x_l)/(({XP[2]})-({XP[0]}))'.replace('_x_r', '_xr').replace('_x_l', '_xl')) + f' AS d{c}_dx' for c in _FULL)},
 {', '.join(S(f'({c}_yr-{c}_yl)/(({YP[2]})-({YP[0]}))') + f' AS d{c}_dy' for c in _FULL)} FROM n""", ("grid",))
def grd7(spark, sf):
    out = R.gradient_table(T.grid(spark, sf), AXES, ["frame"], full=True)
    rounded = [c for c in out.columns if c.startswith("d") or c == "bmag"]
    return out.withColumns({c: snap(F.col(c)) for c in rounded})


@query("grd1_uneven_derivative", f"""WITH q AS (SELECT frame, ix, iy, bx, {_QX} AS x FROM grid),
d AS (SELECT *, lag(bx) OVER w AS l, lead(bx) OVER w AS r, lag(x) OVER w AS xl, lead(x) OVER w AS xr FROM q WINDOW w AS (PARTITION BY frame, iy ORDER BY ix))
SELECT frame, ix, iy, {S(_slope(('xl', 'x', 'xr'), 'l', 'bx', 'r'))} AS slope FROM d WHERE l IS NOT NULL AND r IS NOT NULL""", ("grid",))
def grd1(spark, sf):
    from pyspark.sql import Window as W

    ix = F.col("ix")
    g = T.grid(spark, sf).withColumn("x", ix * ix * 0.01 + ix)
    w = W.partitionBy("frame", "iy").orderBy("ix")
    near = g.withColumns({"l": F.lag("bx").over(w), "r": F.lead("bx").over(w), "xl": F.lag("x").over(w), "xr": F.lead("x").over(w)})
    inside = near.filter(F.col("l").isNotNull() & F.col("r").isNotNull())
    slope = R.three_point(F.col("xl"), F.col("x"), F.col("xr"), F.col("l"), F.col("bx"), F.col("r"))
    return inside.select("frame", "ix", "iy", snap(slope).alias("slope"))


@query("grd2_ghosts", """
SELECT g.frame, CAST(x.gx AS INTEGER) AS ix, CAST(y.gy AS INTEGER) AS iy, g.bx FROM (SELECT unnest(range(-2,32)) AS gx) x CROSS JOIN (SELECT unnest(range(-2,26)) AS gy) y
JOIN grid g ON g.ix=(x.gx+30) % 30 AND g.iy=greatest(least(y.gy,23),0)""", ("grid",))
def grd2(spark, sf):
    return R.add_ghosts(T.grid(spark, sf), AXES, 2).select("frame", "ix", "iy", "bx")


@query("grd2_face_closure", """
SELECT frame, ix, iy, CASE WHEN ix=29 THEN first_value(bx) OVER (PARTITION BY frame, iy ORDER BY ix) ELSE bx END AS bx FROM grid""", ("grid",))
def grd2_faces(spark, sf):
    faces = {"ix": Axis.uniform(0.0, 1.0, 29, periodic=True), "iy": Y}
    return R.close_periodic_faces(T.grid(spark, sf), faces, ["bx"], ["frame"]).select("frame", "ix", "iy", "bx")


@query("grd8_time_interp", f"""
SELECT g.frame, g.ix, g.iy, {S('(1e0-3.5e-1)*g.bx+3.5e-1*h.bx')} AS bx, {S('(1e0-3.5e-1)*g.vy+3.5e-1*h.vy')} AS vy FROM grid g JOIN grid h ON h.frame=g.frame+1 AND h.ix=g.ix AND h.iy=g.iy""", ("grid",))
def grd8(spark, sf):
    g = T.grid(spark, sf).withColumn("t", F.col("frame").cast("double"))
    out = R.time_interpolate(g, ["bx", "vy"], ["ix", "iy"], F.col("t") + 0.35)
    return out.select("frame", "ix", "iy", snap(F.col("bx")).alias("bx"), snap(F.col("vy")).alias("vy"))


@query("win5_time_derivative", f"""
SELECT g.frame, g.ix, g.iy, {S('(h.bx-g.bx)/(25e-1)')} AS dbx_dt FROM grid g JOIN grid h ON h.frame=g.frame+1 AND h.ix=g.ix AND h.iy=g.iy""", ("grid",))
def win5(spark, sf):
    g = T.grid(spark, sf).withColumn("t", F.col("frame") * 2.5)
    return R.time_derivative(g, ["bx"], ["ix", "iy"]).select("frame", "ix", "iy", snap(F.col("dbx_dt")).alias("dbx_dt"))


@query("jon5_time_pairs", "SELECT g.frame, g.ix, g.iy, g.bx, h.bx AS bx_next FROM grid g LEFT JOIN grid h ON h.frame=g.frame+1 AND h.ix=g.ix AND h.iy=g.iy", ("grid",))
def jon5(spark, sf):
    g = T.grid(spark, sf).withColumn("t", F.col("frame").cast("double"))
    return R.time_pairs(g, ["bx"], ["ix", "iy"]).select("frame", "ix", "iy", "bx", "bx_next")


_TX, _TY = Axis.uniform(0.5, 6.5, 41), Axis.uniform(0.2, 2.6, 17)


@query("grd9_bilinear", f"""
WITH t AS (SELECT f.frame, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty,
 (((5e-1+tx*{D(_TX.step)})+(5e-1+(tx+1)*{D(_TX.step)}))*5e-1-5e-1)/{D(X.step)}-5e-1 AS gx, (((2e-1+ty*{D(_TY.step)})+(2e-1+(ty+1)*{D(_TY.step)}))*5e-1-2e-1)/{D(Y.step)}-5e-1 AS gy
 FROM (SELECT DISTINCT frame FROM grid) f CROSS JOIN (SELECT unnest(range(41)) AS tx) CROSS JOIN (SELECT unnest(range(17)) AS ty)),
c AS (SELECT *, CAST(greatest(least(floor(gx),28),0) AS INTEGER) AS i, CAST(greatest(least(floor(gy),22),0) AS INTEGER) AS j FROM t)
SELECT c.frame, tx AS ix, ty AS iy, {S('(1e0-(gx-i))*(1e0-(gy-j))*a.bx+(gx-i)*(1e0-(gy-j))*b.bx+(1e0-(gx-i))*(gy-j)*d.bx+(gx-i)*(gy-j)*e.bx', 5)} AS bx FROM c
 JOIN grid a ON a.frame=c.frame AND a.ix=i AND a.iy=j JOIN grid b ON b.frame=c.frame AND b.ix=i+1 AND b.iy=j
 JOIN grid d ON d.frame=c.frame AND d.ix=i AND d.iy=j+1 JOIN grid e ON e.frame=c.frame AND e.ix=i+1 AND e.iy=j+1""", ("grid",))
def grd9(spark, sf):
    plain = {"ix": Axis.uniform(0.5, 6.5, 30), "iy": Y}
    out = R.bilinear_resample(T.grid(spark, sf), plain, {"ix": _TX, "iy": _TY}, ["bx"], ["frame"])
    return out.select("frame", "ix", "iy", snap(F.col("bx"), 5).alias("bx"))


def _points(spark, sf):
    return T.event_particles(spark, sf).select("particle_id", (F.col("frame") % 4).alias("frame"),
                                               (F.col("x") * 0.013 + 0.5).alias("px"), (F.col("y") * 0.099 + 0.2).alias("py"))


_POINTS_SQL = "pts AS (SELECT particle_id, frame % 4 AS frame, x*1.3e-2+5e-1 AS px, y*9.9e-2+2e-1 AS py FROM event_particles)"


@query("jon3_point_in_cell", f"""WITH {_POINTS_SQL}
SELECT p.particle_id, g.ix, g.iy, g.bx FROM pts p JOIN grid g ON g.frame=p.frame AND g.ix=CAST(floor((px-5e-1)/{D(X.step)}) AS INTEGER) AND g.iy=CAST(floor((py-2e-1)/{D(Y.step)}) AS INTEGER)
WHERE px<65e-1 AND py<26e-1""", ("event_particles", "grid"))
def jon3(spark, sf):
    out = lookup.cell_lookup(_points(spark, sf), T.grid(spark, sf), AXES, {"ix": "px", "iy": "py"})
    return out.select("particle_id", "ix", "iy", "bx")


@query("jon4_multilinear", f"""WITH {_POINTS_SQL},
w AS (SELECT particle_id, frame, greatest(least((px-5e-1)/{D(X.step)}-5e-1,29e0),0e0) AS gx, greatest(least((py-2e-1)/{D(Y.step)}-5e-1,23e0),0e0) AS gy FROM (SELECT particle_id, frame, py, CASE WHEN px>=65e-1 THEN 5e-1+((px-5e-1)-6e0*floor((px-5e-1)/6e0)) ELSE px END AS px FROM pts) WHERE py<=26e-1),
c AS (SELECT *, CAST(floor(gx) AS INTEGER) AS i, CAST(floor(gy) AS INTEGER) AS j FROM w)
SELECT particle_id, {', '.join(S(f'(1e0-(gx-i))*(1e0-(gy-j))*a.{c}+(gx-i)*(1e0-(gy-j))*b.{c}+(1e0-(gx-i))*(gy-j)*d.{c}+(gx-i)*(gy-j)*e.{c}', 5) + f' AS s_{c}' for c in ('bx', 'vy'))} FROM c
 JOIN grid a ON a.frame=c.frame AND a.ix=i AND a.iy=j JOIN grid b ON b.frame=c.frame AND b.ix=least(i+1,29) AND b.iy=j
 JOIN grid d ON d.frame=c.frame AND d.ix=i AND d.iy=least(j+1,23) JOIN grid e ON e.frame=c.frame AND e.ix=least(i+1,29) AND e.iy=least(j+1,23)""", ("event_particles", "grid"))
def jon4(spark, sf):
    out = R.multilinear_sample(_points(spark, sf), T.grid(spark, sf), AXES, {"ix": "px", "iy": "py"}, ["bx", "vy"], ["frame"])
    return out.select("particle_id", snap(F.col("s_bx"), 5).alias("s_bx"), snap(F.col("s_vy"), 5).alias("s_vy"))


@query("agg8_coarse_average", f"""
WITH c AS (SELECT frame, CAST(least(floor(({_y()}-2e-1)/{D(Y.width)}*5e0),4e0) AS INTEGER) AS cy, CAST(least(floor(({_x()}-5e-1)/{D(X.width)}*7e0),6e0) AS INTEGER) AS cx, bx, bz FROM grid)
SELECT frame, cy AS iy, cx AS ix, {S('avg(bx)')} AS bx, {S('avg(bz)')} AS bz FROM c GROUP BY ALL""", ("grid",))
def agg8(spark, sf):
    out = B.coarse_average(T.grid(spark, sf), X, Y, 7, 5, ["bx", "bz"])
    return out.select("frame", "iy", "ix", snap(F.col("bx")).alias("bx"), snap(F.col("bz")).alias("bz"))


@query("src6_stitch_blocks", """
SELECT frame, iy, ix, bx, by FROM grid""", ("grid",))
def src6(spark, sf):
    g = T.grid(spark, sf)
    values = F.explode(F.create_map(F.lit("bx"), F.col("bx"), F.lit("by"), F.col("by"))).alias("var", "value")
    blocks = g.select("frame", (F.col("ix") / 6).cast("int").alias("li"), (F.col("iy") / 8).cast("int").alias("lj"),
                      (F.col("ix") % 6).alias("i"), (F.col("iy") % 8).alias("j"), values)
    return R.stitch_blocks(blocks, 6, 8, ["bx", "by"])


@query("src7_aliases", "SELECT frame, ix, iy, bx, by, bz, vx, vy, vz, bx+1e0 AS rho FROM grid", ("grid",))
def src7(spark, sf):
    named = T.grid(spark, sf).withColumnsRenamed({"bx": "Bcc1", "by": "B2", "bz": "B_z", "vx": "vel1", "vy": "v2", "vz": "V3"})
    return R.resolve_aliases(named.withColumn("dens", F.col("Bcc1") + 1.0))


_GOOD = "CASE WHEN bx>0 THEN bx END"
_PROXY = "CASE WHEN bx>0 THEN by/bx ELSE 0e0 END"


@query("prj18_background_maps", f"""
WITH p AS (SELECT frame, ix, iy, bx AS rho, by AS pressure, {_PROXY} AS tp FROM grid),
m AS (SELECT frame, coalesce(avg(CASE WHEN rho>0 THEN rho END),1e0) AS mr, coalesce(avg(CASE WHEN tp>0 THEN tp END),1e0) AS mt FROM p GROUP BY frame)
SELECT p.frame, ix, iy, {S('rho/mr*1e0')} AS density_1e9, {S('tp/mt*2e0')} AS temperature_mk, 'mean' AS normalization FROM p JOIN m ON m.frame=p.frame""", ("grid",))
def prj18(spark, sf):
    fluid = T.grid(spark, sf).select("frame", "ix", "iy", F.col("bx").alias("rho"), F.col("by").alias("pressure"))
    maps = R.background_maps(fluid, 1.0, 2.0)
    path = scratch_dir(spark, "background-maps")
    IO.write_background_maps(maps, path)
    out = spark.read.schema(maps.schema).parquet(path)
    return out.select("frame", "ix", "iy", snap(F.col("thermal_density_cm3")).alias("density_1e9"),
                      snap(F.col("temperature_mk")).alias("temperature_mk"), "normalization")


@query("prj18_normalize_max", f"""
WITH m AS (SELECT frame, max({_GOOD}) AS top FROM grid GROUP BY frame)
SELECT g.frame, ix, iy, {S('bx/coalesce(top,1e0)*7e0')} AS bx FROM grid g JOIN m ON m.frame=g.frame""", ("grid",))
def prj18_max(spark, sf):
    out = R.normalize_map(T.grid(spark, sf), "bx", 7.0, "max")
    return out.select("frame", "ix", "iy", snap(F.col("bx")).alias("bx"))


@query("prj25_vectors", f"""
WITH m AS (SELECT *, sqrt(bx*bx+by*by+bz*bz) AS size FROM grid)
SELECT frame, ix, iy, {S('size')} AS magnitude, {S('bx*vx+by*vy+bz*vz', 4)} AS dot, {', '.join(S(f'CASE WHEN size<=1e1 THEN 0e0 ELSE {c}/size END') + f' AS dir_{c}' for c in ('bx', 'by', 'bz'))} FROM m""", ("grid",))
def prj25(spark, sf):
    b, v = [F.col(c) for c in ("bx", "by", "bz")], [F.col(c) for c in ("vx", "vy", "vz")]
    d = G.direction(b, 10.0)
    return T.grid(spark, sf).select("frame", "ix", "iy", snap(G.magnitude(b)).alias("magnitude"), snap(G.dot(b, v), 4).alias("dot"),
                                    *[snap(x).alias(f"dir_{c}") for c, x in zip(("bx", "by", "bz"), d)])


@query("prj26_lame", f"""
WITH q AS (SELECT frame, ix, iy, {_x()} AS r, {_y()} AS th FROM grid)
SELECT frame, ix, iy, {S('r', 9)} AS h2, {S('r*sin(th)', 9)} AS h3, {S('r*(r*sin(th))', 9)} AS jac, {S('r*2.5e-1', 9)} AS dist, abs(sin(th))<=1e-14 AS singular FROM q""", ("grid",))
def prj26(spark, sf):
    q = [X.center(F.col("ix")), Y.center(F.col("iy")), F.lit(0.0)]
    h = G.lame("spherical", q)
    return T.grid(spark, sf).select(
        "frame", "ix", "iy", snap(h[1], 9).alias("h2"), snap(h[2], 9).alias("h3"), snap(G.jacobian("spherical", q), 9).alias("jac"),
        snap(G.physical_distance("spherical", 1, F.lit(0.25), q), 9).alias("dist"), G.is_singular("spherical", q).alias("singular"))


@query("prj27_cell_volume", f"SELECT frame, ix, iy, {S(f'{_x()}*{D(X.step)}*{D(Y.step)}', 9)} AS volume FROM grid", ("grid",))
def prj27(spark, sf):
    i, j = F.col("ix"), F.col("iy")
    volume = G.cell_volume("polar", [X.center(i), Y.center(j)], [X.cell_width(i), Y.cell_width(j)])
    return T.grid(spark, sf).select("frame", "ix", "iy", snap(volume, 9).alias("volume"))


@query("prj44_cartesian", f"""
WITH q AS (SELECT *, {_x()} AS r, {_y()} AS th, ix*1e-1 AS ph FROM grid)
SELECT frame, ix, iy, {S('r*cos(th)', 8)} AS px, {S('r*sin(th)', 8)} AS py, {S('r*sin(th)*cos(ph)', 8)} AS sx, {S('r*sin(th)*sin(ph)', 8)} AS sy, {S('r*cos(th)', 8)} AS sz,
 {S('bx*cos(th)-by*sin(th)', 5)} AS pvx, {S('bx*sin(th)+by*cos(th)', 5)} AS pvy, {S('(bx*sin(th)+by*cos(th))*cos(ph)-bz*sin(ph)', 5)} AS svx,
 {S('(bx*sin(th)+by*cos(th))*sin(ph)+bz*cos(ph)', 5)} AS svy, {S('bx*cos(th)-by*sin(th)', 5)} AS svz FROM q""", ("grid",))
def prj44(spark, sf):
    q = [X.center(F.col("ix")), Y.center(F.col("iy")), F.col("ix") * 0.1]
    v = [F.col(c) for c in ("bx", "by", "bz")]
    p, s = G.to_cartesian_point("polar", q), G.to_cartesian_point("spherical", q)
    pv, sv = G.to_cartesian_vector("polar", q, v), G.to_cartesian_vector("spherical", q, v)
    return T.grid(spark, sf).select(
        "frame", "ix", "iy", snap(p[0], 8).alias("px"), snap(p[1], 8).alias("py"), snap(s[0], 8).alias("sx"), snap(s[1], 8).alias("sy"),
        snap(s[2], 8).alias("sz"), snap(pv[0], 5).alias("pvx"), snap(pv[1], 5).alias("pvy"), snap(sv[0], 5).alias("svx"),
        snap(sv[1], 5).alias("svy"), snap(sv[2], 5).alias("svz"))


# -- axes ------------------------------------------------------------------------------------------------

_LOGX = Axis.log(1.0, 1000.0, 20)
_GROW = Axis.linear_width(0.0, 1.0, 0.5, 30)
_STORED = Axis.stored([0.0, 1.0, 2.5, 10.0, 40.0, 41.0, 100.0, 250.0])


@query("prj30_cell_index", f"""
SELECT event_id, CASE WHEN value<1e0 THEN -1 WHEN value>{D(_LOGX.upper)} THEN 20 WHEN value={D(_LOGX.upper)} THEN 19 ELSE CAST(floor((ln(value)-0e0)/{D(_LOGX.step)}) AS INTEGER) END AS log_cell,
 CASE WHEN value>{D(_GROW.upper)} THEN 30 WHEN value={D(_GROW.upper)} THEN 29 ELSE CAST(floor((sqrt(5.625e-1+(value-0e0)*1e0)-7.5e-1)/5e-1) AS INTEGER) END AS growing_cell,
 CASE WHEN value<0e0 THEN -1 WHEN value>2.5e2 THEN 7 WHEN value=2.5e2 THEN 6 ELSE {'+'.join(f'CAST(value>={D(e)} AS INTEGER)' for e in _STORED.edges)}-1 END AS stored_cell FROM events""")
def prj30(spark, sf):
    v = F.col("value")
    return T.table(spark, sf, "events").select("event_id", _LOGX.cell_index(v).alias("log_cell"), _GROW.cell_index(v).alias("growing_cell"),
                                               _STORED.cell_index(v).alias("stored_cell"))


@query("prj28_wrap", f"""
WITH w AS (SELECT event_id, value, value-floor((value-1e1)/9e1)*9e1 AS o FROM events),
f AS (SELECT *, CASE WHEN o>=1e2 THEN o-9e1 ELSE o END AS g FROM w)
SELECT event_id, {S('CASE WHEN g<1e1 THEN g+9e1 ELSE g END', 9)} AS wrapped, greatest(least(value,5e1),-5e1) AS clamped FROM f""")
def prj28(spark, sf):
    from fieldframe.functions.axes import wrap
    from fieldframe.functions.numeric import clamp

    v = F.col("value")
    return T.table(spark, sf, "events").select("event_id", snap(wrap(v, 10.0, 100.0), 9).alias("wrapped"), clamp(v, 50.0).alias("clamped"))


@query("prj31_edges", f"""
SELECT frame, CAST(k AS INTEGER) AS k, {S(f'0e0+k*{D(10.0 / 7)}', 9)} AS edge, CASE WHEN k<7 THEN {S(f'((0e0+k*{D(10.0 / 7)})+(0e0+(k+1)*{D(10.0 / 7)}))*5e-1', 9)} END AS center FROM (SELECT DISTINCT frame FROM grid) CROSS JOIN (SELECT unnest(range(8)) AS k)""", ("grid",))
def prj31(spark, sf):
    frames = T.grid(spark, sf).select("frame").distinct()
    edges = frames.select("frame", F.posexplode(linear_edges(0.0, 10.0, 7)).alias("k", "edge"), pixel_centers(0.0, 10.0, 7).alias("c"))
    return edges.select("frame", "k", snap(F.col("edge"), 9).alias("edge"), snap(F.get("c", F.col("k")), 9).alias("center"))


@query("jon6_range_join", """
WITH e AS (SELECT p_retailprice-9e2 AS lo, lead(p_retailprice) OVER (ORDER BY p_retailprice)-9e2 AS hi, p_partkey FROM (SELECT p_retailprice, min(p_partkey) AS p_partkey FROM part GROUP BY 1))
SELECT v.event_id, e.p_partkey FROM events v JOIN e ON v.value>=e.lo AND v.value<e.hi""")
def jon6(spark, sf):
    edges = T.table(spark, sf, "part").groupBy((F.col("p_retailprice") - 900.0).alias("edge")).agg(F.min("p_partkey").alias("p_partkey"))
    intervals = lookup.intervals_of(edges, "edge", ["p_partkey"])
    points = T.table(spark, sf, "events").select("event_id", "value")
    return lookup.interval_lookup(points, "value", intervals, "lo", "hi").select("event_id", "p_partkey")


@query("jon6_short_axis", """
SELECT event_type, CASE WHEN value<5e0 THEN 0 WHEN value<25e0 THEN 1 WHEN value<1e2 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM events WHERE value>=1e0 AND value<1e3 GROUP BY ALL""")
def jon6_short(spark, sf):
    bins = spark.createDataFrame([(0, 1.0, 5.0), (1, 5.0, 25.0), (2, 25.0, 100.0), (3, 100.0, 1000.0)], "bin int, lo double, hi double")
    found = lookup.interval_lookup(T.table(spark, sf, "events").select("event_type", "value"), "value", bins, "lo", "hi", short=True)
    return found.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))


# -- units -------------------------------------------------------------------------------------------------

_SYSTEM = U.UnitSystem.heliospheric()


@query("prj10_units", f"""
SELECT frame, ix, iy, {S(f"vx*{D(_SYSTEM.scale('velocity') * 1e-8)}", 4)} AS v_1e8, {S(f"bx*{D(U.UnitSystem.from_magnetic_field(2.0, 3.0, 5.0, 7.0).scale('magnetic_field'))}", 6)} AS b_cgs FROM grid""", ("grid",))
def prj10(spark, sf):
    out = U.convert_columns(T.grid(spark, sf), ["vx"], "velocity", _SYSTEM, U.UnitSystem(length=1.0e8), "1e8 cm/s")
    out = U.convert_columns(out, ["bx"], "magnetic_field", U.UnitSystem.from_magnetic_field(2.0, 3.0, 5.0, 7.0), unit="G")
    return out.select("frame", "ix", "iy", snap(F.col("vx"), 4).alias("v_1e8"), snap(F.col("bx"), 6).alias("b_cgs"))


@query("prj9_scale", f"""
SELECT frame, ix, iy, {S('ix*CASE WHEN frame=1 THEN 2.5e0 ELSE 1e0 END', 6)} AS x, {S('bx*CASE WHEN frame=2 THEN 3e-1 ELSE 1e0 END', 6)} AS value, CASE WHEN frame=1 THEN 'cm' ELSE 'code_length' END AS coordinate_unit,
 CASE WHEN frame=2 THEN 'cgs_value' ELSE 'code_value' END AS value_unit FROM grid""", ("grid",))
def prj9(spark, sf):
    g = T.grid(spark, sf).select("frame", "ix", "iy", F.col("ix").cast("double").alias("x"), F.col("bx").alias("value"),
                                 F.when(F.col("frame") == 1, 2.5).otherwise(1.0).alias("coordinate_scale_cgs"),
                                 F.when(F.col("frame") == 2, 0.3).otherwise(1.0).alias("value_scale_cgs"),
                                 F.lit("code_length").alias("coordinate_unit"), F.lit("code_value").alias("value_unit"))
    out = U.dimensionalize_field(g, ["x"], ["value"])
    return out.select("frame", "ix", "iy", snap(F.col("x")).alias("x"), snap(F.col("value")).alias("value"), "coordinate_unit", "value_unit")


@query("prj46_constants", f"""
SELECT symbol, count(*) AS n, {S('max(value_cgs/scale)*max(value)', 4)} AS top FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'au' ELSE 'day' END AS symbol,
 CASE user_id % 3 WHEN 0 THEN 2.99792458e10 WHEN 1 THEN 1.495978707e13 ELSE 8.64e4 END AS value_cgs, 1e10 AS scale, value FROM events) GROUP BY symbol""")
def prj46(spark, sf):
    e = T.table(spark, sf, "events").withColumn("symbol", F.get(F.array(F.lit("c"), F.lit("au"), F.lit("day")), (F.col("user_id") % 3).cast("int")))
    top = e.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    return top.join(F.broadcast(U.constants_table(spark)), "symbol").select("symbol", "n", snap(F.col("value_cgs") / 1.0e10 * F.col("v"), 4).alias("top"))


@query("prj41_frame_time", f"SELECT frame, count(*) AS n, {S(f'CAST(frame AS DOUBLE)*2e0*{D(0.25)}', 6)} AS seconds FROM grid GROUP BY frame", ("grid",))
def prj41(spark, sf):
    from fieldframe.functions.kinematics import frame_time

    return T.grid(spark, sf).groupBy("frame").agg(F.count(F.lit(1)).alias("n")).select("frame", "n", snap(frame_time(F.col("frame"), 2.0, 0.25)).alias("seconds"))


