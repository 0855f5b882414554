"""Queries on image cubes: spectra, beams, regions, limits, masks, radiometry."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions import numeric as N
from fieldframe.functions import predicates as P
from fieldframe.functions import radiometry as Q
from fieldframe.operators import image as I
from fieldframe.operators import memo as M
from fieldframe.plans import tables as T
from fieldframe.plans.registry import number as D
from fieldframe.plans.registry import query, snap
from fieldframe.plans.registry import sql_snap as S

KEYS = ["frame", "freq_idx"]
PIXEL = ["frame", "iy", "ix"]
CENTER = (9.5, 9.0)


@query("agg9_spectrum", f"SELECT frame, freq_hz, {S('sum(value)')} AS value FROM cube GROUP BY ALL", ("cube",))
def agg9(spark, sf):
    return I.spectrum(T.cube(spark, sf), ["frame", "freq_hz"]).withColumn("value", snap(F.col("value")))


def _beam_sql(fwhm: str) -> str:
    return f"exp(((ix-95e-1)*(ix-95e-1)+(iy-9e0)*(iy-9e0))*-5e-1/(({fwhm})*{D(Q.SIGMA_PER_FWHM)}*({fwhm})*{D(Q.SIGMA_PER_FWHM)}))"


@query("agg12_roi_gaussian", f"""
SELECT frame, freq_idx, {S(f"sum(value*{_beam_sql('6e0*1e10/freq_hz')})/sum({_beam_sql('6e0*1e10/freq_hz')})", 8)} AS value FROM cube GROUP BY ALL""", ("cube",))
def agg12(spark, sf):
    fwhm = Q.beam_fwhm(6.0, F.col("freq_hz"), 1.0e10)
    return I.roi_spectrum(T.cube(spark, sf), KEYS, "gaussian_beam", CENTER, fwhm=fwhm).withColumn("value", snap(F.col("value"), 8))


@query("flt8_roi_circle", f"""
SELECT frame, freq_idx, {S('sum(CASE WHEN (ix-95e-1)*(ix-95e-1)+(iy-9e0)*(iy-9e0)<=25e0 THEN value ELSE 0e0 END)')} AS value FROM cube GROUP BY ALL""", ("cube",))
def flt8(spark, sf):
    out = I.roi_spectrum(T.cube(spark, sf), KEYS, "circular_aperture", CENTER, radius=5.0)
    return out.withColumn("value", snap(F.col("value")))


@query("flt9_roi_full", f"SELECT frame, freq_idx, {S('sum(value)')} AS value FROM cube GROUP BY ALL", ("cube",))
def flt9(spark, sf):
    return I.roi_spectrum(T.cube(spark, sf), KEYS, "full_image").withColumn("value", snap(F.col("value")))


@query("prj33_beam_weights", f"""
WITH r AS (SELECT DISTINCT frame, iy, ix, {_beam_sql('6e0')} AS raw FROM cube), s AS (SELECT frame, sum(raw) AS total FROM r GROUP BY frame)
SELECT r.frame, iy, ix, {S('raw/total', 9)} AS w FROM r JOIN s ON s.frame=r.frame""", ("cube",))
def prj33(spark, sf):
    pixels = T.cube(spark, sf).select(*PIXEL).distinct()
    return I.beam_weights(pixels, ["frame"], CENTER, 6.0).withColumn("w", snap(F.col("w"), 9))


_KERNEL = I.gaussian_kernel(3.0)
_R = len(_KERNEL) // 2
_TAPS = ", ".join(f"({k - _R},{D(v)})" for k, v in enumerate(_KERNEL))


@query("grd10_beam", f"""
WITH k(off, w) AS (VALUES {_TAPS}),
ly AS (SELECT frame, freq_idx, ix, min(iy) AS lo, max(iy) AS hi FROM cube GROUP BY ALL),
a AS (SELECT l.frame, l.freq_idx, l.ix, o.iy, sum(c.value*k.w) AS v FROM ly l JOIN cube o ON o.frame=l.frame AND o.freq_idx=l.freq_idx AND o.ix=l.ix CROSS JOIN k
 JOIN cube c ON c.frame=l.frame AND c.freq_idx=l.freq_idx AND c.ix=l.ix AND c.iy=greatest(least(o.iy+k.off,l.hi),l.lo) GROUP BY ALL),
lx AS (SELECT frame, freq_idx, iy, min(ix) AS lo, max(ix) AS hi FROM cube GROUP BY ALL)
SELECT o.frame, o.freq_idx, o.iy, o.ix, {S('sum(c.v*k.w)')} AS value FROM lx l JOIN a o ON o.frame=l.frame AND o.freq_idx=l.freq_idx AND o.iy=l.iy CROSS JOIN k
 JOIN a c ON c.frame=l.frame AND c.freq_idx=l.freq_idx AND c.iy=l.iy AND c.ix=greatest(least(o.ix+k.off,l.hi),l.lo) GROUP BY ALL""", ("cube",))
def grd10(spark, sf):
    cube = T.cube(spark, sf).select("frame", "freq_idx", "iy", "ix", "value")
    return I.beam_convolve(cube, KEYS, fwhm=3.0).withColumn("value", snap(F.col("value")))


_SIG = f"(3e0*2e10/(freq_hz+2e10)*{D(Q.SIGMA_PER_FWHM)})"


@query("grd10_scaled_beam", f"""
WITH r AS (SELECT freq_idx, off, CASE WHEN abs(off)<=ceil(4e0*{_SIG}) THEN exp(-5e-1*off*off/({_SIG}*{_SIG})) ELSE 0e0 END AS raw FROM (SELECT DISTINCT freq_idx, freq_hz FROM cube) CROSS JOIN (SELECT unnest(range(-6,7)) AS off)),
k AS (SELECT freq_idx, off, raw/sum(raw) OVER (PARTITION BY freq_idx) AS w FROM r),
ly AS (SELECT frame, ix, max(iy) AS hi FROM cube GROUP BY ALL), lx AS (SELECT frame, iy, max(ix) AS hi FROM cube GROUP BY ALL),
a AS (SELECT o.frame, o.freq_idx, o.ix, o.iy, sum(c.value*k.w) AS v FROM cube o JOIN ly l ON l.frame=o.frame AND l.ix=o.ix JOIN k ON k.freq_idx=o.freq_idx
 JOIN cube c ON c.frame=o.frame AND c.freq_idx=o.freq_idx AND c.ix=o.ix AND c.iy=greatest(least(o.iy+k.off,l.hi),0) GROUP BY ALL),
z AS (SELECT o.frame, o.freq_idx, o.ix, o.iy, sum(c.v*k.w) AS v FROM a o JOIN lx l ON l.frame=o.frame AND l.iy=o.iy JOIN k ON k.freq_idx=o.freq_idx
 JOIN a c ON c.frame=o.frame AND c.freq_idx=o.freq_idx AND c.iy=o.iy AND c.ix=greatest(least(o.ix+k.off,l.hi),0) GROUP BY ALL)
SELECT frame, freq_idx, {S('sum(v)', 5)} AS value FROM z GROUP BY ALL""", ("cube",))
def grd10_scaled(spark, sf):
    cube = T.cube(spark, sf)
    fwhm = Q.beam_fwhm(3.0, F.col("freq_hz") + 2.0e10, 2.0e10)
    out = I.beam_convolve(cube, KEYS, fwhm=fwhm, max_fwhm=3.0)
    return out.groupBy("frame", "freq_idx").agg(snap(F.sum("value"), 5).alias("value"))


@query("grd11_frequency_slice", "SELECT frame, iy, ix, value FROM cube WHERE freq_idx=16", ("cube",))
def grd11(spark, sf):
    return I.frequency_slice(T.cube(spark, sf), 17.0e9, ["frame"]).select("frame", "iy", "ix", "value")


@query("flt12_band_slice", f"SELECT frame, freq_idx, {S('sum(value)')} AS value FROM cube WHERE freq_idx BETWEEN 9 AND 29 GROUP BY ALL", ("cube",))
def flt12(spark, sf):
    out = I.band_slice(T.cube(spark, sf), 1.02e10, 3.04e10, ["frame"])
    return out.groupBy(*KEYS).agg(snap(F.sum("value")).alias("value"))


@query("agg22_nearest_freq", """
SELECT frame, arg_min(freq_idx, abs(freq_hz-33.4e9)*100+freq_idx*1e-3) AS freq_idx, arg_min(freq_hz, abs(freq_hz-33.4e9)*100+freq_idx*1e-3) AS freq_hz FROM cube GROUP BY frame""", ("cube",))
def agg22(spark, sf):
    return I.nearest_frequency(T.cube(spark, sf), 33.4e9, ["frame"], tolerance=None)


_SFU_AREA = C.SFU / (4.0 * C.ARCSEC ** 2)
_TB = C.SPEED_OF_LIGHT ** 2 / (2.0 * C.BOLTZMANN)


@query("grd12_stokes", f"""
SELECT frame, freq_idx, iy, ix, {S(f'value*{D(_SFU_AREA)}*1e9', 6)} AS i_specific_e9, {S(f'value*{D(_SFU_AREA)}*{D(_TB)}/(freq_hz*freq_hz)', 4)} AS i_tb,
 {S(f'value*5e-1*{D(_SFU_AREA)}*1e9', 6)} AS v_specific_e9, {S(f'value*5e-1*{D(_SFU_AREA)}*{D(_TB)}/(freq_hz*freq_hz)', 4)} AS v_tb FROM cube""", ("cube",))
def grd12(spark, sf):
    cube = T.cube(spark, sf).withColumns({"i_flux": F.col("value"), "v_flux": F.col("value") * 0.5})
    out = I.stokes_cube(cube, 4.0)
    return out.select("frame", "freq_idx", "iy", "ix", *[snap(F.col(f"{n}_specific") * 1.0e9).alias(f"{n}_specific_e9") for n in "iv"],
                      *[snap(F.col(f"{n}_tb"), 4).alias(f"{n}_tb") for n in "iv"])


@query("prj12_brightness", f"""
SELECT frame, freq_idx, {S(f'max(value)*{D(_TB)}/(freq_hz*freq_hz)/1e18', 8)} AS tb_e18, {S(f'max(value)*{D(1.0 / _TB)}*(freq_hz*freq_hz)*1e18', 8)} AS intensity_scaled,
 {S(f'max(value)*{D(_SFU_AREA)}*{D(_TB)}/(freq_hz*freq_hz)/1e6', 8)} AS flux_tb_e6, {S(f'max(value)*(freq_hz*freq_hz)/{D(_SFU_AREA * _TB)}*1e9', 8)} AS tb_flux_nano FROM cube GROUP BY frame, freq_idx, freq_hz""", ("cube",))
def prj12(spark, sf):
    top = T.cube(spark, sf).groupBy("frame", "freq_idx", "freq_hz").agg(F.max("value").alias("v"))
    v, f = F.col("v"), F.col("freq_hz")
    return top.select("frame", "freq_idx", snap(Q.intensity_to_tb(v, f) / 1.0e18, 8).alias("tb_e18"),
                      snap(Q.tb_to_intensity(v, f) * 1.0e18, 8).alias("intensity_scaled"), snap(Q.flux_tb(v, f, 4.0) / 1.0e6, 8).alias("flux_tb_e6"),
                      snap(Q.flux_tb(v, f, 4.0, reverse=True) * 1.0e9, 8).alias("tb_flux_nano"))


@query("agg21_plane_stats", f"SELECT frame, freq_idx, min(value) AS min, max(value) AS max, {S('sum(value)')} AS sum, {S('avg(value)', 8)} AS mean FROM cube GROUP BY ALL", ("cube",))
def agg21(spark, sf):
    out = I.plane_stats(T.cube(spark, sf), KEYS)
    return out.withColumns({"sum": snap(F.col("sum")), "mean": snap(F.col("mean"), 8)})


@query("agg23_percentile_limits", f"SELECT frame, freq_idx, {S('quantile_cont(value, 2e-2)', 8)} AS vmin, {S('quantile_cont(value, 995e-3)', 8)} AS vmax FROM cube GROUP BY ALL", ("cube",))
def agg23(spark, sf):
    out = I.color_limits(T.cube(spark, sf), KEYS)
    return out.withColumns({c: snap(F.col(c), 8) for c in ("vmin", "vmax")})


@query("agg23_whole_limits", f"SELECT l_returnflag AS flag, {S('quantile_cont(l_extendedprice, 2e-2)', 4)} AS vmin, {S('quantile_cont(l_extendedprice, 995e-3)', 4)} AS vmax FROM lineitem GROUP BY ALL")
def agg23_whole(spark, sf):
    t = T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("value"))
    return I.color_limits(t, ["flag"], log=True).withColumns({c: snap(F.col(c), 4) for c in ("vmin", "vmax")})


@query("agg23_symmetric_limit", f"SELECT frame, {S('greatest(quantile_cont(abs(value), 995e-3),1e-12)', 8)} AS limit_99 FROM cube GROUP BY ALL", ("cube",))
def agg23_symmetric(spark, sf):
    return I.symmetric_limit(T.cube(spark, sf), ["frame"]).select("frame", snap(F.col("limit"), 8).alias("limit_99"))


@query("agg23_log_limits", f"""
WITH q AS (SELECT frame, quantile_cont(value,1e-2) AS p1, max(value) AS top FROM cube WHERE value>0 GROUP BY frame)
SELECT frame, {S('CASE WHEN greatest(p1,top*1e-5)>=top THEN greatest(top*1e-5,1e-300) ELSE greatest(p1,top*1e-5) END', 8)} AS vmin, top AS vmax FROM q""", ("cube",))
def agg23_log(spark, sf):
    return I.log_limits(T.cube(spark, sf), ["frame"]).withColumn("vmin", snap(F.col("vmin"), 8))


@query("agg23_difference_limit", f"""
WITH t AS (SELECT t.frame, abs((c.value-t.value)/t.value) AS d FROM truth t JOIN candidate c ON c.frame=t.frame AND c.iy=t.iy AND c.ix=t.ix WHERE t.value<>0)
SELECT frame, {S('greatest(quantile_cont(d, 98e-2),1e-6)')} AS limit_98 FROM t GROUP BY frame""", ("truth", "candidate"))
def agg23_difference(spark, sf):
    from fieldframe.operators.compare import match_maps

    pairs = match_maps(T.truth(spark, sf), T.candidate(spark, sf), PIXEL)
    return I.difference_limit(pairs, ["frame"], "truth", "candidate").select("frame", snap(F.col("limit")).alias("limit_98"))


@query("agg24_peak", """
WITH m AS (SELECT frame, iy, ix, max(value) AS peak_flux FROM cube GROUP BY ALL)
SELECT m.frame, m.iy, m.ix, m.peak_flux, min(c.freq_hz) AS peak_freq FROM m JOIN cube c ON c.frame=m.frame AND c.iy=m.iy AND c.ix=m.ix AND c.value=m.peak_flux GROUP BY ALL""", ("cube",))
def agg24(spark, sf):
    return I.peak(T.cube(spark, sf), PIXEL)


_VOLUME = Q.voxel_volume_cm3(2.0, 8.0)


@query("agg25_calibration", f"""
WITH w AS (SELECT frame, max(value) AS top FROM truth GROUP BY frame)
SELECT t.frame, iy, ix, {S(f'(3e7*{D(_VOLUME)}/top)/1e30', 6)} AS per_weight_e30, {S(f'value*(3e7*{D(_VOLUME)}/top)/{D(_VOLUME)}*1e-6', 5)} AS density_e6 FROM truth t JOIN w ON w.frame=t.frame""", ("truth",))
def agg25(spark, sf):
    maps = T.truth(spark, sf)
    scale = I.calibration(maps, ["frame"], _VOLUME, 3.0e7, "value")
    density = Q.weight_to_density(F.col("value"), F.col("per_weight"), 2.0, 8.0)
    return maps.join(scale, "frame").select("frame", "iy", "ix", snap(F.col("per_weight") / 1.0e30).alias("per_weight_e30"),
                                            snap(density * 1.0e-6, 5).alias("density_e6"))


# -- masks -------------------------------------------------------------------------------------------------

_BOX = ((0.1, 0.1), (0.6, 0.55))
_RMS_SQL = "rms AS (SELECT frame, freq_idx, stddev_pop(value)*15e-1 AS rms FROM cube WHERE iy>=2 AND iy<11 AND ix>=2 AND ix<12 GROUP BY ALL)"


def _rms(cube):
    return I.background_rms(cube, KEYS, 20, 20, _BOX, 1.5)


@query("agg19_background_rms", f"WITH {_RMS_SQL} SELECT frame, freq_idx, {S('rms', 8)} AS rms, {S('rms+rms*2e0/(freq_idx+1)', 8)} AS error FROM rms", ("cube",))
def agg19(spark, sf):
    rms = _rms(T.cube(spark, sf))
    error = Q.flux_uncertainty(F.col("rms"), 2.0, (F.col("freq_idx") + 1).cast("double"))
    return rms.select(*KEYS, snap(F.col("rms"), 8).alias("rms"), snap(error, 8).alias("error"))


_EXCESS_SQL = f"{_RMS_SQL}, excess AS (SELECT c.frame, iy, ix, sum(value-rms) AS excess FROM cube c JOIN rms r ON r.frame=c.frame AND r.freq_idx=c.freq_idx GROUP BY ALL)"


@query("agg18_threshold_mask", f"WITH {_EXCESS_SQL} SELECT frame, iy, ix, {S('excess')} AS excess FROM excess WHERE excess>-115e-1", ("cube",))
def agg18(spark, sf):
    cube = T.cube(spark, sf)
    out = I.integrated_excess(cube, _rms(cube), KEYS, PIXEL)
    return out.filter(F.col("excess") > -11.5).withColumn("excess", snap(F.col("excess")))


@query("flt13_selection_mask", f"""WITH {_EXCESS_SQL}
SELECT frame, iy, ix, NOT (ix>=4 AND ix<14 AND iy>=3 AND iy<16) AS fov_masked, NOT (ix>=4 AND ix<14 AND iy>=3 AND iy<16) OR excess+13e0<=1e-1 AS masked FROM excess""", ("cube",))
def flt13(spark, sf):
    cube = T.cube(spark, sf)
    shifted = I.integrated_excess(cube, _rms(cube), KEYS, PIXEL).withColumn("excess", F.col("excess") + 13.0)
    return I.selection_mask(shifted, 0.1, (4, 14), (3, 16)).select(*PIXEL, "fov_masked", "masked")


@query("flt13_mask_box", """SELECT frame, CAST(greatest(min(iy)-2,0) AS INTEGER) AS min_y, CAST(least(max(iy)+2,20) AS INTEGER) AS max_y, CAST(greatest(min(ix)-2,0) AS INTEGER) AS min_x, CAST(least(max(ix)+2,20) AS INTEGER) AS max_x
FROM cube WHERE ix>=1 AND ix<19 AND iy>=3 AND iy<16 GROUP BY frame""", ("cube",))
def flt13_box(spark, sf):
    pixels = T.cube(spark, sf).select(*PIXEL, F.lit(1.0).alias("excess"))
    return I.mask_box(I.selection_mask(pixels, -1.0, (1, 19), (3, 16)), 2, 20, 20, ["frame"])


@query("flt7_fov", f"SELECT frame, freq_idx, {S('sum(value)')} AS value FROM cube WHERE ix>=7 AND ix<15 AND iy>=0 AND iy<12 GROUP BY ALL", ("cube",))
def flt7(spark, sf):
    xs = P.fov_pixels(900.0, 2.5, 1.0, 20, 918.0, 939.0)
    ys = P.fov_pixels(-300.0, 2.5, 1.0, 20, -310.0, -269.0)
    assert (xs, ys) == ((7, 15), (0, 12))
    cube = T.cube(spark, sf).filter(P.in_fov(F.col("ix"), F.col("iy"), xs, ys))
    return cube.groupBy(*KEYS).agg(snap(F.sum("value")).alias("value"))


# -- bands and arrays -------------------------------------------------------------------------------------------

_BANDS_SQL = "bands AS (SELECT label AS frame, CAST(vec_id % 61 AS INTEGER) AS freq_idx, CAST(1e9+3e7*(vec_id % 61)+1e5*((vec_id % 61)*(vec_id % 61)) AS DOUBLE) AS freq_hz FROM embeddings GROUP BY ALL)"


def _bands(spark, sf):
    i = (F.col("vec_id") % 61).cast("int")
    t = T.table(spark, sf, "embeddings")
    return t.select(F.col("label").alias("frame"), i.alias("freq_idx"), (i * 3.0e7 + 1.0e9 + (i * i) * 1.0e5).alias("freq_hz")).distinct()


@query("agg32_band_spacing", f"""WITH {_BANDS_SQL}, s AS (SELECT frame, (freq_hz-lag(freq_hz) OVER w)/(freq_idx-lag(freq_idx) OVER w) AS d FROM bands WINDOW w AS (PARTITION BY frame ORDER BY freq_hz))
SELECT frame, {S('avg(d)', 1)} AS band_step FROM s GROUP BY frame""")
def agg32(spark, sf):
    return I.band_spacing(_bands(spark, sf), ["frame"]).withColumn("band_step", snap(F.col("band_step"), 1))


@query("srt4_order_bands", f"WITH {_BANDS_SQL} SELECT frame, freq_hz, CAST(row_number() OVER (PARTITION BY frame ORDER BY freq_hz)-1 AS INTEGER) AS band FROM bands")
def srt4(spark, sf):
    return I.order_bands(_bands(spark, sf), ["frame"])


@query("set2_frequency_union", f"WITH {_BANDS_SQL} SELECT freq_hz FROM bands UNION SELECT freq_hz FROM cube", ("cube",))
def set2(spark, sf):
    return I.union_frequencies(_bands(spark, sf), T.cube(spark, sf))


@query("set4_stack_images", f"""
WITH img AS (SELECT CAST(label AS INTEGER) AS frame, CAST(1e9*(1+vec_id % 7) AS DOUBLE) AS freq_hz, CAST(vec_id // 7 % 5 AS INTEGER) AS iy, CAST(vec_id // 35 % 4 AS INTEGER) AS ix, max(CAST(list_max(embedding) AS DOUBLE)) AS value FROM embeddings GROUP BY ALL),
r AS (SELECT frame, freq_hz, row_number() OVER (PARTITION BY frame ORDER BY freq_hz)-1 AS band FROM (SELECT DISTINCT frame, freq_hz FROM img))
SELECT f.frame, CAST(b.b AS INTEGER) AS band, CAST(y.y AS INTEGER) AS iy, CAST(x.x AS INTEGER) AS ix, coalesce(i.value,0e0) AS value
FROM (SELECT DISTINCT frame FROM img) f CROSS JOIN (SELECT unnest(range(8)) AS b) b CROSS JOIN (SELECT unnest(range(5)) AS y) y CROSS JOIN (SELECT unnest(range(4)) AS x) x
LEFT JOIN (SELECT img.*, band FROM img JOIN r ON r.frame=img.frame AND r.freq_hz=img.freq_hz) i ON i.frame=f.frame AND i.band=b.b AND i.iy=y.y AND i.ix=x.x""")
def set4(spark, sf):
    t = T.table(spark, sf, "embeddings")
    v = F.col("vec_id")
    images = t.select(F.col("label").alias("frame"), ((v % 7 + 1) * 1.0e9).alias("freq_hz"), ((v / 7).cast("long") % 5).cast("int").alias("iy"),
                      ((v / 35).cast("long") % 4).cast("int").alias("ix"), F.array_max("embedding").cast("double").alias("value"))
    return I.stack_images(images, ["frame"], 8, 5, 4)


@query("src17_frequency_axis", f"""WITH {_BANDS_SQL}, h AS (SELECT DISTINCT label AS frame FROM embeddings)
SELECT h.frame, CAST(k AS INTEGER) AS freq_idx, coalesce(b.freq_hz, (9e8+h.frame*1e6)+5e7*k) AS freq_hz FROM h CROSS JOIN (SELECT unnest(range(70)) AS k) LEFT JOIN bands b ON b.frame=h.frame AND b.freq_idx=k""")
def src17(spark, sf):
    header = T.table(spark, sf, "embeddings").select(F.col("label").alias("frame")).distinct().withColumns(
        {"crval": F.col("frame") * 1.0e6 + 9.0e8, "cdelt": F.lit(5.0e7)})
    return I.frequency_axis(header, _bands(spark, sf).withColumnRenamed("freq_hz", "freq"), ["frame"], 70)


@query("arr1_spectra", "SELECT frame, iy, ix, list(value ORDER BY freq_idx) AS spectrum FROM (SELECT frame, iy, ix, freq_idx, avg(value) AS value FROM cube GROUP BY ALL) GROUP BY ALL", ("cube",))
def arr1(spark, sf):
    return I.to_spectra(T.cube(spark, sf), PIXEL)


@query("arr1_rows", "SELECT label, vec_id, CAST(k // 16 AS INTEGER) AS freq_idx, CAST(k // 4 % 4 AS INTEGER) AS iy, CAST(k % 4 AS INTEGER) AS ix, embedding[k+1] AS value FROM (SELECT *, unnest(range(len(embedding))) AS k FROM embeddings)")
def arr1_rows(spark, sf):
    t = T.table(spark, sf, "embeddings")
    planes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda y: F.slice("embedding", p * 16 + y * 4 + 1, F.lit(4))))
    return I.to_rows(t.select("label", "vec_id", planes.alias("cube")), ["label", "vec_id"], "cube")


@query("arr2_array_algebra", f"""
SELECT vec_id, {S('list_sum(list_transform(range(1,65), lambda k: CAST(embedding[k] AS DOUBLE)*25e-1-CAST(embedding[65-k] AS DOUBLE)))', 6)} AS total, 64 AS zeros FROM embeddings""")
def arr2(spark, sf):
    e = F.transform("embedding", lambda v: v.cast("double"))
    diff = M.array_subtract(M.array_scale(e, 2.5), F.reverse(e))
    total = F.aggregate(diff, F.lit(0.0), lambda a, v: a + v)
    return T.table(spark, sf, "embeddings").select("vec_id", snap(total).alias("total"), F.size(M.array_zero(F.col("embedding"))).alias("zeros"))


def _fit_maps(spark, sf, t):
    e = F.transform("embedding", lambda v: v.cast("double"))
    v = F.col("vec_id")
    fits = t.select((v / 400).cast("int").alias("frame"), ((v % 400) / 20).cast("int").alias("iy"), (v % 20).cast("int").alias("ix"),
                    F.slice(e, 1, 8).alias("params"), F.slice(e, 9, 8).alias("errors"))
    return I.parameter_maps(fits, T.cube(spark, sf).select(*PIXEL).distinct(), PIXEL, ["n_nth", "b"])


_ALL_FITS = """
WITH px AS (SELECT DISTINCT frame, iy, ix FROM cube), f AS (SELECT CAST(vec_id // 400 AS INTEGER) AS frame, CAST((vec_id % 400) // 20 AS INTEGER) AS iy, CAST(vec_id % 20 AS INTEGER) AS ix, embedding FROM embeddings)
SELECT px.frame, px.iy, px.ix, coalesce(CAST(embedding[1] AS DOUBLE),0e0) AS n_nth, coalesce(CAST(embedding[9] AS DOUBLE),0e0) AS err_n_nth, coalesce(CAST(embedding[2] AS DOUBLE),0e0) AS b, coalesce(CAST(embedding[10] AS DOUBLE),0e0) AS err_b
FROM px LEFT JOIN f ON f.frame=px.frame AND f.iy=px.iy AND f.ix=px.ix"""


@query("jon14_parameter_maps", _ALL_FITS, ("cube",))
@query("jon14_all_fits", _ALL_FITS, ("cube",))
def jon14_all(spark, sf):
    """Maps of every fit; a pixel is 0 only where there is none."""
    return _fit_maps(spark, sf, T.table(spark, sf, "embeddings"))


_FITVOL = 2.0 * 3.0 * C.FIT_ARCSEC_CM ** 3
_FITSCALE = _FITVOL * C.FIT_KEV_ERG * 0.01 * 1.0e3


@query("prj42_fit_energies", f"""
WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS n, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[5] AS DOUBLE)*1e1 AS d, CAST(embedding[9] AS DOUBLE) AS en, CAST(embedding[10] AS DOUBLE) AS eb, CAST(embedding[13] AS DOUBLE) AS ed FROM embeddings)
SELECT vec_id, {S(f'b*b*{D(_FITVOL / (8 * math.pi))}/1e24', 6)} AS wb, {S(f'b*eb*{D(2 * _FITVOL / (8 * math.pi))}/1e24', 6)} AS wb_err, {S(f'(d-1e0)/(d-2e0)*n*{D(_FITSCALE)}/1e17', 5)} AS wnth,
 {S(f'sqrt(ed*ed*en*en/((d-2e0)*(d-2e0)*(d-2e0)*(d-2e0))+((d-1e0)/(d-2e0)*en)*((d-1e0)/(d-2e0)*en))*{D(_FITSCALE)}/1e17', 5)} AS wnth_err FROM e""")
def prj42(spark, sf):
    e = F.transform("embedding", lambda v: v.cast("double"))
    t = T.table(spark, sf, "embeddings").select("vec_id", F.slice(e, 1, 8).alias("p"), F.slice(e, 9, 8).alias("q"))
    scaled = t.withColumn("p", F.transform("p", lambda v, i: F.when(i == 4, v * 10.0).otherwise(v)))
    out = Q.fit_energies(F.col("p"), F.col("q"), 2.0, 3.0, 0.01)
    return scaled.select("vec_id", snap(out["wb"] / 1.0e24).alias("wb"), snap(out["wb_err"] / 1.0e24).alias("wb_err"),
                         snap(out["wnth"] / 1.0e17, 5).alias("wnth"), snap(out["wnth_err"] / 1.0e17, 5).alias("wnth_err"))


# -- scalar functions on events -----------------------------------------------------------------------------------

@query("prj17_quantize", "SELECT event_id, CAST(round_even(greatest(least(value/1e2,1e0),0e0)*8e0, 0) AS INTEGER) AS level FROM events")
def prj17(spark, sf):
    return T.table(spark, sf, "events").select("event_id", N.quantize(F.col("value") / 100.0, 9).alias("level"))


@query("prj16_rescale", f"""
WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)
SELECT event_id, {S('5e1+(value-lo)/greatest(hi-lo,1e-12)*35e1')} AS gauss FROM events e JOIN m ON m.event_type=e.event_type""")
def prj16(spark, sf):
    e = T.table(spark, sf, "events")
    ends = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(ends, "event_type").select("event_id", snap(N.rescale(F.col("value"), F.col("lo"), F.col("hi"), 50.0, 400.0)).alias("gauss"))


@query("prj20_ratios", f"""
WITH e AS (SELECT event_id, value AS a, CAST(user_id % 5 AS DOUBLE) AS b FROM events)
SELECT event_id, CASE WHEN b<>0 THEN {S('a/nullif(b,0)', 7)} ELSE -1e0 END AS ratio, CASE WHEN b<>0 THEN {S('(a-b)/nullif(b,0)', 7)} ELSE -1e0 END AS difference FROM e""")
def prj20(spark, sf):
    a, b = F.col("value"), (F.col("user_id") % 5).cast("double")
    ratio, diff = N.safe_ratio(a, b), N.fractional_difference(b, a)
    return T.table(spark, sf, "events").select("event_id", F.when(F.isnan(ratio), -1.0).otherwise(snap(ratio, 7)).alias("ratio"),
                                               F.when(F.isnan(diff), -1.0).otherwise(snap(diff, 7)).alias("difference"))


@query("prj22_polarization", f"""
WITH e AS (SELECT event_id, value AS l, value*CAST(user_id % 3 AS DOUBLE)-CASE WHEN user_id % 7=0 THEN value ELSE 0e0 END AS r FROM events)
SELECT event_id, {S('l+r')} AS total, {S('r-l')} AS circular, {S('CASE WHEN abs(l+r)>0 THEN (r-l)/nullif(l+r,0) ELSE 0e0 END', 8)} AS degree FROM e""")
def prj22(spark, sf):
    left = F.col("value")
    right = left * (F.col("user_id") % 3).cast("double") - F.when(F.col("user_id") % 7 == 0, left).otherwise(0.0)
    out = Q.polarization(left, right)
    return T.table(spark, sf, "events").select("event_id", snap(out["total"]).alias("total"), snap(out["circular"]).alias("circular"), snap(out["degree"], 8).alias("degree"))


@query("prj39_nan_fill", f"SELECT event_type, {S('sum(CASE WHEN user_id % 4=0 THEN 0e0 ELSE value END)', 5)} AS total, count(*) AS n FROM events GROUP BY event_type")
def prj39(spark, sf):
    holed = F.when(F.col("user_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return T.table(spark, sf, "events").groupBy("event_type").agg(snap(F.sum(N.nan_fill(holed)), 5).alias("total"), F.count(F.lit(1)).alias("n"))


@query("prj37_wcs_extent", f"""
WITH h AS (SELECT p_partkey, p_retailprice AS v, p_size/1e1 AS d FROM part)
SELECT p_partkey, {S('v-(5-1)*d')} AS x_left, {S('v-(5-1)*d+20*d')} AS x_right, {S('-v-(3-1)*2*d')} AS y_bottom, {S('-v-(3-1)*2*d+10*2*d')} AS y_top, {S('(v*1e7)/1e9-(d*1e8)/1e9/2e0', 7)} AS band_lo, {S('(v*1e7)/1e9+(d*1e8)/1e9/2e0', 7)} AS band_hi FROM h""")
def prj37(spark, sf):
    v, d = F.col("p_retailprice"), F.col("p_size") / 10.0
    lit = F.lit
    extent = Q.wcs_extent(v, d, lit(5), lit(20), -v, d * 2, lit(3), lit(10))
    bands = Q.band_bounds(v * 1.0e7, d * 1.0e8)
    return T.table(spark, sf, "part").select("p_partkey", *[snap(c).alias(n) for n, c in extent.items()],
                                             snap(bands["lo_ghz"], 7).alias("band_lo"), snap(bands["hi_ghz"], 7).alias("band_hi"))


@query("prj45_power_law_bins", f"""
WITH e AS (SELECT p_partkey, k, p_size/1e1 AS d, power(2e0,k) AS lo, power(2e0,k+1) AS hi FROM part CROSS JOIN (SELECT unnest(range(6)) AS k)),
w AS (SELECT p_partkey, k, CASE WHEN abs(d-1e0)<=1.001e-5 THEN ln(hi/lo) ELSE abs((power(hi,1e0-d)-power(lo,1e0-d))/nullif(1e0-d,0)) END AS w FROM e),
t AS (SELECT p_partkey, sum(w) AS total FROM w GROUP BY p_partkey)
SELECT w.p_partkey, CAST(k AS INTEGER) AS k, {S('w/total', 8)} AS probability FROM w JOIN t ON t.p_partkey=w.p_partkey""")
def prj45(spark, sf):
    parts = T.table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("d"))
    bins = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: Q.power_law_weight(F.pow(F.lit(2.0), k), F.pow(F.lit(2.0), k + 1), F.col("d")))
    weighted = parts.withColumn("w", bins).withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, v: a + v))
    rows = weighted.select("p_partkey", "total", F.posexplode("w").alias("k", "v"))
    return rows.select("p_partkey", "k", snap(F.col("v") / F.col("total"), 8).alias("probability"))
