"""Domain tables derived from the given tables: one DataFrame and one SQL text each.

lineitem plays the particles, events the gridded field and an event-numbered particle
set, embeddings the image cube, orders the run timing, part the product catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VIEWS["particles"] = """
SELECT CAST((year(l_shipdate)-1995)*12+month(l_shipdate) AS INTEGER) AS frame,
 l_orderkey*8+l_linenumber AS particle_id,
 CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS status,
 CAST(l_linenumber % 4 AS INTEGER) AS split_level,
 l_extendedprice/1e4 AS p, l_extendedprice AS x, l_quantity AS y,
 2e0*l_tax/8e-2-1e0 AS mu, floor(l_discount*1e2+5e-1) AS weight, l_tax AS dt,
 CAST(l_suppkey % 4 AS INTEGER) AS species,
 (sqrt(1e0+(l_extendedprice/1e4)*(l_extendedprice/1e4))-1e0)*1e5 AS energy_ev
FROM lineitem"""


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    p = F.col("l_extendedprice") / 1.0e4
    flag = F.col("l_returnflag")
    return t.select(
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("int").alias("frame"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("particle_id"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("status"),
        (F.col("l_linenumber") % 4).cast("int").alias("split_level"),
        p.alias("p"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"),
        (F.lit(2.0) * F.col("l_tax") / 8.0e-2 - 1.0).alias("mu"),
        F.floor(F.col("l_discount") * 100.0 + 0.5).cast("double").alias("weight"),
        F.col("l_tax").alias("dt"), (F.col("l_suppkey") % 4).cast("int").alias("species"),
        ((F.sqrt(F.lit(1.0) + p * p) - 1.0) * 1.0e5).alias("energy_ev"))


# Field on 30 days (a periodic axis, the 31st comes round to the first) x 24 hours x frames of user_id % 4; cell values are exact cent sums over counts.
GRID_NX, GRID_NY = 30, 24


def _mean_sql(kind: str) -> str:
    return (f"coalesce(CAST(sum(CASE WHEN event_type='{kind}' THEN CAST(floor(value*1e2+5e-1) AS BIGINT) END) AS DOUBLE)/1e2"
            f"/nullif(count(CASE WHEN event_type='{kind}' THEN 1 END),0),0e0)")


_COMPONENTS = {"bx": "click", "by": "view", "bz": "purchase", "vx": "signup", "vy": "error"}

VIEWS["grid"] = f"""
SELECT CAST(f.frame AS INTEGER) AS frame, CAST(gx.ix AS INTEGER) AS ix, CAST(gy.iy AS INTEGER) AS iy,
 {', '.join(f'coalesce(c.{n},0e0) AS {n}' for n in [*_COMPONENTS, 'vz'])}
FROM (SELECT DISTINCT user_id % 4 AS frame FROM events) f
CROSS JOIN (SELECT unnest(range(30)) AS ix) gx CROSS JOIN (SELECT unnest(range(24)) AS iy) gy
LEFT JOIN (SELECT user_id % 4 AS frame, (day(ts)-1) % 30 AS ix, hour(ts) AS iy,
 {', '.join(f'{_mean_sql(k)} AS {n}' for n, k in _COMPONENTS.items())}, CAST(count(*) AS DOUBLE) AS vz
 FROM events GROUP BY ALL) c ON c.frame=f.frame AND c.ix=gx.ix AND c.iy=gy.iy"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldframe.operators.binning import densify

    t = table(spark, sf_dir, "events")
    cents = F.floor(F.col("value") * 100.0 + 0.5)
    cells = t.select((F.col("user_id") % 4).cast("int").alias("frame"),
                     ((F.dayofmonth("ts") - 1) % GRID_NX).alias("ix"), F.hour("ts").alias("iy"),
                     "event_type", cents.alias("cents"))
    aggregates = []
    for name, kind in _COMPONENTS.items():
        here = F.col("event_type") == kind
        n = F.count(F.when(here, 1))
        total = F.sum(F.when(here, F.col("cents"))).cast("double") / 100.0
        aggregates.append(F.coalesce(total / F.when(n > 0, n), F.lit(0.0)).alias(name))
    summed = cells.groupBy("frame", "ix", "iy").agg(
        *aggregates, F.count(F.lit(1)).cast("double").alias("vz"))
    fills = {n: 0.0 for n in [*_COMPONENTS, "vz"]}
    return densify(summed, cells, ["frame"], {"ix": GRID_NX, "iy": GRID_NY}, fills)


VIEWS["event_particles"] = """
SELECT event_id AS particle_id, CAST(day(ts) AS INTEGER) AS frame, CAST(CASE WHEN event_type='error' THEN 1
 WHEN event_type='signup' THEN 2 ELSE 0 END AS INTEGER) AS status, user_id,
 value/1e1 AS p, value AS energy, CAST(user_id % 3 AS INTEGER) AS split_level,
 CAST(1+user_id % 5 AS DOUBLE) AS weight, CASE WHEN user_id % 11 = 0 THEN 0e0 ELSE CAST(5+user_id % 7 AS DOUBLE) END
 AS initial_kinetic_energy, CAST(hour(ts) AS DOUBLE)+minute(ts)/6e1 AS y, value AS x
FROM events"""


def event_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    kind, user = F.col("event_type"), F.col("user_id")
    return t.select(
        F.col("event_id").alias("particle_id"), F.dayofmonth("ts").alias("frame"),
        F.when(kind == "error", 1).when(kind == "signup", 2).otherwise(0).alias("status"), "user_id",
        (F.col("value") / 10.0).alias("p"), F.col("value").alias("energy"),
        (user % 3).cast("int").alias("split_level"), (user % 5 + 1).cast("double").alias("weight"),
        F.when(user % 11 == 0, 0.0).otherwise((user % 7 + 5).cast("double")).alias("initial_kinetic_energy"),
        (F.hour("ts").cast("double") + F.minute("ts") / 60.0).alias("y"), F.col("value").alias("x"))


# Cube: the array position is the band, 20 pixels per row; a "map" is 20 x 20 pixels.
CUBE_NX = 20

VIEWS["cube"] = """
SELECT CAST(vec_id // 400 AS INTEGER) AS frame, CAST(k-1 AS INTEGER) AS freq_idx, CAST(1e9*k AS DOUBLE) AS freq_hz,
 CAST((vec_id % 400) // 20 AS INTEGER) AS iy, CAST(vec_id % 20 AS INTEGER) AS ix, CAST(embedding[k] AS DOUBLE) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding)+1)) AS k FROM embeddings)"""


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    rows = t.select("vec_id", F.posexplode("embedding").alias("freq_idx", "v"))
    return rows.select(
        (F.col("vec_id") / 400).cast("int").alias("frame"), "freq_idx",
        ((F.col("freq_idx") + 1) * 1.0e9).alias("freq_hz"),
        ((F.col("vec_id") % 400) / 20).cast("int").alias("iy"),
        (F.col("vec_id") % 20).cast("int").alias("ix"), F.col("v").cast("double").alias("value"))


VIEWS["timing"] = """
SELECT o_orderpriority AS "case", CAST((year(o_orderdate)-1995)*12+month(o_orderdate) AS INTEGER) AS frame,
 CAST(count(*) AS DOUBLE) AS particle_count,
 CAST(sum(CAST(floor(o_totalprice*1e2+5e-1) AS BIGINT)) AS DOUBLE)/1e8 AS frame_seconds
FROM orders GROUP BY ALL"""


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.groupBy(
        F.col("o_orderpriority").alias("case"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("int").alias("frame")).agg(
        F.count(F.lit(1)).cast("double").alias("particle_count"),
        (F.sum(F.floor(F.col("o_totalprice") * 100.0 + 0.5)).cast("double") / 1.0e8).alias("frame_seconds"))


# Truth and candidate maps: order and line values per (frame, customer or supplier cell).
VIEWS["truth"] = """
SELECT CAST(month(o_orderdate) AS INTEGER) AS frame, CAST(o_custkey % 16 AS INTEGER) AS ix, CAST((o_custkey // 16) % 12 AS INTEGER) AS iy,
 CAST(sum(CAST(floor(o_totalprice*1e2+5e-1) AS BIGINT)) AS DOUBLE)/1e8 AS value FROM orders GROUP BY ALL"""
VIEWS["candidate"] = """
SELECT CAST(month(l_shipdate) AS INTEGER) AS frame, CAST(l_partkey % 16 AS INTEGER) AS ix, CAST((l_partkey // 16) % 12 AS INTEGER) AS iy,
 CAST(sum(CAST(floor(l_extendedprice*1e2+5e-1) AS BIGINT)) AS DOUBLE)/1e8 AS value FROM lineitem GROUP BY ALL"""


def _cell_sum(df: DataFrame, date: str, key: str, amount: str) -> DataFrame:
    return df.groupBy(F.month(date).alias("frame"), (F.col(key) % 16).cast("int").alias("ix"),
                      ((F.col(key) / 16).cast("long") % 12).cast("int").alias("iy")).agg(
        (F.sum(F.floor(F.col(amount) * 100.0 + 0.5)).cast("double") / 1.0e8).alias("value"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_sum(table(spark, sf_dir, "orders"), "o_orderdate", "o_custkey", "o_totalprice")


def candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cell_sum(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_partkey", "l_extendedprice")


# Product catalog from part: 48 paths per product, some of them under an older name.
_PREFIXES = ("truth", "reconstruction", "image/full", "image/beam", "references/thermal_only", "diagnostics/razin_impact")
_LEAVES = ("I_flux_sfu", "V_flux_sfu", "I_specific", "V_specific", "linear_flux_sfu", "nonthermal_density_cm3",
           "freq_hz", "power_law_index")


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


VIEWS["catalog"] = f"""
SELECT p_partkey // 48 AS product, {_list(_PREFIXES)}[CAST(p_partkey % 48 // 8 + 1 AS INTEGER)] || '/' ||
 {_list(_LEAVES)}[CAST(p_partkey % 8 + 1 AS INTEGER)] || CASE WHEN p_size % 7 = 0 THEN '_old' ELSE '' END AS path, p_retailprice - 900e0 AS value,
 CASE p_partkey % 8 WHEN 5 THEN [p_size, p_size+1] WHEN 6 THEN [p_size % 3 + 1] WHEN 7 THEN CASE WHEN p_size % 2 = 0 THEN [1] ELSE [] END
  ELSE CASE WHEN p_size % 2 = 0 THEN [18, p_size, p_size] ELSE [18] END END AS shape,
 p_size % 5 <> 0 AS positive, p_size % 13 = 0 AS is_text
FROM part"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    prefix = F.get(F.array(*[F.lit(v) for v in _PREFIXES]), ((key % 48) / 8).cast("int"))
    name = F.get(F.array(*[F.lit(v) for v in _LEAVES]), (key % 8).cast("int"))
    even = size % 2 == 0
    none = F.array().cast("array<int>")
    shape = (F.when(key % 8 == 5, F.array(size, size + 1)).when(key % 8 == 6, F.array(size % 3 + 1))
             .when(key % 8 == 7, F.when(even, F.array(F.lit(1))).otherwise(none))
             .otherwise(F.when(even, F.array(F.lit(18), size, size)).otherwise(F.array(F.lit(18)))))
    return t.select((key / 48).cast("long").alias("product"), F.concat(prefix, F.lit("/"), name, F.when(size % 7 == 0, "_old").otherwise("")).alias("path"),
                    (F.col("p_retailprice") - 900.0).alias("value"), shape.alias("shape"),
                    (size % 5 != 0).alias("positive"), (size % 13 == 0).alias("is_text"))
