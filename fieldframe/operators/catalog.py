"""Product catalogs: paths, kinds, units, pairs and nested metrics (PRJ23, PRJ34, PRJ36, JON11, JSN1)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions.numeric import safe_ratio

#: Columns that a wide table may have at most.
MOST_SERIES = 10_000


def infer_unit(path: Column) -> Column:
    """Unit of a dataset path: the first token of the table found in it (PRJ34)."""
    lower = F.lower(path)
    unit = None
    for token, label in C.UNIT_TOKENS:
        hit = lower.contains(token)
        unit = F.when(hit, F.lit(label)) if unit is None else unit.when(hit, F.lit(label))
    return unit.otherwise(F.lit(""))


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_component_path(path: Column) -> Column:
    """References, diagnostics and components (FLT11)."""
    lower = F.lower(path)
    condition = F.lit(False)
    for token in C.COMPONENT_TOKENS:
        condition = condition | lower.contains(token)
    return condition


def looks_like_frequency(path: Column, shape: Column, positive: Column) -> Column:
    """A vector of more than one positive finite value whose path mentions a frequency."""
    return (F.lower(path).contains("freq") & (F.size(shape) == 1)
            & (F.get(shape, F.lit(0)) > 1) & positive)


def dataset_kind(path: Column, is_text: Column, shape: Column, positive: Column, bands: Column) -> Column:
    """Kind from rank and length; the order of the tests matters (PRJ36)."""
    rank, length = F.size(shape), F.get(shape, F.lit(0))
    return (F.when(is_text, "text")
            .when(looks_like_frequency(path, shape, positive), "vector")
            .when((rank == 3) & (length == bands), "cube")
            .when(rank == 2, "map")
            .when((rank == 1) & (length == bands), "spectrum")
            .when(rank == 0, "scalar")
            .when((rank == 1) & (length == 1), "scalar")
            .otherwise("vector"))


def frequency_path(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Primary frequency axis: a path ending in freq_hz, else the first that mentions one (SRC18)."""
    usable = catalog.filter(looks_like_frequency(F.col("path"), F.col("shape"), F.col("positive")))
    rank = F.struct((~F.col("path").endswith("freq_hz")).alias("a"), F.col("path").alias("b"))
    return usable.groupBy(*keys).agg(F.min(rank)["b"].alias("frequency_path"))


def same_leaf(catalog: DataFrame, selected: DataFrame, keys: list[str], components_only: bool = False) -> DataFrame:
    """Paths that share the leaf of the selected path, the path itself excluded (FLT11).

    ``selected`` holds one path per key.
    """
    chosen = selected.select(*keys, F.col("path").alias("selected"), leaf(F.col("path")).alias("_leaf"))
    candidates = catalog.select(*keys, "path").withColumn("_leaf", leaf(F.col("path")))
    if components_only:
        candidates = candidates.filter(is_component_path(F.col("path")))
    return (candidates.join(chosen, [*keys, "_leaf"]).filter(F.col("path") != F.col("selected"))
            .select(*keys, "selected", "path"))


def comparison_pairs(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """The dataset to compare each path with (JON11).

    truth and reconstruction, and image/full and image/beam, point at each other; otherwise
    the first other path (in path order) with the same leaf. The fallback needs only the two
    lowest paths per leaf, so no pairs inside a leaf are formed.
    """
    p = F.col("path")
    swapped = (F.when(p.startswith("reconstruction/"), F.regexp_replace(p, "^reconstruction/", "truth/"))
               .when(p.startswith("truth/"), F.regexp_replace(p, "^truth/", "reconstruction/"))
               .when(p.startswith("image/full/"), F.regexp_replace(p, "^image/full/", "image/beam/"))
               .when(p.startswith("image/beam/"), F.regexp_replace(p, "^image/beam/", "image/full/")))
    paths = catalog.select(*keys, "path").distinct()
    wanted = paths.withColumns({"_swap": swapped, "_leaf": leaf(p)})
    known = paths.select(*keys, F.col("path").alias("_swap")).withColumn("_direct", F.col("_swap"))
    nested = paths.filter(p.contains("/")).withColumn("_leaf", leaf(p))
    lowest = nested.groupBy(*keys, "_leaf").agg(F.min("path").alias("_first"))
    second = (nested.join(lowest, [*keys, "_leaf"]).filter(p != F.col("_first"))
              .groupBy(*keys, "_leaf").agg(F.min("path").alias("_second")))
    out = (wanted.join(known, [*keys, "_swap"], "left").join(lowest, [*keys, "_leaf"], "left")
           .join(second, [*keys, "_leaf"], "left"))
    fallback = F.when(F.col("_first") != p, F.col("_first")).otherwise(F.col("_second"))
    return out.select(*keys, "path", F.coalesce("_direct", fallback).alias("comparison"))


def polarization_entries(cubes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Degrees of polarization for every matching pair of paths (PRJ23).

    ``cubes`` has path, keys (product, frequency, pixel) and a value. Each row states which
    pair it belongs to and on which side, and the sides join on (keys, base, pair).
    """
    p = F.col("path")

    def tagged(position: int) -> DataFrame:
        options = [F.when(p.endswith(pair[position]), F.struct(
            F.lit(k).alias("pair"), F.expr(f"left(path, length(path) - {len(pair[position])})").alias("base"),
            F.lit(pair[2]).alias("name"))) for k, pair in enumerate(C.POLARIZATION_PAIRS)]
        hits = F.explode(F.array_compact(F.array(*options)))
        return cubes.select(*keys, hits.alias("_h"), F.col(value)).select(
            *keys, F.col("_h.pair").alias("_pair"), F.col("_h.base").alias("_base"),
            F.col("_h.name").alias("_name"), F.col(value).alias(f"_v{position}"))

    intensity, polarized = tagged(0), tagged(1).drop("_name")
    joined = intensity.join(polarized, [*keys, "_pair", "_base"])
    # a later pair with the same derived path replaces an earlier one
    ratio = safe_ratio(F.col("_v1"), F.col("_v0"))
    best = F.max(F.struct(F.col("_pair"), ratio.alias("r")))["r"]
    return joined.groupBy(*keys, F.concat("_base", "_name").alias("path")).agg(best.alias(value))


def _object_levels(schema: str) -> int:
    """How deep objects are nested in a variant schema, at most; arrays count as levels too."""
    level = deepest = 0
    for mark in re.findall(r"OBJECT<|ARRAY<|<|>", schema):
        level += -1 if mark == ">" else 1
        deepest = max(deepest, level)
    return deepest


def flatten_json(df: DataFrame, keys: list[str], column: str, depth: int | None = None,
                 name: str = "metric") -> DataFrame:
    """Leaves of a JSON object as (keys, path, value), keys joined by '/' (JSN1, JSN2).

    All levels are opened: their number is found first, by one aggregate over the documents,
    unless ``depth`` names how many levels to open (anything deeper then stays a JSON text).
    Keys may be empty or contain dots. Only objects are opened: arrays and texts are leaves,
    empty objects have none. Every level opens in place.
    """
    spark = df.sparkSession
    if depth is None:
        depth = _object_levels(df.agg(F.schema_of_variant_agg(F.parse_json(column))).first()[0] or "")
    rows = df.select(*keys, F.lit(None).cast("string").alias("_path"), F.parse_json(column).alias("_v"))
    for _ in range(depth):
        staged = rows.withColumn("_object", F.schema_of_variant("_v").startswith("OBJECT"))
        children = spark.tvf.variant_explode_outer(F.when(F.col("_object").outer(), F.col("_v").outer()))
        opened = staged.lateralJoin(children.select(F.col("key").alias("_key"), F.col("value").alias("_child")))
        named = opened.filter(F.col("_key").isNotNull() | ~F.coalesce("_object", F.lit(False)))
        rows = named.select(*keys, F.when(F.col("_path").isNull(), F.col("_key")).otherwise(F.concat_ws("/", "_path", "_key")).alias("_path"),
                            F.when(F.col("_key").isNotNull(), F.col("_child")).otherwise(F.col("_v")).alias("_v"))
    text = F.when(~F.is_variant_null("_v"), F.coalesce(F.try_variant_get("_v", "$", "string"), F.to_json("_v")))
    return rows.filter(F.col("_path").isNotNull()).select(*keys, F.col("_path").alias(name), text.alias("value"))


def product_listing(df: DataFrame, suffixes: tuple[str, ...] = (".h5", ".hdf5"), include: tuple[str, ...] = (),
                    exclude: str | None = None, path: str = "path") -> DataFrame:
    """Distinct product paths by suffix and keywords (SRC16)."""
    p = F.col(path)
    condition = F.lit(False) if suffixes else F.lit(True)
    for s in suffixes:
        condition = condition | F.lower(p).endswith(s)
    for word in include:
        condition = condition & p.contains(word)
    if exclude:
        condition = condition & ~p.contains(exclude)
    return df.filter(condition).select(path).distinct()


def wide_spectrum(rows: DataFrame, freq: str, series: str, value: str, names: list[str] | None = None) -> DataFrame:
    """One column per series, in the given order or else by name (SNK7).

    The series that occur are found now. One that ``names`` leaves out, or without a name, is an error, and so are more than
    ``MOST_SERIES``, as that many columns are no table.
    """
    found = {r[0] for r in rows.select(series).distinct().limit(MOST_SERIES + 1).collect()}
    if len(found) > MOST_SERIES:
        raise ValueError(f"more than {MOST_SERIES} series in {series}")
    if None in found:
        raise ValueError(f"a series of {series} has no name")
    names = sorted(found) if names is None else names
    if found - set(names):
        raise ValueError(f"no column for the series {sorted(found - set(names))[:20]}")
    return rows.groupBy(freq).pivot(series, names).agg(F.first(value)).orderBy(freq)