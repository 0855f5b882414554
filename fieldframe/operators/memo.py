"""Evaluate a model once per distinct parameter key, and what surrounds it (JON10, JON12, JON13)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions.numeric import finite, quantize, safe_ratio


def evaluate_once(cells: DataFrame, keys: list[str], params: list[str], order: list[Column],
                  model: Callable[[DataFrame], DataFrame], outputs: list[str],
                  groups: tuple[str, ...] = ()) -> DataFrame:
    """Run ``model`` on one representative per key and join the outputs back (JON13, WIN6).

    The representative of a key is its first cell in ``order``; it is found with a partial
    min, so a key shared by many cells costs one row per task. The join back is on the key:
    the evaluated side is as small as the number of distinct keys, and AQE decides from its
    measured size whether to broadcast it.
    """
    all_keys = [*groups, *keys]
    first = F.min(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)],
                           *[F.col(p) for p in params])).alias("_r")
    representatives = cells.groupBy(*all_keys).agg(first).select(
        *all_keys, *[F.col(f"_r.{p}").alias(p) for p in params])
    evaluated = model(representatives).select(*all_keys, *outputs)
    return cells.join(evaluated, all_keys)


def quantize_keys(cells: DataFrame, levels: dict[str, tuple[Column, int]]) -> DataFrame:
    """Add integer key columns from normalized values (PRJ17)."""
    return cells.withColumns({name: quantize(value, n) for name, (value, n) in levels.items()})


def rounded_keys(cells: DataFrame, columns: dict[str, str], digits: int = 3) -> DataFrame:
    """Keys by rounding half to even to a number of decimals (JON13 variant)."""
    return cells.withColumns({k: F.bround(c, digits) for k, c in columns.items()})


def normalized(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("frame",),
               of_peak: dict[str, Column] | None = None) -> DataFrame:
    """Normalized copies ``<c>_norm`` per key (PRJ16, WIN8).

    ``columns`` are mapped from their range onto [0, 1], ranges under 1e-12 counting as 1e-12.
    ``of_peak`` maps a column to the rows that count: there the value is divided by its
    maximum over those rows, elsewhere it is 0. One aggregate serves all columns and is
    joined back on the key, so a large frame is never one window.
    """
    peaks = of_peak or {}
    ends = df.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns],
        *[F.max(F.when(where, F.col(c))).alias(f"_top_{c}") for c, where in peaks.items()])
    norms = {f"{c}_norm": (F.col(c) - F.col(f"_lo_{c}"))
             / F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(1.0e-12)) for c in columns}
    norms |= {f"{c}_norm": F.when(where & (F.col(f"_top_{c}") > 0.0), F.col(c) / F.col(f"_top_{c}")).otherwise(0.0)
              for c, where in peaks.items()}
    helpers = [c for c in ends.columns if c not in keys]
    return df.join(ends, list(keys)).withColumns(norms).drop(*helpers)


def assemble_cells(keys: list[str], *maps: DataFrame) -> DataFrame:
    """Join density, field, index and background maps on the cell key (JON10).

    All maps must be dense; every join uses the same keys, so one exchange per map suffices.
    """
    out = maps[0]
    for other in maps[1:]:
        out = out.join(other, keys)
    return out


def reference_variants(params: DataFrame) -> DataFrame:
    """Each parameter row as the full model and three reference variants (UDF3).

    Needs nonthermal_density_1e7, thermal_density_1e9 and los_depth_arcsec; adds
    ``variant`` and ``rescale``, the factor to apply to the evaluated flux.
    """
    depth = F.col("los_depth_arcsec")
    thin = F.greatest(depth * C.THIN_DEPTH_FRACTION, F.lit(C.THIN_DEPTH_MINIMUM_ARCSEC))
    n, t = F.col("nonthermal_density_1e7"), F.col("thermal_density_1e9")

    def variant(name, nonthermal, thermal, los, factor):
        return F.struct(F.lit(name).alias("variant"), nonthermal.alias("n"), thermal.alias("t"),
                        los.alias("l"), factor.alias("f"))

    one = F.lit(1.0)
    options = F.array(
        variant("full", n, t, depth, one),
        variant("thermal_only", F.lit(C.THERMAL_ONLY_NONTHERMAL_1E7), t, depth, one),
        variant("no_razin_density_proxy", n, F.least(t, F.lit(C.LOW_DENSITY_THERMAL_1E9)), depth, one),
        variant("optically_thin_proxy", n, t, thin, depth / thin))
    exploded = params.withColumn("_v", F.explode(options))
    return exploded.withColumns({
        "variant": F.col("_v.variant"), "nonthermal_density_1e7": F.col("_v.n"),
        "thermal_density_1e9": F.col("_v.t"), "los_depth_arcsec": F.col("_v.l"),
        "rescale": F.col("_v.f")}).drop("_v")


def spectrum_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a - b for left, right, total and circular flux; the degree is NaN where undefined (JON12)."""
    parts = ["left", "right", "total", "circular"]
    renamed = b.select(*keys, *[F.col(p).alias(f"_{p}") for p in parts])
    joined = a.join(renamed, keys)
    out = joined.select(*keys, *[(F.col(p) - F.col(f"_{p}")).alias(p) for p in parts])
    valid = finite(F.col("total")) & (F.col("total") != 0.0)
    return out.withColumn("degree", F.when(valid, safe_ratio(F.col("circular"), F.col("total")))
                          .otherwise(F.lit(float("nan"))))


def scale_spectrum(df: DataFrame, factor: Column | float) -> DataFrame:
    """k * spectrum; the degree does not change (JON12)."""
    k = factor if isinstance(factor, Column) else F.lit(float(factor))
    return df.withColumns({p: F.col(p) * k for p in ("left", "right", "total", "circular")})


def array_scale(spectrum: Column, factor: Column | float) -> Column:
    """Element-wise k * spectrum of an array Column (ARR2)."""
    return F.transform(spectrum, lambda v: v * factor)


def array_subtract(a: Column, b: Column) -> Column:
    """Element-wise difference of two array Columns (ARR2)."""
    return F.zip_with(a, b, lambda x, y: x - y)


def array_zero(spectrum: Column) -> Column:
    """Array of zeros as long as the spectrum (ARR2)."""
    return F.array_repeat(F.lit(0.0), F.size(spectrum))


# -- providers (UDF5) ---------------------------------------------------------------------------

def constant_provider(**values: float) -> Callable[[DataFrame], DataFrame]:
    """Provider that attaches the same values to every cell."""
    return lambda cells: cells.withColumns({k: F.lit(float(v)) for k, v in values.items()})


def table_provider(table: DataFrame, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Provider that looks the values up by cell key."""
    return lambda cells: cells.join(table, keys, "left")


def function_provider(**functions: Callable[[Column, Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """Provider that computes the values from the cell coordinates x and y."""
    return lambda cells: cells.withColumns({k: f(F.col("x"), F.col("y")) for k, f in functions.items()})


