"""Random points, weighted picks and particle splitting (SMP1-SMP7, AGG26, SRT1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.functions import constants as C
from fieldframe.functions.axes import Axis
from fieldframe.functions.numeric import finite
from fieldframe.functions.predicates import compare, in_region
from fieldframe.operators.blocks import BLOCK_WIDTH, row_numbers, running_sum
from fieldframe.operators.lookup import interval_lookup
from fieldframe.session import materialize

Uniform = Callable[[Column, Column, int], Column]


def hashed_uniform(seed: int = 0) -> Uniform:
    """Uniform numbers in [0, 1) from a hash of (id, try, dimension).

    The same row always draws the same number, whatever the partitioning and however
    often a task is retried.
    """
    def draw(row_id: Column, attempt: Column, dim: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(row_id, attempt, F.lit(dim), F.lit(seed)), 11)
        return bits.cast("double") * (2.0 ** -53)
    return draw


def uniform_points(ids: DataFrame, row_id: str, region: dict[str, tuple[float, float]],
                   predicate: Callable[[dict[str, Column]], Column], max_attempts: int = 64,
                   uniform: Uniform | None = None, status: int = C.STATUS_ACTIVE) -> DataFrame:
    """One uniform point per id, the first of up to ``max_attempts`` draws that is accepted (SMP1).

    Rows without an accepted draw keep the last one and become inactive. ``predicate``
    maps coordinate Columns to a boolean Column (UDF1). All draws of a row are evaluated
    in place, and only rows whose first draw fails look at more than one.
    """
    draw = uniform or hashed_uniform()
    names = list(region)

    def point(attempt: Column) -> Column:
        return F.struct(*[
            (F.lit(float(region[n][0])) + draw(F.col(row_id), attempt, k)
             * float(region[n][1] - region[n][0])).alias(n) for k, n in enumerate(names)])

    def accepted(p: Column) -> Column:
        return predicate({n: p[n] for n in names})

    first = ids.withColumn("_p", point(F.lit(0)))
    ok = accepted(F.col("_p"))
    rest = F.filter(F.transform(F.sequence(F.lit(1), F.lit(max_attempts - 1)), point), accepted)
    tried = first.withColumn("_hit", F.when(ok, F.col("_p")).otherwise(
        F.get(rest, F.lit(0)) if max_attempts > 1 else F.lit(None)))
    chosen = F.coalesce(F.col("_hit"), point(F.lit(max_attempts - 1)))
    out = tried.withColumn("_c", chosen).withColumn(
        "status", F.when(F.col("_hit").isNotNull(), status).otherwise(C.STATUS_INACTIVE))
    return out.select(*ids.columns, *[F.col(f"_c.{n}").alias(n) for n in names], "status")


def candidate_cells(field: DataFrame, region: dict[str, tuple[float, float]], value: Column,
                    threshold: float, mode: str, volume: Column, order: list[str],
                    width: int = BLOCK_WIDTH) -> DataFrame:
    """Cells inside a region that pass a threshold, with cumulative volume (SMP2, WIN3).

    Adds ``cell_weight``, ``cum_lo`` and ``cum_hi``. ``order`` must be unique and start
    with an integer.
    """
    chosen = field.filter(in_region(region) & compare(value, threshold, mode)).withColumn("cell_weight", volume)
    return cumulative_weight(chosen, "cell_weight", order, width)


def cumulative_weight(df: DataFrame, weight: str, order: list[str], width: int = BLOCK_WIDTH) -> DataFrame:
    """Half-open cumulative intervals ``cum_lo``, ``cum_hi`` of a weight (WIN3)."""
    summed = running_sum(df, [], order, {"cum_hi": weight}, width=width)
    return summed.withColumn("cum_lo", F.col("cum_hi") - F.col(weight))


def total_weight(df: DataFrame, weight: str) -> float:
    """Sum of a weight; zero or non-finite totals are an error (SMP2)."""
    return _positive(df.agg(F.sum(weight)).first()[0])


def _positive(total) -> float:
    if total is None or not 0.0 < float(total) < float("inf"):
        raise ValueError("the total weight must be positive and finite")
    return float(total)


def weighted_pick(draws: DataFrame, candidates: DataFrame, fraction: str, weight: str,
                  order: list[str], width: int = BLOCK_WIDTH) -> DataFrame:
    """Sampling with replacement by inverse CDF (SMP3).

    ``fraction`` in [0, 1) is the draw; the candidate whose cumulative weight first
    exceeds fraction * total is attached. Zero-weight candidates are never picked. The cumulative
    weights are written once; their last one is the total.
    """
    usable = ~(F.col(weight) <= 0.0) | F.isnan(weight)
    cumulative = materialize(cumulative_weight(candidates.filter(usable), weight, order, width), "cumulative")
    targets = draws.withColumn("target", F.col(fraction) * _positive(cumulative.agg(F.max("cum_hi")).first()[0]))
    return interval_lookup(targets, "target", cumulative, "cum_lo", "cum_hi")


def point_in_cell(cells: DataFrame, axes: dict[str, Axis], row_id: str,
                  uniform: Uniform | None = None) -> DataFrame:
    """Uniform position inside the cell of each row, columns ``u_<dim>`` (SMP3)."""
    draw = uniform or hashed_uniform()
    return cells.withColumns({
        f"u_{d}": a.face(F.col(d)) + draw(F.col(row_id), F.lit(0), k) * a.cell_width(F.col(d))
        for k, (d, a) in enumerate(axes.items())})


# -- splitting --------------------------------------------------------------------------------

def _apply_split(marked: DataFrame, keys: list[str], row_id: str, capacity: int | None,
                 child_weight: Column, width: int) -> DataFrame:
    """Turn rows marked ``split`` into parent and child within the capacity of each key."""
    split = F.col("outcome") == "split"
    counts = marked.withColumns({"_want": split.cast("long"), "_one": F.lit(1).cast("long")})
    ranked = running_sum(counts, keys, [row_id], {"_offset": "_want", "_rank": "_one"}, width=width,
                         totals={"_stored": "_rank"})
    child_index = F.col("_stored") + F.col("_offset") - 1
    if capacity is not None:
        ranked = ranked.withColumn("outcome", F.when(split & (child_index >= capacity), "skipped_capacity")
                                   .otherwise(F.col("outcome")))
    marked = ranked.withColumn("_child_id", child_index)
    doubled = marked.withColumn("is_child", F.explode(
        F.when(split, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return (doubled
            .withColumn("weight", F.when(split, child_weight).otherwise(F.col("weight")))
            .withColumn("split_level", F.when(split, F.col("split_level") + 1).otherwise(F.col("split_level")))
            .withColumn(row_id, F.when(F.col("is_child"), F.col("_child_id")).otherwise(F.col(row_id)))
            .drop("_want", "_one", "_offset", "_rank", "_stored", "_child_id"))


def split_on_energy_growth(particles: DataFrame, energy: str, keys: list[str], row_id: str = "particle_id",
                           ratio: float = 2.0, minimum_child_weight: float = 0.0,
                           capacity: int | None = None, width: int = BLOCK_WIDTH) -> DataFrame:
    """Split active rows whose energy grew past the next level; both halves keep half the weight (SMP4).

    Adds ``outcome`` (inactive, kept, split, skipped_baseline, skipped_minimum_weight,
    skipped_capacity) and ``is_child``. Child ids continue after the stored rows of the
    key in the order of ``row_id`` (WIN7). A missing baseline is set to the current energy.
    """
    active = F.col("status") == C.STATUS_ACTIVE
    base, now = F.col("initial_kinetic_energy"), F.col(energy)
    has_base = finite(base) & (base > 0.0)
    growth = F.when(has_base, now / base)
    target = F.floor(F.log(growth) / F.log(F.lit(float(ratio))))
    half = F.col("weight") * 0.5
    grown = finite(growth) & (growth >= ratio)
    outcome = (F.when(~active, "inactive").when(~has_base, "skipped_baseline")
               .when(~F.coalesce(grown, F.lit(False)), "kept")
               .when(target <= F.col("split_level"), "kept")
               .when(~finite(half) | (half <= 0.0) | (half < minimum_child_weight), "skipped_minimum_weight")
               .otherwise("split"))
    repaired = F.when(active & ~has_base & finite(now) & (now > 0.0), now).otherwise(base)
    marked = particles.withColumn("outcome", outcome).withColumn("initial_kinetic_energy", repaired)
    return _apply_split(marked, keys, row_id, capacity, half, width)


def split_on_momentum(particles: DataFrame, keys: list[str], pmin_split: float, ratio: float, pmax: float,
                      row_id: str = "particle_id", capacity: int | None = None,
                      width: int = BLOCK_WIDTH) -> DataFrame:
    """Split active rows above pmin*ratio^level; weights are reset to 0.5^level (SMP5)."""
    threshold = F.pow(F.lit(float(ratio)), F.col("split_level").cast("double")) * float(pmin_split)
    wanted = ((F.col("status") == C.STATUS_ACTIVE) & (F.col("p") > threshold) & (F.col("p") <= pmax))
    outcome = (F.when(F.col("status") != C.STATUS_ACTIVE, "inactive").when(wanted, "split").otherwise("kept"))
    reset = F.pow(F.lit(0.5), (F.col("split_level") + 1).cast("double"))
    return _apply_split(particles.withColumn("outcome", outcome), keys, row_id, capacity, reset, width)


def split_counters(split: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a split pass by outcome (AGG26)."""
    parent = ~F.col("is_child")

    def n(*names: str) -> Column:
        return F.count(F.when(parent & F.col("outcome").isin(*names), 1))

    return split.groupBy(*keys).agg(
        F.count(F.when(parent & (F.col("outcome") != "inactive"), 1)).alias("active"),
        n("split").alias("split"), n("skipped_capacity").alias("skipped_capacity"),
        n("skipped_baseline").alias("skipped_baseline"),
        n("skipped_minimum_weight").alias("skipped_minimum_weight"))


def apply_boundaries(particles: DataFrame, axes: dict[str, Axis]) -> DataFrame:
    """Wrap periodic coordinates of active rows, mark the others that left as escaped (SMP7).

    ``axes`` maps a coordinate column to its axis; ``prev_<c>`` and ``step_<c>`` move with
    the wrap where present.
    """
    active = F.col("status") == C.STATUS_ACTIVE
    changed, escaped = {}, F.lit(False)
    for c, axis in axes.items():
        if axis.periodic:
            shift = F.when(active, axis.wrap(F.col(c)) - F.col(c)).otherwise(0.0)
            changed[c] = F.when(active, axis.wrap(F.col(c))).otherwise(F.col(c))
            for past in (f"prev_{c}", f"step_{c}"):
                if past in particles.columns:
                    changed[past] = F.col(past) + shift
        else:
            escaped = escaped | ~axis.contains(F.col(c))
    changed["status"] = F.when(active & escaped, C.STATUS_ESCAPED).otherwise(F.col("status"))
    return particles.withColumns(changed)


def bucket_order(df: DataFrame, key: Column | Callable[[DataFrame], Column], within: list[str],
                 out: str = "sort_key", partitions: int | None = None) -> DataFrame:
    """Assign a sort key and lay rows out by it, sorted inside partitions (SRT1, UDF2).

    The range also uses the ``within`` columns, so a single hot key spreads over partitions.
    """
    keyed = df.withColumn(out, key(df) if callable(key) else key)
    columns = [out, *within]
    ranged = keyed.repartitionByRange(partitions, *columns) if partitions else keyed.repartitionByRange(*columns)
    return ranged.sortWithinPartitions(*columns)


__all__ = [
    "apply_boundaries", "bucket_order", "candidate_cells", "cumulative_weight", "hashed_uniform",
    "point_in_cell", "row_numbers", "split_counters", "split_on_energy_growth", "split_on_momentum",
    "total_weight", "uniform_points", "weighted_pick",
]
