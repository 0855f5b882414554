"""Ordered operations whose groups may hold a large share of all rows.

A window over (keys, order) sorts each whole key group in one task. The functions
here cut every group into blocks along the order, work inside (keys, block), and
carry a small summary from block to block: one row per block for running sums and
latest values, at most ``n`` rows per block for lags. Summaries are carried in a tree: inside groups of
``FAN`` neighbouring blocks, then among those groups, so that no task holds all summaries either.
The big side is shuffled once on (keys, block); the summaries join back on the same key.

Blocks are fixed ranges of an integer order column, or measured: the rows are dealt by ranges of
(keys, order) that Spark samples, and the number of the range is the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldframe.functions.numeric import finite
from fieldframe.session import materialize

#: Default width of a block in units of an integer order column.
BLOCK_WIDTH = 1 << 20
#: Blocks whose summaries meet in one task.
FAN = 1 << 16
#: Bins of one pass over the values of a key when a percentile is narrowed down.
BINS = 4096

_BLOCK, _PARENT, _ALL = "_block", "_parent", "_all"


def fixed_blocks(order: str, width: int = BLOCK_WIDTH) -> Column:
    """Block number of an integer order column; unique ids give at most ``width`` rows each."""
    return F.floor(F.col(order) / float(width)).cast("long")


def range_blocks(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Deal rows by sampled ranges of ``columns`` and add the number of the range.

    Rows that agree in all columns may lie in several neighbouring ranges, so a hot value does not
    fill one. The table is written, so that ranges stay as they are when a task is repeated.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*columns, "_tie").drop("_tie")
    return materialize(ranged.withColumn(out, F.spark_partition_id().cast("long")), "ranges")


def _keyed(df: DataFrame, keys: list[str], block: Column) -> tuple[DataFrame, list[str], list[str]]:
    """Add the key and block columns that windows, summaries and joins share.

    They are never NULL (a NULL key is a default value and a flag), so NULL keys form a group
    like any other, and the join adds no filters that would keep Spark from reusing an
    exchange. Returns the frame, the key columns and the key and block columns.
    """
    added: dict[str, Column] = {}
    for i, key in enumerate(keys):
        kind = df.schema[key].dataType
        default = "" if isinstance(kind, T.StringType) else 0 if isinstance(kind, T.NumericType) else None
        if default is None:
            added[f"_k{i}"] = F.struct(key)
        else:
            added[f"_k{i}"] = F.coalesce(F.col(key), F.lit(default).cast(kind))
            added[f"_n{i}"] = F.col(key).isNull()
    group = list(added)
    added[_BLOCK] = F.coalesce(block.cast("long"), F.lit(-1).cast("long"))
    return df.withColumns(added), group, [*group, _BLOCK]


def _with_parents(summaries: DataFrame) -> DataFrame:
    """Add the group of neighbouring blocks, and a column that is 0 for all of them.

    The latter deals the few rows of the top by their keys, or to one task where there are none.
    """
    parent = F.floor((F.col(_BLOCK) + 1) / float(FAN)).cast("long")
    return summaries.withColumn(_PARENT, parent).withColumn(_ALL, F.least(F.abs(_BLOCK), F.lit(0).cast("long")))


def _earlier(within: list[str], order: str, last: int = W.unboundedPreceding) -> W:
    return W.partitionBy(*within).orderBy(order).rowsBetween(last, -1)


def running_sum(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
                block: Column | None = None, width: int = BLOCK_WIDTH,
                totals: dict[str, str] | None = None) -> DataFrame:
    """Inclusive running sums per key; ``values`` maps output name to input column.

    ``order`` must be unique inside a key; ``block`` must not decrease along it and
    defaults to fixed blocks of the first order column. ``totals`` adds the sum over the
    whole key, output name to the name of a running sum.
    """
    blocked, group, cut = _keyed(df, keys, fixed_blocks(order[0], width) if block is None else block)
    inside = W.partitionBy(*cut).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = _with_parents(blocked.groupBy(*cut).agg(*[F.sum(c).alias(f"_total_{o}") for o, c in values.items()]))
    above = sums.groupBy(*group, _PARENT, _ALL).agg(*[F.sum(f"_total_{o}").alias(f"_total_{o}") for o in values])
    whole = W.partitionBy(*group, _ALL)
    above = above.select(
        *group, _PARENT,
        *[F.coalesce(F.sum(f"_total_{o}").over(_earlier([*group, _ALL], _PARENT)), F.lit(0)).alias(f"_above_{o}") for o in values],
        *[F.sum(f"_total_{o}").over(whole).alias(name) for name, o in (totals or {}).items()])
    beside = sums.select(*cut, _PARENT, *[
        F.coalesce(F.sum(f"_total_{o}").over(_earlier([*group, _PARENT], _BLOCK)), F.lit(0)).alias(f"_beside_{o}") for o in values])
    offsets = beside.join(above, [*group, _PARENT]).select(
        *cut, *[(F.col(f"_above_{o}") + F.col(f"_beside_{o}")).alias(f"_before_{o}") for o in values], *(totals or {}))
    local = blocked.withColumns({f"_local_{o}": F.sum(c).over(inside) for o, c in values.items()})
    return local.join(offsets, cut).select(
        *df.columns, *[(F.col(f"_local_{o}") + F.col(f"_before_{o}")).alias(o) for o in values],
        *(totals or {}))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str,
                block: Column | None = None, width: int = BLOCK_WIDTH) -> DataFrame:
    """Deterministic 1-based row numbers per key (WIN7)."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(counted, keys, order, {out: "_one"}, block, width).drop("_one")


def shifted_rows(df: DataFrame, keys: list[str], order: list[str],
                 outputs: dict[str, tuple[str, int]], block: Column | None = None,
                 width: int = BLOCK_WIDTH) -> DataFrame:
    """Earlier rows of the same key: output name -> (column, rows back) (WIN2)."""
    depth = max(back for _, back in outputs.values())
    columns = sorted({c for c, _ in outputs.values()})
    blocked, group, cut = _keyed(df, keys, fixed_blocks(order[0], width) if block is None else block)
    ordered = W.partitionBy(*cut).orderBy(*order)
    local = blocked.withColumns(
        {"_rn": F.row_number().over(ordered)}
        | {f"_lag_{o}": F.lag(c, back).over(ordered) for o, (c, back) in outputs.items()})
    # the last rows of every block, oldest first; Spark cuts to them before the shuffle
    from_end = W.partitionBy(*cut).orderBy(*[F.col(c).desc() for c in order])
    tails = (blocked.withColumn("_rev", F.row_number().over(from_end))
             .filter(F.col("_rev") <= depth)
             .groupBy(*cut)
             .agg(F.array_sort(F.collect_list(
                 F.struct((-F.col("_rev")).alias("pos"), *columns))).alias("_tail")))
    tails = _with_parents(tails)
    newest = W.partitionBy(*group, _PARENT).orderBy(F.col(_BLOCK).desc())
    above = (tails.withColumn("_rev", F.row_number().over(newest)).filter(F.col("_rev") <= depth)
             .groupBy(*group, _PARENT, _ALL)
             .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(_BLOCK, "_tail"))), lambda t: t["_tail"])).alias("_tail"))
             .select(*group, _PARENT, F.flatten(F.collect_list("_tail").over(_earlier([*group, _ALL], _PARENT, -depth))).alias("_above")))
    carried = (tails.select(*cut, _PARENT, F.flatten(F.collect_list("_tail").over(_earlier([*group, _PARENT], _BLOCK, -depth))).alias("_beside"))
               .join(above, [*group, _PARENT]).select(*cut, F.concat("_above", "_beside").alias("_carry")))

    def pick(name: str, column: str, back: int) -> Column:
        index = F.size("_carry") - (F.lit(back) - (F.col("_rn") - 1))
        from_carry = F.get(F.col("_carry"), F.when(index >= 0, index))[column]
        return F.when(F.col("_rn") > back, F.col(f"_lag_{name}")).otherwise(from_carry).alias(name)

    return local.join(carried, cut).select(
        *df.columns, *[pick(o, c, b) for o, (c, b) in outputs.items()])


def last_value(df: DataFrame, keys: list[str], order: list[str], column: str, out: str,
               block: Column | None = None, width: int = BLOCK_WIDTH) -> DataFrame:
    """The latest non-NULL value of a column up to each row of its key.

    The summary of a block is its own latest value, NULL where it has none.
    """
    blocked, group, cut = _keyed(df, keys, fixed_blocks(order[0], width) if block is None else block)
    inside = W.partitionBy(*cut).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))
    ends = _with_parents(blocked.groupBy(*cut).agg(latest.alias("_end")))
    above = (ends.groupBy(*group, _PARENT, _ALL)
             .agg(F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col(_BLOCK))).alias("_end"))
             .select(*group, _PARENT, F.last("_end", ignorenulls=True).over(_earlier([*group, _ALL], _PARENT)).alias("_above")))
    carried = (ends.select(*cut, _PARENT, F.last("_end", ignorenulls=True).over(_earlier([*group, _PARENT], _BLOCK)).alias("_beside"))
               .join(above, [*group, _PARENT]).select(*cut, F.coalesce("_beside", "_above").alias("_before")))
    local = blocked.withColumn("_local", F.last(column, ignorenulls=True).over(inside))
    kept = [c for c in df.columns if c != out]
    return local.join(carried, cut).select(*kept, F.coalesce("_local", "_before").alias(out))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per key, output name -> fraction (AGG23).

    Each percentile lies between two ranks, and each rank is narrowed down: a pass counts the
    rows between its bounds in ``BINS`` equal steps, with the least and largest value of each, and the bin
    that holds the rank gives the next bounds, until they are equal. A pass is an aggregate of fixed size for each
    key; only rows between some bounds are written for the next one. Values that are NULL or not finite
    are left out, a key without others has no row. Passes run when the function is called, two or three as a rule.
    """
    # always 0, but not a literal, so that tables without keys are joined on a column too
    one = F.shiftright(F.shiftrightunsigned(F.hash(value), 1), 31).alias("_one")
    usable = df.filter(finite(F.col(value)))
    rows = usable.select(F.struct(one, *keys).alias("_g"), F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy("_g").agg((F.count(F.lit(1)) - 1).alias("top"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    ranks = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rounded(F.col("top") * float(q)).cast("long").alias("rank"))
             for name, q in points.items() for side, rounded in (("low", F.floor), ("high", F.ceil))]
    shares = [(F.col("top") * float(q) - F.floor(F.col("top") * float(q))).alias(f"share_{name}") for name, q in points.items()]
    sizes = materialize(sizes.select("_g", "lo", "hi", *shares, F.explode(F.array(*ranks)).alias("r")).select("*", "r.*").drop("r"), "ranks")
    targets = sizes.select("_g", "name", "side", "rank", "lo", "hi")
    first = True
    while not (searched := targets.filter("lo < hi")).isEmpty():
        between = rows.join(searched.select("_g", "lo", "hi").distinct(), "_g").filter("_v >= lo AND _v <= hi")
        if not first:
            between = materialize(between, "between")
            rows = between.select("_g", "_v")
        first = False
        span = F.col("hi") - F.col("lo")
        # the halves serve spans beyond the largest double
        along = F.when(span < float("inf"), (F.col("_v") - F.col("lo")) / span).otherwise(
            (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        counted = between.groupBy("_g", "lo", "hi", F.least(F.floor(along * BINS), F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = W.partitionBy("_g", "lo", "hi").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = counted.withColumn("after", F.sum("n").over(upto)).withColumn("before", F.col("after") - F.col("n"))
        found = searched.join(placed, ["_g", "lo", "hi"]).filter("rank >= before AND rank < after").select(
            "_g", "name", "side", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))
        targets = materialize(targets.filter("lo >= hi").unionByName(found), "targets")

    def at(name: str, side: str) -> Column:
        return F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("lo")))

    ends = targets.groupBy("_g").agg(*[at(n, s).alias(f"{s}_{n}") for n in points for s in ("low", "high")])
    share = sizes.groupBy("_g").agg(*[F.first(f"share_{n}").alias(f"share_{n}") for n in points])
    return ends.join(share, "_g").select(*[F.col("_g")[k].alias(k) for k in keys], *[
        (F.col(f"low_{n}") + (F.col(f"high_{n}") - F.col(f"low_{n}")) * F.col(f"share_{n}")).alias(n) for n in points])
