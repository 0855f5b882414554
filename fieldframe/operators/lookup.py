"""Point-in-interval and as-of lookups without theta joins (JON2, JON3, JON6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.functions.axes import fixed_edge_index
from fieldframe.operators.blocks import last_value, range_blocks, shifted_rows
from fieldframe.session import materialize


#: Most intervals that a caller may have looked up by a search written into the expression.
SMALL_AXIS = 64


def interval_lookup(points: DataFrame, x: str, intervals: DataFrame, lo: str, hi: str,
                    on: tuple[str, ...] = (), closed_top: float | None = None,
                    short: bool = False) -> DataFrame:
    """Attach the interval with lo <= x < hi to every point (JON6).

    Intervals must not overlap inside one ``on`` key. ``closed_top`` names the top edge that
    belongs to the last interval. With ``short`` the caller states that there are at most
    ``SMALL_AXIS`` intervals (more raise): they are searched inside the expression and
    broadcast. Else points and intervals are dealt together by ranges of x, each point takes the last interval
    that starts before it in its range, and the last one of a range is carried on to the next. No pairs are formed, and a
    position that many points share spreads over ranges.
    """
    def inside(position: Column, bottom: Column, top: Column) -> Column:
        fits = (position >= bottom) & (position < top)
        return fits if closed_top is None else fits | ((position == closed_top) & (top == closed_top))

    if short:
        starts = sorted(r[0] for r in intervals.select(lo).limit(SMALL_AXIS + 1).collect())
        if on or len(starts) > SMALL_AXIS:
            raise ValueError(f"a short list has one group and at most {SMALL_AXIS} intervals")
        numbered = intervals.withColumn("_i", fixed_edge_index(starts, F.col(lo)))
        tagged = points.withColumn("_i", fixed_edge_index(starts, F.col(x)))
        return tagged.join(F.broadcast(numbered), "_i").filter(
            inside(F.col(x), F.col(lo), F.col(hi))).drop("_i")

    names = [c for c in intervals.columns if c not in on]
    stops = intervals.select(*on, F.col(lo).alias("_x"), F.lit(0).alias("_point"), F.struct(*names).alias("_iv"))
    places = points.select(*on, F.col(x).alias("_x"), F.lit(1).alias("_point"), F.struct(*points.columns).alias("_row"))
    laid = range_blocks(stops.unionByName(places, allowMissingColumns=True), [*on, "_x", "_point"], "_range")
    found = last_value(laid, list(on), ["_x", "_point"], "_iv", "_iv", block=F.col("_range"))
    hits = found.filter((F.col("_point") == 1) & inside(F.col("_x"), F.col(f"_iv.{lo}"), F.col(f"_iv.{hi}")))
    first = [*on, x]
    kept = [*first, *[c for c in points.columns if c not in first]]
    return hits.select(*[F.col(f"_row.{c}").alias(c) for c in kept], *[F.col(f"_iv.{c}").alias(c) for c in names])


def intervals_of(edges: DataFrame, edge: str, columns: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """Half-open intervals ``lo``, ``hi`` between neighbouring edges, with columns of the lower edge."""
    outputs = {"lo": (edge, 1)} | {f"_c_{c}": (c, 1) for c in columns}
    laid = range_blocks(edges.select(*on, edge, *columns), [*on, edge], "_range")
    pairs = shifted_rows(laid, list(on), [edge], outputs, block=F.col("_range"))
    return pairs.filter(F.col("lo").isNotNull()).select(
        *on, "lo", F.col(edge).alias("hi"), *[F.col(f"_c_{c}").alias(c) for c in columns])


def asof_frame(wanted: DataFrame, available: DataFrame, frame: str = "frame",
               out: str = "field_frame", look_back: int = 1) -> DataFrame:
    """Same frame where present, else the nearest of the ``look_back`` frames before (JON2).

    Every available frame offers itself to the frames it may serve and the latest offer per
    frame wins. The offers, a few rows per frame, are written first: from their size Catalyst
    knows that the rows need no shuffle. Rows without an offer keep NULL.
    """
    offers = (available.select(F.col(frame).alias(out)).distinct()
              .withColumn(frame, F.explode(F.sequence(F.col(out), F.col(out) + look_back)))
              .groupBy(frame).agg(F.max(out).alias(out)))
    return wanted.join(materialize(offers, "frame-offers"), frame, "left")


def cell_lookup(points: DataFrame, field: DataFrame, axes: dict, coordinates: dict[str, str],
                keys: tuple[str, ...] = ("frame",), how: str = "inner") -> DataFrame:
    """Join points to the cell that contains them (JON3).

    ``axes`` maps index column to Axis, ``coordinates`` maps index column to the point
    coordinate. Cell indices are closed-form Columns and the join is an equi-join.
    """
    indexed = points.withColumns({i: a.cell_index(F.col(coordinates[i])) for i, a in axes.items()})
    return indexed.join(field, [*keys, *axes], how)


def field_threshold(points: DataFrame, field: DataFrame, axes: dict, coordinates: dict[str, str],
                    condition: Column, keys: tuple[str, ...] = ("frame",),
                    centering: str = "cell", out: str = "passes") -> DataFrame:
    """True where the field at the nearest cell or face passes; outside is False (FLT5)."""
    def index(axis, x: Column) -> Column:
        if centering == "cell":
            return axis.cell_index(x)
        return F.when(axis.contains(x), F.floor(axis.face_index(x) + 0.5).cast("int"))

    slim = points.withColumns({f"_{i}": index(a, F.col(coordinates[i])) for i, a in axes.items()})
    renamed = field.withColumnsRenamed({i: f"_{i}" for i in axes}).withColumn(out, condition)
    target = renamed.select(*keys, *[f"_{i}" for i in axes], out)
    joined = slim.join(target, [*keys, *[f"_{i}" for i in axes]], "left")
    kept = [F.col(c) for c in points.columns]
    return joined.select(*kept, F.coalesce(F.col(out), F.lit(False)).alias(out))
