"""Temperature mixing of sources, realised as block permutations within a token budget.

The token share of a source is raised to an exponent between 0 (all sources alike) and 1 (as they are). The exponent
is bisected until the mix has a target entropy, but no source is repeated more often than a limit allows. The weights
become a quota of tokens for each source: whole epochs, each a permutation of the source, and the beginning of one
more. All copies then go to blocks of about equal token counts, in each of which the sources have their weights.
Everything is DataFrame functions; the driver receives sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.common import row_of, small, staged

#: Bisections that one pass over the source totals decides, and passes.
LEVELS, PASSES = 4, 8
#: Documents of one source and epoch that are ordered together.
BUCKET_ROWS = 10_000
_DIGITS = 15  # hexadecimal digits of a hash that order a permutation
_WORDS = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``entropy``: wanted share of the largest possible entropy; ``repeats``: most epochs of any source.

    ``budget``: tokens of the whole mix; None for the least budget with which no source loses a document.
    """
    entropy: float = 0.95
    repeats: float = 2.0
    budget: int | None = None
    block_tokens: int = 1_000_000
    seed: str = "mix"


def tokens(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def order(seed: str, epoch: Column, number: Column, purpose: str = "") -> Column:
    """A place in 0 .. 16^15 that depends on nothing but its arguments."""
    name = F.concat_ws(":", F.lit(seed + purpose), epoch.cast("string"), F.coalesce(number.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, _DIGITS), 16, 10).cast("long")


def _bisected(totals: DataFrame, mix: Mix) -> float:
    """The exponent, from sums over the positive source totals ``totals(t)``."""
    n, least, most, everything = totals.agg(F.count("t"), F.min("t"), F.max("t"), F.sum("t")).first()
    if not n:
        return 1.0
    points = (1 << LEVELS) - 1
    by_entropy, by_repeats = (0.0, 1.0), (0.0, 1.0)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        share = F.col("t") / F.lit(float(most))
        row = totals.agg(*[s for a in exponents for s in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]).first()
        return list(zip(row[::2], row[1::2]))

    def enough(a: float, z: float, l: float) -> bool:
        return math.log(z) - a * l / z >= mix.entropy * math.log(n) - 1e-12

    def allowed(a: float, z: float, _: float) -> bool:
        if mix.budget is None:
            return (most / least) ** (1 - a) <= mix.repeats + 1e-12
        return mix.budget * (least / most) ** a / z / least <= mix.repeats + 1e-12

    def narrowed(low: float, high: float, holds: list[bool], low_holds: bool) -> tuple[float, float]:
        grid = [low + (high - low) * i / (points + 1) for i in range(points + 2)]
        i, j = 0, points + 1
        while j - i > 1:  # the bisections of this pass
            m = (i + j) // 2
            i, j = (m, j) if holds[m - 1] == low_holds else (i, m)
        return grid[i], grid[j]

    whole = sums([1.0])[0]
    if enough(1.0, *whole):
        by_entropy = (1.0, 1.0)
    for _ in range(PASSES):
        grids = [[low + (high - low) * i / (points + 1) for i in range(1, points + 1)] for low, high in (by_entropy, by_repeats)]
        found = sums(grids[0] + grids[1])
        if by_entropy[0] < by_entropy[1]:
            by_entropy = narrowed(*by_entropy, [enough(a, *f) for a, f in zip(grids[0], found)], True)
        by_repeats = narrowed(*by_repeats, [allowed(a, *f) for a, f in zip(grids[1], found[points:])], False)
    return math.ceil(max(by_entropy[0], by_repeats[1] if by_repeats[1] > 2 ** (-LEVELS * PASSES) else 0.0) * 1e6 - 1e-3) / 1e6


def source_quotas(rows: DataFrame, mix: Mix) -> DataFrame:
    """Per source of ``rows(source, n_tokens)``: source, total, docs, weight, quota, epochs (whole ones), rest (tokens)."""
    totals = staged(rows.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("docs")), "source-totals")
    positive = totals.filter("total > 0").select(F.col("total").alias("t"))
    exponent = F.lit(_bisected(positive, mix))
    largest, raised = totals.agg(F.max("total"), F.sum(F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), exponent)))).first()
    weight = F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), exponent) / F.lit(raised or 1.0)).otherwise(F.lit(0.0))
    weighted = totals.withColumn("weight", weight)
    budget = mix.budget
    if budget is None:
        budget = weighted.agg(F.max(F.when(F.col("total") > 0, F.round(F.col("total") / F.col("weight"))))).first()[0] or 0
    quota = F.round(F.lit(float(budget)) * F.col("weight")).cast("long")
    filled = weighted.withColumn("quota", quota)
    whole = F.when(F.col("total") > 0, F.expr("quota div total")).otherwise(F.lit(1).cast("long"))
    return staged(filled.withColumn("epochs", whole).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("total")), "source-quotas")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
                       tokens(F.col(text_col)).alias("n_tokens"))


def _placed(copies: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``at`` (place in the epoch's permutation), ``before`` and ``after``: tokens of the source's epoch so far.

    Places are cut into buckets of about ``BUCKET_ROWS`` documents; running sums are taken within a bucket and over
    the sums of the buckets, so no task holds a source.
    """
    at = order(mix.seed, F.col("epoch"), F.col("id"))
    buckets = F.ceil(F.col("docs") / BUCKET_ROWS)
    spread = copies.withColumn("at", at).withColumn("bucket", F.floor(F.col("at") / float(16 ** _DIGITS) * buckets))
    keys = ["source", "epoch", "bucket"]
    sums = spread.groupBy(*keys).agg(F.sum("n_tokens").alias("inside"))
    earlier = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sums.withColumn("offset", F.coalesce(F.sum("inside").over(earlier), F.lit(0))).drop("inside"), "bucket-offsets")
    # rows of one place count together: they all stay or all go
    same = Window.partitionBy(*keys).orderBy("at", "id")
    return (spread.join(small(offsets), keys).withColumn("after", F.col("offset") + F.sum("n_tokens").over(same))
            .withColumn("before", F.col("after") - F.col("n_tokens")).drop("offset", "bucket"))


def _fits(n_tokens, rest, mix: Mix):
    """A document that the cut epoch may take. One of more than twice the rest would only lead away from the quota; a given budget is kept."""
    return n_tokens <= (2 * rest if mix.budget is None else rest)


def _rest_copies(rows: DataFrame, quotas: DataFrame, mix: Mix) -> DataFrame:
    """The documents of each source's last, cut epoch.

    The permutation of the documents that fit is followed as far as the rest of the quota reaches; the document that
    crosses its end is taken if that comes nearer to the quota, unless a budget was given, which is not exceeded. A source
    so misses its quota by half a document at most, with a budget by less than one.
    """
    begun = quotas.filter("rest > 0").select("source", "docs", "rest", "total", "quota", F.col("epochs").alias("epoch"))
    fitting = rows.join(small(begun), "source").filter(_fits(F.col("n_tokens"), F.col("rest"), mix))
    together = Window.partitionBy("source", "epoch", "at", "id")
    placed = _placed(fitting, mix).withColumn("start", F.col("after") - F.sum("n_tokens").over(together))
    crossing = F.lit(mix.budget is None) & (F.col("start") < F.col("rest")) & (F.col("after") - F.col("rest") <= F.col("rest") - F.col("start"))
    return placed.filter((F.col("after") <= F.col("rest")) | crossing).drop("start")


def plan(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix, one row per copy of a document: id, source, n_tokens, epoch (from 0), block, position (in its block, from 1).

    A null source counts as the source of the empty name, a null text has no tokens. Sources without tokens keep one
    epoch. Repeated rows are documents of their own with one place in the permutation. Null ids share a place. An
    empty table gives no rows; further columns are ignored. Source totals, exponent and quotas are found now.
    """
    rows = _rows(docs, id_col, text_col, source_col)
    quotas = source_quotas(rows, mix)
    blocks = (quotas.agg(F.ceil(F.sum("quota") / mix.block_tokens)).first()[0] or 1)
    whole = (rows.join(small(quotas.filter("epochs > 0").select("source", "docs", "total", "quota", "epochs")), "source")
             .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))).drop("epochs"))
    columns = ["id", "source", "n_tokens", "epoch", "total", "quota", "before"]
    copies = _placed(whole, mix).select(*columns).unionByName(_rest_copies(rows, quotas, mix).select(*columns))
    filled = (F.col("epoch") * F.col("total") + F.col("before")).cast("double") * F.lit(float(blocks))
    block = F.when(F.col("quota") > 0, F.least(F.floor(filled / F.col("quota")), F.lit(blocks - 1))).otherwise(F.lit(0)).cast("long")
    in_block = Window.partitionBy("block").orderBy(order(mix.seed, F.col("epoch"), F.col("id"), "-block"), "epoch", "id")
    return (copies.withColumn("block", block)
            .select(F.col("id").alias(id_col), "source", "n_tokens", "epoch", "block", F.row_number().over(in_block).cast("long").alias("position")))


def repeat(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as :func:`plan` has copies of it.

    The last document that each source's cut epoch reaches is its mark; a row compares its own place with it, so
    texts are neither shuffled nor joined but for the table of sources.
    """
    rows = _rows(docs, id_col, text_col, source_col)
    quotas = source_quotas(rows, mix)
    reached = _rest_copies(rows, quotas, mix).groupBy("source").agg(F.max(F.struct("at", "id")).alias("mark"))
    marks = staged(quotas.select("source", "epochs", "rest").join(reached, "source", "left")
                   .select(F.col("source").alias("_source"), F.col("epochs").alias("_epochs"), F.col("rest").alias("_rest"), F.col("mark").alias("_mark")), "source-marks")
    keyed = docs.select(row_of(docs), F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("_key"),
                        tokens(F.col(text_col)).alias("_tokens"))
    here = F.struct(order(mix.seed, F.col("_epochs"), F.col("_id")).alias("at"), F.col("_id").alias("id"))
    more = F.when(F.col("_mark").isNotNull() & (here <= F.col("_mark")) & _fits(F.col("_tokens"), F.col("_rest"), mix), F.lit(1)).otherwise(F.lit(0))
    copies = F.expr("array_repeat(1, cast(_copies as int))")
    return (keyed.join(small(marks), F.col("_key") == F.col("_source")).withColumn("_copies", F.col("_epochs") + more)
            .withColumn("_copy", F.explode(copies)).select("row.*"))


def report(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per source: total tokens, quota, planned weight, and the tokens and weight that :func:`plan` realises."""
    rows = _rows(docs, id_col, text_col, source_col)
    quotas = source_quotas(rows, mix)
    more = _rest_copies(rows, quotas, mix).groupBy("source").agg(F.sum("n_tokens").alias("more"))
    got = staged(quotas.join(more, "source", "left").select(
        "source", "total", "quota", "weight", (F.col("epochs") * F.col("total") + F.coalesce("more", F.lit(0))).alias("realised")), "mix-report")
    whole = got.agg(F.sum("realised")).first()[0] or 1
    return got.withColumn("realised_weight", F.col("realised") / F.lit(float(whole)))
