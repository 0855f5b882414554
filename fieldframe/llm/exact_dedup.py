"""Exact deduplication by skew-safe combining.

Equal texts meet in three steps: within each input partition, then among partitions of one salt, then among
the winners of all salts. A group of copies, however large, reaches any task as one row per partition or salt.
Each step compares whole texts, the digest only decides where rows go, so texts that share a digest stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.common import ascii_lower, join_groups, row_of, small, staged

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def text_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text of ``rows(_id, _text, _digest)``: (_digest, _variant, keep_id, group_size).

    ``_variant`` is the text where its digest belongs to more than one text, else null.
    """
    merged = (rows.withColumn("_salt", F.spark_partition_id() % salts)
              .groupBy("_salt", "_digest", "_text")
              .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .repartition(F.col("_digest"))
              .groupBy("_digest", "_text")
              .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    same_digest = F.count(F.lit(1)).over(Window.partitionBy("_digest"))
    return merged.select("_digest", F.when(same_digest > 1, F.col("_text")).alias("_variant"), "keep_id", "group_size")


def _rows(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.col(text_col)).alias("_text"))
    return rows.withColumn("_digest", digest(F.col("_text")))


def _decided(docs: DataFrame, id_col: str, text_col: str, digest, salts: int) -> DataFrame:
    """Per row of ``docs``: _id, _digest, keep_id, group_size, kept.

    Large groups reach the rows by a bounded broadcast, and the row that stays is told from its repeats by its place in the
    written table, so no task holds all copies of a text.
    """
    rows = _rows(docs, id_col, text_col, digest)
    groups = staged(text_groups(rows, salts), "text-groups")
    collided = groups.filter(F.col("_variant").isNotNull()).limit(1).count() > 0
    if collided:
        joined = rows.join(groups.withColumnRenamed("_digest", "_d"),
                           (F.col("_digest") == F.col("_d"))
                           & (F.col("_variant").isNull() | (F.col("_variant") == F.col("_text"))))
    else:
        joined = join_groups(rows.drop("_text"), groups.drop("_variant"), ["_digest"], "group_size")
    variant = F.when(F.col("_variant").isNotNull(), F.sha2("_variant", 512)) if collided else F.lit(None).cast("string")
    best = F.col("_id").eqNullSafe(F.col("keep_id"))
    placed = staged(joined.select("_id", "_digest", variant.alias("_v"), "keep_id", "group_size", best.alias("_best"),
                                  F.monotonically_increasing_id().alias("_place")), "dedup-rows")
    first = placed.filter("_best").groupBy("_digest", "_v").agg(F.min("_place").alias("_place"), F.count(F.lit(1)).alias("_n"))
    if first.filter("_n > 1").isEmpty():
        return placed.withColumn("kept", F.col("_best"))
    chosen = first.select("_place", F.lit(True).alias("_first"))
    return placed.join(chosen, "_place", "left").withColumn("kept", F.coalesce("_first", F.lit(False)))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256,
                     salts: int = SALTS) -> DataFrame:
    """Per row of ``docs``: id, keep_id, group_size, kept and the digest of the normalised text.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and the empty text is a
    text like any other. The row with the largest id stays (a null id is the smallest; a group with null ids only
    keeps one of them). Of repeated rows (same id and text) one stays. Only the id and text columns are read, so
    further columns do not matter. An empty table gives an empty result. The groups and the rows with their groups are
    written before the result is returned.
    """
    return _decided(docs, id_col, text_col, digest, salts).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256,
                salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Same rules as :func:`duplicate_groups`. What is joined to the texts is the list of (id, digest) that go, which
    is broadcast only if it was counted to be small; repeated rows, if there are any, are reduced to one by a
    shuffle of just those rows.
    """
    decided = _decided(docs, id_col, text_col, digest, salts).select(F.col("_id").alias("_i"), "kept", F.col("_digest").alias("_d"))
    gone = staged(decided.groupBy("_i", "_d").agg(F.max("kept").alias("_k"), F.count(F.lit(1)).alias("_n"))
                  .filter(~F.col("_k") | (F.col("_n") > 1)), "dedup-gone")
    keyed = docs.select(row_of(docs), F.col(id_col).alias("_id"), digest(ascii_lower(F.col(text_col))).alias("_digest"))
    match = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d"))
    kept = keyed.join(small(gone), match, "left_anti")
    repeated = gone.filter(F.col("_k"))
    if repeated.limit(1).count():
        once = keyed.join(small(repeated), match, "left_semi").dropDuplicates(["_id", "_digest"])
        kept = kept.unionByName(once)
    return kept.select("row.*")
