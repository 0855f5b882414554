"""Helpers shared by the operators of this subpackage: shared folders, written tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast when it was counted to have at most this many narrow rows.
BROADCAST_ROWS = 400_000
#: Groups with more than this share of all rows are joined by a broadcast, so there are fewer of them than ``HOT_GROUPS``.
HOT_GROUPS = 20_000


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    The setting may be missing only where driver and executors are one process (tests); then it is
    set to a temporary folder. On any other master a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fieldframe-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage is cut and its size is known."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written, narrow table for a broadcast if it has at most ``limit`` rows.

    Beyond the limit the table is returned as it is, and the join shuffles both sides. The rows
    of the result are the same either way.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Each of ``rows`` with the columns of its group; every row has exactly one group, keys are not null.

    ``groups`` is a written table and ``size`` counts the rows of each group. Groups with more than 1/``HOT_GROUPS`` of all rows
    are broadcast, which the share alone bounds; their rows are dealt one by one through the join that serves the other groups.
    """
    others = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_GROUPS > total
    hot = groups.filter(is_hot).select(*keys, F.struct(*others).alias("_hot"))
    cold = groups.filter(~is_hot).select(*keys, F.lit(-1).cast("long").alias("_deal"), F.struct(*others).alias("_cold"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    dealt = marked.withColumn("_deal", F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    found = dealt.join(cold, [*keys, "_deal"], "left").withColumn("_group", F.coalesce("_hot", "_cold"))
    return found.select(*rows.columns, *[F.col(f"_group.{c}") for c in others])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def row_of(docs: DataFrame, without: str | None = None) -> Column:
    """All columns of a row as one struct ``row``, so that working columns of any name cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != without]).alias("row")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
