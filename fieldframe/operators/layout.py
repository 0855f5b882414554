"""Particles laid out by cell along a space-filling curve, with statistics by which readers skip files (SRT1).

A folder holds ``rows`` (Parquet, in the order of frame and curve) and ``files``, one row a file with the ranges of its
frames and cells. The curve keeps neighbouring cells in few files, so a box of cells needs few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.operators.blocks import BLOCK_WIDTH

#: Files that a reader names one by one; a box that touches more is read by the row group statistics of all files.
NAMED_FILES = 20_000


def curve_position(ix: Column, iy: Column) -> Column:
    """Position of a cell on the Z curve: the bits of both indices (0 to 2^31 - 1) in turn."""
    def spread(index: Column) -> Column:
        bits = index.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return bits
    return spread(ix).bitwiseOR(F.shiftleft(spread(iy), 1))


def write_cells(rows: DataFrame, path: str, files: int | None = None, frame: str = "frame", ix: str = "ix", iy: str = "iy") -> None:
    """Write rows by (frame, curve) and the statistics of each file.

    ``files`` defaults to one for about ``BLOCK_WIDTH`` rows. A cell with many rows spreads over files.
    """
    spark = rows.sparkSession
    files = files or max(1, -(-rows.count() // BLOCK_WIDTH))
    placed = rows.withColumns({"_curve": curve_position(F.col(ix), F.col(iy)), "_tie": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(files, frame, "_curve", "_tie").sortWithinPartitions(frame, "_curve").drop("_curve", "_tie")
    ordered.write.parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    ranges = [f(c).alias(f"{n}_{c}") for c in (frame, ix, iy) for n, f in (("min", F.min), ("max", F.max))]
    (stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(*ranges, F.count(F.lit(1)).alias("rows"))
     .coalesce(1).write.parquet(f"{path}/files"))


def files_of_box(spark: SparkSession, path: str, box: dict[str, tuple[int, int]]) -> DataFrame:
    """The files whose ranges meet a box, column -> (first, last), both included."""
    found = spark.read.parquet(f"{path}/files")
    for column, (first, last) in box.items():
        found = found.filter((F.col(f"min_{column}") <= last) & (F.col(f"max_{column}") >= first))
    return found


def read_box(spark: SparkSession, path: str, box: dict[str, tuple[int, int]]) -> DataFrame:
    """The rows of a box; files that cannot hold any are not opened."""
    schema = spark.read.parquet(f"{path}/rows").schema
    names = [r["file"] for r in files_of_box(spark, path, box).select("file").limit(NAMED_FILES + 1).collect()]
    if not names:
        return spark.createDataFrame([], schema)
    places = [f"{path}/rows/{n}" for n in names] if len(names) <= NAMED_FILES else [f"{path}/rows"]
    rows = spark.read.schema(schema).parquet(*places)
    for column, (first, last) in box.items():
        rows = rows.filter(F.col(column).between(first, last))
    return rows
