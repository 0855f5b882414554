"""Text run files and result tables (SRC9-SRC13, SNK1-SNK13)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldframe.functions import constants as C
from fieldframe.operators import runs
from fieldframe.operators.blocks import running_sum

HISTOGRAM_SCHEMA = "bin int, p_left double, p_right double, weight double"
SUMMARY_REQUIRED = frozenset({"frame", "active", "total_frame_seconds", "total_elapsed_seconds"})


def read_histograms(spark: SparkSession, path: str, pattern: str = "momentum_histogram_*.csv") -> DataFrame:
    """Histogram files of many frames; the frame comes from the file name (SRC9)."""
    rows = (spark.read.schema(HISTOGRAM_SCHEMA).option("header", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).csv(path))
    frame = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{5})\.csv$", 1).cast("int")
    return rows.select(frame.alias("frame"), "bin", "p_left", "p_right", "weight")


def read_run_summary(spark: SparkSession, path: str, required: frozenset[str] = SUMMARY_REQUIRED) -> DataFrame:
    """Run summaries; missing columns are reported before any job over the data (SRC10)."""
    header = spark.read.option("header", True).csv(path)
    runs.require_columns(header, set(required), path)
    integers = {"frame", "stored", "active", "inactive", "max_split_level", "injected", "split", "skipped_split_capacity"}
    return header.select(*[F.col(f"`{c}`").cast("bigint" if c in integers and c != "frame" else
                                                "int" if c == "frame" else "double").alias(c)
                           for c in header.columns])


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of large log files as (path, line_no, value), splittable.

    ``line_no`` orders the lines of one file: the start of the split, then the position in it.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    order = F.struct(F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("path"), order.alias("line_no"), "value")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as (path, line_no, offset, value): their numbers from 0 and their first bytes in the file, splittable.

    Lines and bytes are summed along the splits of each file, so a file of any size is read by many tasks. Lines
    end with a line feed; a carriage return before it is dropped. Offsets hold for valid UTF-8.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    sized = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), F.lit(1).cast("long").alias("_one"),
        (F.octet_length("value") + 1).cast("long").alias("_bytes"), F.regexp_replace("value", "\r$", "").alias("value"))
    placed = running_sum(sized, ["path"], ["_start", "_row"], {"_lines": "_one", "_end": "_bytes"}, block=F.col("_start"))
    return placed.select("path", (F.col("_lines") - 1).alias("line_no"), (F.col("_end") - F.col("_bytes")).alias("offset"), "value")


def folder_name(path: str = "path") -> Column:
    """Name of the folder of a file path as the reader gives it; of a folder ``key=value`` the value."""
    name = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -2), "^[^=]*=", "")
    return F.url_decode(F.regexp_replace(name, r"\+", "%2B"))


def _of_cases(records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Records by folder instead of file: a case may have several files, the later name wins."""
    return (records.withColumn("case", folder_name()).groupBy("case", *keys)
            .agg(F.max_by(value, "path").alias(value)))


def read_step_log(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """Step seconds per file and frame (SRC11); a file set without any record is an error, found now.

    ``by_folder`` gives them per ``case``, the folder of the files; of files that a log was split into, the later name wins.
    """
    records = runs.parse_step_log(read_log_lines(spark, path), ["path"])
    if records.isEmpty():
        raise ValueError(f"no step record in {path}")
    return _of_cases(records, ["frame"], "frame_seconds") if by_folder else records


def read_counts(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """Particle counts per file, or per case, and frame (SRC12); each file begins with its header."""
    records = runs.parse_counts(read_numbered_lines(spark, path), ["path"])
    return _of_cases(records, ["frame"], "particle_count") if by_folder else records


def read_manifest(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """Manifest entries per file, or per case (SRC13)."""
    records = runs.parse_manifest(read_log_lines(spark, path), ["path"])
    return _of_cases(records, ["key"], "value") if by_folder else records


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric documents, one a file, as (path, json) for ``catalog.flatten_json`` (SRC14)."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths and lengths below a folder; the contents are not read (SRC15, SRC16)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(path))
    return files.select("path", "length")


def merge_results(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """Result files below a folder appended to one table, with the file name as ``group`` (SET3).

    A folder written with ``partitionBy`` gives its value; that of NULL gives NULL.
    """
    rows = spark.read.schema(schema).format(format).option("recursiveFileLookup", True).load(path)
    name = folder_name("_metadata.file_path")
    group = F.when(name != "__HIVE_DEFAULT_PARTITION__", F.regexp_replace(name, r"\.[^.]*$", ""))
    return rows.withColumn("group", group)


# -- sinks ---------------------------------------------------------------------------------------------

#: Files of different groups that a task writes at a time.
OPEN_FILES = 64


@contextmanager
def _open_files(spark: SparkSession, count: int) -> Iterator[None]:
    """Partitioned writes inside keep a file open for each group instead of sorting the rows of a task by group."""
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, count)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, overwrite: bool = False,
                format: str = "parquet") -> None:
    """Write a result table; earlier output is refused unless ``overwrite`` (SNK10).

    Partitioned output is rebalanced first: AQE merges small frames and splits large ones,
    so a frame with most of the rows is written by many tasks. AQE goes by compressed bytes, of which
    a task may hold many times as many rows; they are written as they come, not sorted by group.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode("overwrite" if overwrite else "errorifexists").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _open_files(df.sparkSession, OPEN_FILES):
        writer.save(path)


def write_run_summary(summary: DataFrame, path: str, overwrite: bool = False) -> None:
    """The 22-column run summary as CSV (SNK1)."""
    write_table(summary.select(*C.RUN_SUMMARY_COLUMNS), path, overwrite=overwrite, format="csv")


def write_histograms(hist: DataFrame, path: str, overwrite: bool = False, format: str = "csv") -> None:
    """Histograms with all bins, one folder per frame (SNK2)."""
    write_table(hist.select("frame", "bin", "p_left", "p_right", "weight"), path, ["frame"], overwrite, format)


def write_spectra(spectra: DataFrame, path: str, overwrite: bool = False) -> None:
    """Combined spectra of all cases, 11 columns (SNK3)."""
    columns = ["case", "frame", "p_left", "p_right", "p_center", "energy_left_kev", "energy_right_kev",
               "energy_center_kev", "weight", "dndlog10p", "dndlog10e"]
    write_table(spectra.select(*columns), path, overwrite=overwrite, format="csv")


def write_timing(timing: DataFrame, path: str, overwrite: bool = False) -> None:
    """Combined timing table, 6 columns (SNK4)."""
    columns = ["case", "frame", "physical_time_seconds", "particle_count", "frame_seconds", "elapsed_seconds"]
    write_table(timing.select(*columns), path, overwrite=overwrite, format="csv")


def write_text(df: DataFrame, path: str, case: str, order: list[str], text: str = "value") -> None:
    """Lines of each case in a folder ``case=<name>``, in order through its files.

    Rows are dealt by ranges of (case, order), so a long log becomes several files, named in order.
    """
    ranged = df.repartitionByRange(case, *order).sortWithinPartitions(case, *order)
    ranged.select(F.col(case).alias("case"), F.col(text).alias("value")).write.partitionBy("case").text(path)


def write_speed_accuracy(summary: DataFrame, path: str, overwrite: bool = False) -> None:
    """The tall speed and accuracy summary as CSV (SNK6)."""
    write_table(summary, path, overwrite=overwrite, format="csv")


def write_wide_spectrum(wide: DataFrame, path: str, overwrite: bool = False) -> None:
    """A wide spectrum with all its series as CSV (SNK7)."""
    write_table(wide, path, overwrite=overwrite, format="csv")


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Versions of a product that were written to the end."""
    try:
        names = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(f"{path}/manifest").inputFiles()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted({int(m[1]) for n in names if (m := re.search(r"/version=(\d+)/[^/]*\.parquet$", n))})


def write_product(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """One Parquet table per group of a product, by frame where it has one, and a manifest that lists them (SNK9).

    The manifest is one file and is written last; readers open only what it lists, so a product appears at once or not at
    all. An earlier product is refused unless ``overwrite``, which adds a version and leaves readers of the old one alone.
    """
    spark = next(iter(tables.values())).sparkSession
    versions = _manifests(spark, path)
    if versions and not overwrite:
        raise ValueError(f"{path} already holds a product")
    version = max(versions, default=-1) + 1
    for name, df in tables.items():
        write_table(df, f"{path}/groups/version={version}/{name}", ["frame"] if "frame" in df.columns else None, overwrite=True)
    listed = [(name, f"groups/version={version}/{name}", df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(listed, "name string, place string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def read_product(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The groups that the newest manifest of a product lists; a product without one is not finished."""
    versions = _manifests(spark, path)
    if not versions:
        raise ValueError(f"{path} holds no finished product")
    listed = spark.read.parquet(f"{path}/manifest/version={versions[-1]}").collect()
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{path}/{r['place']}") for r in listed}


def write_background_maps(maps: DataFrame, path: str, overwrite: bool = False) -> None:
    """Normalized density and temperature maps by frame (SNK13)."""
    write_table(maps, path, ["frame"], overwrite)


def write_movie_frames(index: DataFrame, path: str, overwrite: bool = False) -> None:
    """The per-frame movie index as CSV, in order of frames (SNK5)."""
    write_table(index, path, overwrite=overwrite, format="csv")


def write_particles(particles: DataFrame, path: str, overwrite: bool = False) -> None:
    """Analysis-ready particles: raw and derived columns by frame (SNK11)."""
    write_table(particles, path, ["frame"], overwrite)
