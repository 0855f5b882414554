"""Roll-up of the run files of many cases into one timing table and one table of spectra (SET1, SNK3, SNK4).

A case has a folder ``case=<name>`` under ``steps``, ``counts`` and ``spectra``. What is absent is found by one listing and
returned with the result; nothing is opened to find out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.operators import binning, runs
from fieldframe.session import materialize
from fieldframe.sources import tables as IO


def absent_files(spark: SparkSession, root: str, cases: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """(case, kind) of wanted cases that have no file of a kind."""
    files = IO.list_files(spark, root)
    kind = F.element_at(F.split("path", "/"), F.lit(-3))
    # a table that is itself cut by frame has one folder more
    deep = F.element_at(F.split("path", "/"), F.lit(-4))
    name = F.element_at(F.split("path", "/"), F.when(kind.startswith("case="), -3).otherwise(-2))
    case = F.url_decode(F.regexp_replace(F.regexp_replace(name, "^case=", ""), r"\\+", "%2B"))
    found = files.filter("length > 0").select(case.alias("case"), F.when(kind.startswith("case="), deep).otherwise(kind).alias("kind")).distinct()
    wanted = spark.createDataFrame([(c, k) for c in cases for k in kinds], "case string, kind string")
    return materialize(wanted.join(found, ["case", "kind"], "left_anti"), "absent-files")


def _complete(absent: DataFrame, cases: list[str], root: str) -> list[str]:
    gone = {r["case"] for r in absent.collect()}
    left = [c for c in cases if c not in gone]
    if not left:
        raise ValueError(f"no case below {root} is complete")
    return left


def rollup_timing(spark: SparkSession, root: str, cases: list[str], interval_seconds: float, out: str) -> DataFrame:
    """Write the timing table of all complete cases to ``out`` and return the absent (case, kind).

    Step logs and particle counts are joined by frame; a frame without a count raises.
    """
    absent = absent_files(spark, root, cases, ("steps", "counts"))
    here = F.col("case").isin(_complete(absent, cases, root))
    steps = IO.read_step_log(spark, f"{root}/steps", by_folder=True).filter(here)
    counts = IO.read_counts(spark, f"{root}/counts", by_folder=True).filter(here)
    joined = materialize(runs.join_counts(steps, counts, ["case"]), "case-steps")
    IO.write_timing(runs.timing_table(runs.running_elapsed(joined, ["case"]), interval_seconds), out)
    return absent


def rollup_spectra(spark: SparkSession, root: str, cases: list[str], out: str) -> DataFrame:
    """Write the spectra of all present cases to ``out`` and return the absent (case, kind)."""
    absent = absent_files(spark, root, cases, ("spectra",))
    here = F.col("case").isin(_complete(absent, cases, root))
    hist = (spark.read.schema(f"{IO.HISTOGRAM_SCHEMA}, case string, frame int").option("header", True)
            .csv(f"{root}/spectra").filter(here))
    IO.write_spectra(binning.spectrum_columns(hist), out)
    return absent
