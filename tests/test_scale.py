"""Work of the file and stream queries is spread over tasks and bounded in each."""

import datetime
import glob
import json
import os
import subprocess
import sys

import pytest

from fieldframe.plans import sample_files as W
from fieldframe.plans import source_queries as Q
from fieldframe.streaming import frames as ST
from tests.test_sources import load, rows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def lines(spark, tmp_path, monkeypatch):
    """A table of several files; scratch folders get the names of their purposes."""
    monkeypatch.setattr(Q, "scratch_dir", lambda _, purpose: f"{tmp_path}/{purpose}")
    day = datetime.date(1995, 1, 1)
    made = [(k, "AN"[k % 2], day + datetime.timedelta(days=k % 90), 1.0e4 * (k % 7 + 1), 0.03) for k in range(3000)]
    table = spark.createDataFrame(made, "l_orderkey long, l_returnflag string, l_shipdate date, l_extendedprice double, l_discount double")
    table.repartition(6).write.parquet(f"{tmp_path}/sf/lineitem.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    yield f"{tmp_path}/sf"
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("late", [False, True])
def test_arrivals_are_written_by_all_tasks_and_read_in_three_batches(spark, tmp_path, lines, late):
    got = ST.merged_summary(Q._stream(spark, lines, ST.summary_partial, ST.merge_summary, late=late)).collect()
    counts = {len(glob.glob(f"{tmp_path}/stream-input/part={k}/*.parquet")) for k in range(3)}
    assert min(counts) > 1
    assert len(glob.glob(f"{tmp_path}/stream/ledger/batch=*")) == 3
    # one batch an arrival: each has a third of the rows
    stored = [sum(r["stored"] for r in spark.read.parquet(f"{tmp_path}/stream/data/version={k}").collect()) for k in range(3)]
    assert stored == [1000, 2000, 3000]
    assert sum(r["stored"] for r in got) == 3000 and sum(r["active"] for r in got) == 1500
    assert sum(r["weight_sum"] for r in got) == 4500.0


def test_small_pieces_grow_with_the_data(spark, tmp_path):
    W.put(f"{tmp_path}/particles_00001.bin", W.particle_bytes(rows(1000)))
    for k in range(2, 22):
        W.put(f"{tmp_path}/particles_{k:05d}.bin", W.particle_bytes(rows(30)))
    assert load(spark, tmp_path, targetBytes="500").rdd.getNumPartitions() > 200
    df = load(spark, tmp_path, targetBytes="500", pieces="8")
    assert df.rdd.getNumPartitions() <= 2 * 8
    assert df.count() == 1600 and df.filter("frame = 1").select("particle_id").distinct().count() == 1000
    # the target holds where it makes fewer
    assert load(spark, tmp_path, targetBytes="500000", pieces="8").rdd.getNumPartitions() == 1


_WRITE = """
import sys
from pyspark.sql import SparkSession, functions as F
from fieldframe.sources import tables as IO
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.buffer.pageSize", "1m")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
         .config("spark.eventLog.dir", "file://" + sys.argv[1] + "/events").getOrCreate())
before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
table = spark.range(1_500_000).select(F.when(F.col("id") % 500 == 0, "b").otherwise("a").alias("case"), (F.col("id") % 11).cast("double").alias("weight"))
IO.write_table(table, sys.argv[1] + "/out", ["case"])
assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
counted = spark.read.parquet(sys.argv[1] + "/out").groupBy("case").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in table.groupBy("case").agg(F.count("*"), F.sum("weight")).collect()}
spark.stop()
"""


def test_a_partitioned_write_does_not_hold_the_rows_of_a_task(tmp_path):
    """Rows that compress well lie in one task; sorted by group they took 56 bytes each."""
    os.makedirs(f"{tmp_path}/events")
    subprocess.run([sys.executable, "-c", _WRITE, str(tmp_path)], check=True, timeout=300, cwd=tmp_path, env=os.environ | {"PYTHONPATH": ROOT})
    (log,) = [f for f in glob.glob(f"{tmp_path}/events/*") if os.path.isfile(f)]
    ended = [e for e in map(json.loads, open(log)) if e["Event"] == "SparkListenerTaskEnd"]
    assert max(e["Task Metrics"]["Peak Execution Memory"] for e in ended) < 20e6
