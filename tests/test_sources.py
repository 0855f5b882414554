import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldframe.operators import quality
from fieldframe.plans import sample_files as W
from fieldframe.sources import tables as IO


def rows(n=10):
    k = np.arange(n)
    return pd.DataFrame({"particle_id": k + 5, "status": k % 3, "split_level": k % 2, "x": k * 1.0, "y": k * 2.0, "z": k * 3.0,
                         "p": k + 0.5, "mu": k / 10.0, "weight": np.ones(n)})


def load(spark, path, **options):
    return spark.read.format("particle_snapshot").options(**options).load(str(path))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("version,dim", [(2, 2), (3, 3), (4, 1), (4, 2)])
def test_particle_versions(spark, tmp_path, version, dim, order):
    W.put(f"{tmp_path}/particles_00007.bin", W.particle_bytes(rows(), version, dim, order))
    got = load(spark, tmp_path).orderBy("particle_id").collect()
    assert len(got) == 10
    r = got[4]
    assert (r["frame"], r["particle_id"], r["status"], r["version"]) == (7, 9, 1, version)
    assert (r["x"], r["y"], r["z"]) == (4.0, 8.0 if dim > 1 else 0.0, 12.0 if dim > 2 else 0.0)
    assert r["prev_x"] == 3.0 and r["p"] == 4.5
    assert (r["step_x"] is None) == (version == 2) and (r["px"] is None) == (version == 4)
    head = load(spark, tmp_path, what="header").first()
    assert (head["particle_count"], head["space_dim"], head["speed_of_light"]) == (10, dim, 2.0)
    assert head["header_bytes"] == (88 if version >= 3 else 64)
    if (version, dim) == (4, 2):
        assert head["record_bytes"] == 100
    assert quality.header_ranges(load(spark, tmp_path, what="header")).count() == 0


def test_large_files_are_split_and_small_ones_packed(spark, tmp_path):
    W.put(f"{tmp_path}/particles_00001.bin", W.particle_bytes(rows(1000)))
    for k in range(2, 22):
        W.put(f"{tmp_path}/particles_{k:05d}.bin", W.particle_bytes(rows(3)))
    df = load(spark, tmp_path, targetBytes="10000")
    assert df.rdd.getNumPartitions() == 11 + 1
    assert df.count() == 1060 and df.filter("frame = 1").select("particle_id").distinct().count() == 1000


def test_frames_are_pruned_before_files_are_opened(spark, tmp_path):
    W.put(f"{tmp_path}/particles_00001.bin", W.particle_bytes(rows()))
    W.put(f"{tmp_path}/particles_00002.bin", b"not a snapshot at all")
    assert load(spark, tmp_path).filter("frame = 1").count() == 10
    assert load(spark, tmp_path).filter("frame < 2 and weight > 0").count() == 10
    assert load(spark, tmp_path, endFrame="1").count() == 10
    with pytest.raises(Exception, match="magic"):
        load(spark, tmp_path).count()


@pytest.mark.parametrize("change,message", [
    (lambda b: b[:-5], "ends before"), (lambda b: b + b"x", "trailing"), (lambda b: b"BADMAGIC" + b[8:], "magic"),
    (lambda b: b[:8] + struct.pack("<I", 9) + b[12:], "version"), (lambda b: b[:12] + b"\0\0\0\0" + b[16:], "endian"),
    (lambda b: b[:88] + struct.pack("<Q", 2 ** 63) + b[96:], "2\\^63"), (lambda b: b[:16] + struct.pack("<i", 4) + b[20:], "dimension")])
def test_broken_snapshots(spark, tmp_path, change, message):
    W.put(f"{tmp_path}/particles_00001.bin", change(W.particle_bytes(rows())))
    with pytest.raises(Exception, match=message):
        load(spark, tmp_path).collect()


def test_empty_snapshot_and_bad_capacity(spark, tmp_path):
    W.put(f"{tmp_path}/particles_00001.bin", W.particle_bytes(rows(0)))
    assert load(spark, tmp_path).count() == 0
    W.put(f"{tmp_path}/particles_00002.bin", W.particle_bytes(rows(4), capacity=2))
    found = quality.header_ranges(load(spark, tmp_path, what="header")).collect()
    assert [r["check"] for r in found] == ["particle_capacity"]


def grid_rows(nx, ny):
    k = np.arange(nx * ny)
    base = pd.DataFrame({"ix": k % nx, "iy": k // nx})
    for j, c in enumerate(("bx", "by", "bz", "vx", "vy", "vz")):
        base[c] = k + 1000.0 * j
    return base


def test_compact_field(spark, tmp_path):
    content = W.compact_field_bytes(grid_rows(5, 4), np.linspace(0, 10, 6), np.linspace(0, 2, 5))
    W.put(f"{tmp_path}/field00012.bin", content)
    df = spark.read.format("compact_field").option("targetBytes", "400").load(str(tmp_path))
    got = df.orderBy("iy", "ix").collect()
    assert len(got) == 20 and df.rdd.getNumPartitions() > 1
    assert (got[7]["frame"], got[7]["ix"], got[7]["iy"], got[7]["x"], got[7]["y"], got[7]["vz"]) == (12, 2, 1, 5.0, 0.75, 5007.0)
    slim = spark.read.format("compact_field").schema("iy int, vy double").load(str(tmp_path))
    assert slim.agg(F.sum("vy")).first()[0] == sum(4000 + k for k in range(20))
    axes = spark.read.format("compact_field").option("what", "axes").load(str(tmp_path))
    assert axes.filter("axis = 'y'").count() == 4
    W.put(f"{tmp_path}/field00013.bin", content + b"\0")
    with pytest.raises(Exception, match="promises"):
        df.sparkSession.read.format("compact_field").load(str(tmp_path)).count()


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
def test_field_snapshot(spark, tmp_path, version, order):
    W.put(f"{tmp_path}/out00003.bin", W.field_snapshot_bytes(grid_rows(3, 4), 3, 4, version, order))
    df = spark.read.format("field_snapshot").option("targetBytes", "150").load(str(tmp_path))
    got = df.orderBy("iy", "ix").collect()
    assert len(got) == 12 and got[5]["v2"] == 1005.0 and (got[5]["ix"], got[5]["iy"], got[5]["x"]) == (2, 1, 2.0)
    assert got[0]["coordinate_scale_cgs"] == (2.0 if version == 2 else 1.0)
    header = spark.read.format("field_snapshot").option("what", "header").load(str(tmp_path))
    assert header.first()["field_name"] == "magnetic_field" and quality.field_header_ranges(header).count() == 0


def test_raw_frames_and_config(spark, tmp_path):
    W.put(f"{tmp_path}/data/mhd_00004.dat", W.mhd_raw_bytes(grid_rows(6, 5), 6, 5))
    reals = [0.5, 0.5, 1, 0, 0, 0, 3.0, 2.5, 1, 3, 2.5, 1, 0.1]
    W.put(f"{tmp_path}/config.dat", struct.pack("<13d13i", *reals, 6, 5, 1, 6, 5, 1, 1, 1, 1, 8, 0, 0, 0))
    df = spark.read.format("mhd_raw").option("config", f"{tmp_path}/config.dat").option("targetBytes", "1000").load(f"{tmp_path}/data")
    got = df.orderBy("iy", "ix").collect()
    assert len(got) == 30 and (got[8]["frame"], got[8]["bx"], got[8]["vx"], got[8]["x"], got[8]["y"]) == (4, 8.0, 3008.0, 1.25, 0.75)
    assert min(r["bz"] for r in got) == 2000.0


def test_step_log_and_counts(spark, tmp_path):
    (tmp_path / "run.log").write_text("start\n Step 1 takes 2.5 seconds\nnoise\nStep 2 takes 1e-1 seconds (ok)\nStep 1 takes 3.5 seconds\n")
    (tmp_path / "quick.dat").write_text("# iframe nptl\n 1   10.0  x\n\n2\t20.5\n")
    steps = {r["frame"]: r["frame_seconds"] for r in IO.read_step_log(spark, f"{tmp_path}/run.log").collect()}
    assert steps == {1: 3.5, 2: 0.1}
    counts = {r["frame"]: r["particle_count"] for r in IO.read_counts(spark, f"{tmp_path}/quick.dat").collect()}
    assert counts == {1: 10.0, 2: 20.5}
    (tmp_path / "bad.dat").write_text("no header\n1 2\n")
    with pytest.raises(Exception, match="invalid count line"):
        IO.read_counts(spark, f"{tmp_path}/bad.dat").collect()
    (tmp_path / "short.dat").write_text("iframe\n1\n")
    with pytest.raises(Exception, match="invalid count line"):
        IO.read_counts(spark, f"{tmp_path}/short.dat").collect()


def test_manifest_and_summary(spark, tmp_path):
    (tmp_path / "manifest.txt").write_text("a=1\nnote\n b = x=y \na=2\n")
    got = {r["key"]: r["value"] for r in IO.read_manifest(spark, f"{tmp_path}/manifest.txt").collect()}
    assert got == {"a": "2", "b": "x=y"}
    (tmp_path / "summary.csv").write_text("frame,active,total_frame_seconds\n1,2,3\n")
    with pytest.raises(ValueError, match="total_elapsed_seconds"):
        IO.read_run_summary(spark, f"{tmp_path}/summary.csv")


def test_existing_output_is_refused(spark, tmp_path):
    df = spark.range(3).withColumn("frame", F.lit(1))
    IO.write_table(df, f"{tmp_path}/t", ["frame"])
    with pytest.raises(Exception, match="(?i)already exists"):
        IO.write_table(df, f"{tmp_path}/t", ["frame"])
    IO.write_table(df.limit(1), f"{tmp_path}/t", ["frame"], overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1


def test_file_listing(spark, tmp_path):
    from fieldframe.operators import runs

    for name in ("particles_00003.bin", "particles_12.bin", "field00003.bin"):
        W.put(f"{tmp_path}/{name}", b"abc")
    files = IO.list_files(spark, str(tmp_path), "*.bin").withColumn("frame", runs.frame_number(F.col("path")))
    assert sorted((r["frame"], r["length"]) for r in files.collect() if r["frame"] is not None) == [(3, 3)]
    assert files.count() == 3


def test_step_log_without_records_raises(spark, tmp_path):
    (tmp_path / "empty.log").write_text("nothing here\n")
    with pytest.raises(ValueError, match="no step record"):
        IO.read_step_log(spark, f"{tmp_path}/empty.log")


def test_result_folders_of_any_name_are_merged(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1.0), ("X", 2.0), (None, 3.0)], "g string, weight double")
    IO.write_table(rows.withColumn("case", F.concat("g", F.lit(".res"))).select("case", "weight"), f"{tmp_path}/res", ["case"])
    merged = IO.merge_results(spark, f"{tmp_path}/res", "weight double")
    assert {(r["group"], r["weight"]) for r in merged.collect()} == {("A", 1.0), ("X", 2.0), (None, 3.0)}
