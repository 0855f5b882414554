from pyspark.sql import functions as F

from fieldframe.streaming import store
from fieldframe.streaming.store import FrameStore


def merge(rows):
    return rows.groupBy("frame").agg(F.sum("n").alias("n"))


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "frame int, n long")


def held(found):
    return {r["frame"]: r["n"] for r in found.read().collect()}


def test_batches_touch_only_their_frames(spark, tmp_path):
    found = FrameStore(spark, str(tmp_path), merge)
    assert found.read() is None and found.ledger() is None
    found.apply(batch(spark, (1, 5), (2, 7), (None, 1)), 0)
    found.apply(batch(spark, (2, 1), (3, 1)), 1)
    found.apply(batch(spark), 2)
    assert held(found) == {1: 5, 2: 8, 3: 1, None: 1}
    assert {r["frame"]: r["version"] for r in found.ledger().collect()} == {1: 0, None: 0, 2: 1, 3: 1}
    # a repeated batch starts from the state before it
    found.apply(batch(spark, (2, 2), (None, 4)), 3)
    found.apply(batch(spark, (2, 2), (None, 4)), 3)
    assert held(found) == {1: 5, 2: 10, 3: 1, None: 5}


def test_an_unfinished_batch_is_not_seen(spark, tmp_path):
    found = FrameStore(spark, str(tmp_path), merge)
    found.apply(batch(spark, (1, 5)), 0)
    batch(spark, (1, 99)).write.parquet(f"{tmp_path}/data/version=1")
    assert held(found) == {1: 5}
    found.apply(batch(spark, (1, 1)), 1)
    assert held(found) == {1: 6}


def test_read_cost_does_not_grow_with_age(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMPACT", 3)
    found = FrameStore(spark, str(tmp_path), merge)
    for k in range(8):
        found.apply(batch(spark, (k, 1), (100, 1)), k)
        assert found.ledger().select("version").distinct().count() <= 3
        assert held(found) == {**{i: 1 for i in range(k + 1)}, 100: k + 1}
    assert all(int(f.split("version=")[1].split("/")[0]) >= 5 for f in found.read().inputFiles() if "/data/" in f)
