from pyspark.sql import functions as F

from fieldframe.operators import layout


def test_curve_interleaves_bits(spark):
    cells = [(0, 0), (1, 0), (0, 1), (5, 9), (2**31 - 1, 0), (0, 2**31 - 1), (12345, 54321)]
    rows = spark.createDataFrame(cells, "ix int, iy int").select("ix", "iy", layout.curve_position(F.col("ix"), F.col("iy")).alias("c")).collect()
    for r in rows:
        assert r["c"] == sum((r["ix"] >> k & 1) << 2 * k | (r["iy"] >> k & 1) << 2 * k + 1 for k in range(31))


def test_box_opens_few_files(spark, tmp_path):
    rows = spark.range(8000).select((F.col("id") % 2).cast("int").alias("frame"), (F.col("id") % 64).cast("int").alias("ix"),
                                    (F.floor(F.col("id") / 64) % 64).cast("int").alias("iy"), "id")
    path = str(tmp_path)
    layout.write_cells(rows, path, files=32)
    box = {"frame": (1, 1), "ix": (8, 15), "iy": (16, 23)}
    assert 0 < layout.files_of_box(spark, path, box).count() <= 6 < spark.read.parquet(f"{path}/files").count()
    got = layout.read_box(spark, path, box)
    assert len(got.inputFiles()) <= 6
    want = rows.filter("frame = 1 AND ix BETWEEN 8 AND 15 AND iy BETWEEN 16 AND 23")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert layout.read_box(spark, path, {"frame": (7, 9)}).count() == 0
