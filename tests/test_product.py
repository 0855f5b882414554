import pytest
from pyspark.sql import functions as F

from fieldframe.sources import tables as IO


def test_a_product_appears_with_its_manifest(spark, tmp_path):
    path = f"{tmp_path}/p"
    cells = spark.range(6).select((F.col("id") % 2).cast("int").alias("frame"), "id")
    with pytest.raises(ValueError):
        IO.read_product(spark, path)
    IO.write_product({"cells": cells, "meta": spark.range(1)}, path)
    assert {k: v.count() for k, v in IO.read_product(spark, path).items()} == {"cells": 6, "meta": 1}
    with pytest.raises(ValueError):
        IO.write_product({"cells": cells}, path)
    # groups without a manifest are no product yet; the next version replaces them
    cells.limit(1).write.parquet(f"{path}/groups/version=1/cells")
    assert IO.read_product(spark, path)["cells"].count() == 6
    IO.write_product({"cells": cells.filter("id > 3")}, path, overwrite=True)
    again = IO.read_product(spark, path)
    assert set(again) == {"cells"} and sorted(map(tuple, again["cells"].select("frame", "id").collect())) == [(0, 4), (1, 5)]


def test_numbered_lines_across_splits(spark, tmp_path):
    texts = {"a.txt": "one\r\ntwo\nünï\n\nlast", "b.txt": "".join(f"line {i} {'x' * (i % 40)}\n" for i in range(3000))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = IO.read_numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        got = sorted((r["line_no"], r["offset"], r["value"]) for r in rows if r["path"].endswith(name))
        want, at = [], 0
        for n, line in enumerate(text.encode().split(b"\n")):
            if n or line:
                want.append((n, at, line.decode().rstrip("\r")))
            at += len(line) + 1
        assert got == [w for w in want if w[1] < len(text.encode())]


def test_cases_with_several_files(spark, tmp_path):
    for name, text in {"case=b+c d/part-1.txt": "Step 1 takes 2.0 seconds\nStep 2 takes 3.0 seconds", "case=b+c d/part-2.txt": "Step 2 takes 4.0 seconds"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r["case"], r["frame"]): r["frame_seconds"] for r in IO.read_step_log(spark, str(tmp_path), by_folder=True).collect()}
    assert got == {("b+c d", 1): 2.0, ("b+c d", 2): 4.0}
