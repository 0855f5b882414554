import base64
import gzip
import hashlib
import io
import json

import pytest

from fieldframe.llm import warc
from fieldframe.llm.common import shared_folder

SCHEMA = "page_id long, url string, html string, payload string"


def round_trip(spark, rows, **kw):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    raw, tidy = shared_folder(spark, "raw"), shared_folder(spark, "tidy")
    files = warc.write_archives(warc.choose_records(pages, **kw), raw)
    assert warc.normalise(files, raw, tidy) == len(rows)
    return warc.read_records(spark, tidy).collect()


def test_round_trip_with_revisits(spark):
    rows = [(1, "http://a", "<p>x</p>", "c"), (2, "http://b\r\nX: y", "<p>x</p>", None), (3, None, None, None), (4, "u", "", None), (5, "u", "é" * 40_000, None), (-6, "u", "WARC/1.1\r\n\r\n", None)]
    got = {int(r["record_id"].split(":")[-1][:-1]): r for r in round_trip(spark, rows)}
    for i, _, html, _ in rows:
        body = (html or "").encode()
        assert got[i]["payload_bytes"] == len(body)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        same = max(j for j, _, h, _ in rows if (h or "") == (html or ""))
        assert got[i]["record_type"] == ("response" if same == i else "revisit")
        assert (got[i]["refers_to"] or "").endswith(f":{same}>") is (same != i)
        assert got[i]["payload"] == (body if same == i else b"")


def test_small_payloads_repeated_rows_and_null_ids_are_responses(spark):
    rows = [(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abcd", None), (4, "u", "abcd", None), (4, "u", "abcd", None), (None, "u", "abcd", None)]
    got = round_trip(spark, rows, min_revisit_bytes=3)
    assert sorted(r["record_type"] for r in got) == ["response"] * 5 + ["revisit"]


def test_empty_table(spark):
    raw, tidy = shared_folder(spark, "raw"), shared_folder(spark, "tidy")
    files = warc.write_archives(warc.choose_records(spark.createDataFrame([], SCHEMA)), raw)
    assert warc.normalise(files, raw, tidy) == 0


def records(n):
    return [warc.page_record(i, f"http://x/{i}", bytes([i]) * (i * 9000), i * 9000, "D" * 32, None) for i in range(n)]


@pytest.mark.parametrize("members", [1, 3])
def test_each_record_becomes_a_member(members):
    parts = records(12)
    source = b"".join(gzip.compress(b"".join(parts[i::members])) for i in range(members))
    target, index = io.BytesIO(), []
    assert warc.normalise_file(io.BytesIO(source), target, index.append) == 12
    data = target.getvalue()
    plain = [gzip.decompress(data[e["offset"]:e["offset"] + e["length"]]) for e in index]
    assert plain == [p for i in range(members) for p in parts[i::members]]
    assert sum(e["length"] for e in index) == len(data)
    again, second = io.BytesIO(), []
    warc.normalise_file(io.BytesIO(data), again, second.append)
    assert [json.dumps(e) for e in second] == [json.dumps(e) for e in index]


def test_a_cut_record_raises():
    data = b"".join(records(3))[:-9100]
    with pytest.raises(ValueError, match="cut off"):
        warc.normalise_file(io.BytesIO(gzip.compress(data)), io.BytesIO(), lambda e: None)


def test_each_slice_is_a_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_SLICE", 2_000)
    pages = spark.createDataFrame([(i, "u", f"{i} " * (i % 5), None) for i in range(40)], SCHEMA).coalesce(1)
    raw, tidy = shared_folder(spark, "raw"), shared_folder(spark, "tidy")
    warc.normalise(warc.write_archives(warc.choose_records(pages), raw), raw, tidy)
    slices = warc.read_index(spark, tidy).selectExpr("file", "offset div 2000").distinct().count()
    out = warc.read_records(spark, tidy)
    assert out.rdd.getNumPartitions() == slices > 3
    assert sorted(int(r["record_id"].split(":")[-1][:-1]) for r in out.collect()) == list(range(40))


def test_a_file_published_again_replaces_the_earlier_one(tmp_path):
    store = warc.pafs.LocalFileSystem()
    for body in ("first", "second"):
        (tmp_path / "part").write_text(body)
        warc._publish(store, str(tmp_path / "part"), str(tmp_path / "final"))
    assert (tmp_path / "final").read_text() == "second" and not (tmp_path / "part").exists()
