import hashlib

import pytest
from pyspark.sql import functions as F

from fieldframe.llm import common, exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


ROWS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 50_000), (8, "X" * 50_000), (9, "abc "), (None, "abc"), (None, "only")]


def test_groups_against_brute_force(make):
    got = exact_dedup.duplicate_groups(make(ROWS).repartition(3)).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(lower(t), []).append(i)
    for r in got:
        texts = [lower(t) for i, t in ROWS if i == r["doc_id"] and hashlib.sha256(lower(t).encode()).hexdigest() == r["text_sha256"]]
        ids = groups[texts[0]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(ids), r["doc_id"] == best)
    assert len(got) == len(ROWS)


def test_texts_that_share_a_digest_stay_apart(make):
    rows = [(i, "ab"[i % 2] * (i % 3 + 1)) for i in range(24)]
    weak = exact_dedup.duplicate_groups(make(rows), digest=lambda t: F.length(t).cast("string"), salts=2)
    strong = exact_dedup.duplicate_groups(make(rows))
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(tuple, weak.select(*columns).collect())) == sorted(map(tuple, strong.select(*columns).collect()))


def test_repeated_rows_keep_one_and_all_columns(make):
    docs = make([(1, "a"), (1, "a"), (2, "b"), (3, "B"), (1, "c")]).withColumn("_digest", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("a.b", F.lit(2)).withColumn("_i", F.lit(3))
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, "a"), (1, "c"), (3, "B")]
    flagged = exact_dedup.duplicate_groups(docs).collect()
    assert sum(r["kept"] for r in flagged) == 3


def test_empty_table(make):
    assert exact_dedup.duplicate_groups(make([])).count() == 0
    assert exact_dedup.deduplicate(make([])).count() == 0


@pytest.mark.parametrize("share", [1, 5, 20_000])
def test_hot_groups_and_others_meet_alike(make, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_GROUPS", share)
    rows = [(i, "hot") for i in range(40)] + [(None, "hot")] * 3 + [(39, "hot")] * 2 + [(100 + i, f"text {i % 7}") for i in range(20)]
    docs = make(rows).repartition(5)
    got = exact_dedup.duplicate_groups(docs).collect()
    best, sizes = {}, {}
    for i, t in rows:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
        sizes[t] = sizes.get(t, 0) + 1
    assert len(got) == len(rows)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in best}
    assert all((r["keep_id"], r["group_size"]) == (best[digest[r["text_sha256"]]], sizes[digest[r["text_sha256"]]]) for r in got)
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(best.values())
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.deduplicate(docs).collect()) == sorted((i, t) for t, i in best.items())
