import math
from collections import Counter

from fieldframe.llm import mixing


def corpus(make, counts):
    rows, i = [], 0
    for source, (docs, words) in counts.items():
        for _ in range(docs):
            rows.append((i, " ".join(["w"] * words), None, source, 0))
            i += 1
    return make(rows)


def test_repetition_limit_and_entropy(make):
    docs = corpus(make, {"big": (400, 10), "mid": (60, 10), "low": (20, 10)})
    mix = mixing.Mix(entropy=0.99, repeats=3.0, block_tokens=500)
    got = mixing.plan(docs, mix).collect()
    per = Counter(r["source"] for r in got)
    assert per["big"] == 400 and 59 <= per["low"] <= 60 and 60 < per["mid"] < 180
    assert {r["doc_id"] for r in got} == set(range(480))
    loose = mixing.plan(docs, mixing.Mix(entropy=0.9, repeats=1e9)).collect()
    n = len(loose)
    share = [c / n for c in Counter(r["source"] for r in loose).values()]
    assert abs(-sum(s * math.log(s) for s in share) / math.log(3) - 0.9) < 0.01


def test_blocks_hold_every_source_in_its_weight(make):
    docs = corpus(make, {"a": (600, 5), "b": (200, 5)})
    got = mixing.plan(docs, mixing.Mix(entropy=0.0, repeats=1.0, block_tokens=400)).collect()
    blocks = {}
    for r in got:
        blocks.setdefault(r["block"], []).append(r)
    assert len(blocks) == 10
    for rows in blocks.values():
        assert Counter(r["source"] for r in rows) == {"a": 60, "b": 20}
        assert sorted(r["position"] for r in rows) == list(range(1, 81))


def test_budget_is_kept_and_repeat_agrees_with_plan(make):
    docs = corpus(make, {"a": (300, 7), "b": (50, 7)}).union(make([(900, None, None, None, 0), (901, "", None, "void", 0), (902, "x y z", None, None, 0)]))
    for mix in (mixing.Mix(budget=1500, repeats=2.0), mixing.Mix(repeats=2.0)):
        planned = Counter(r["doc_id"] for r in mixing.plan(docs, mix).collect())
        wide = docs.withColumnRenamed("lang", "_key").withColumnRenamed("n_chars", "_copies")
        repeated = mixing.repeat(wide, mix)
        assert repeated.columns == wide.columns
        assert Counter(r["doc_id"] for r in repeated.collect()) == planned
        if mix.budget:
            assert sum(r["n_tokens"] for r in mixing.plan(docs, mix).collect()) <= 1500 + 2


def test_repeated_rows_null_ids_and_empty(make):
    docs = make([(1, "a b", None, "s", 0)] * 3 + [(None, "c", None, "s", 0), (2, "d", None, "t", 0)])
    assert sum(Counter(r["doc_id"] for r in mixing.plan(docs).collect()).values()) >= 5
    assert mixing.plan(make([])).count() == 0 and mixing.repeat(make([])).count() == 0


def test_a_long_document_does_not_cost_the_quota(make):
    """200 documents of one word and one of 700, wherever it comes: the quota is met within half of it."""
    rows = [(i, "w", None, "mixed", 0) for i in range(200)] + [(900, "w " * 700, None, "mixed", 0)] + [(1000 + i, "w " * 10, None, "big", 0) for i in range(158)]
    for seed in range(4):
        mix = mixing.Mix(entropy=1.0, repeats=2.0, seed=str(seed))
        got = mixing.plan(make(rows), mix).collect()
        told = {r["source"]: r for r in mixing.report(make(rows), mix).collect()}
        for source, r in told.items():
            realised = sum(g["n_tokens"] for g in got if g["source"] == source)
            assert realised == r["realised"] and abs(realised - r["quota"]) <= 350 and abs(r["realised_weight"] - r["weight"]) < 0.12
        assert Counter(g["doc_id"] for g in got) == Counter(r["doc_id"] for r in mixing.repeat(make(rows), mix).collect())
