import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldframe.llm import common, partenum
from fieldframe.llm.partenum import Join


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return ({tuple(words[j:j + width]) for j in range(len(words) - width + 1)} or {tuple(words)}) if words else set()


def brute(rows, join):
    sets = {i: shingles(t, join.width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a and b and both * join.over >= (len(a) + len(b) - both) * join.under:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for size in (3, 8, 12, 40, 150, 600):
        base = [f"w{rng.randrange(10**5)}" for _ in range(size)]
        rows += [edited(base, rng.randrange(0, max(2, size // 15)), rng) for _ in range(12)]
        chain = base
        for _ in range(8):
            chain = edited(chain, max(1, size // 40), rng)
            rows.append(chain)
    # a passage that many documents share, with little else
    rows += [passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 60))] for _ in range(60)]
    texts = [" ".join(r) for r in rows] + ["", None, " \n\t", "One", "one", "TWO words", "two  words", "two words three"]
    rng.shuffle(texts)
    return list(enumerate(texts, start=5))


@pytest.mark.parametrize("join", [Join(3, 90, 100), Join(5, 80, 100, 2), Join(1, 50, 100, 4)])
def test_components_against_all_pairs(make, join):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(make(rows).repartition(5), join=join).collect()}
    assert got == brute(rows, join)


def test_large_buckets_are_cut_into_blocks(make, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 7)
    rows = corpus(2)
    join = Join(5, 80, 100, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(make(rows), join=join).collect()}
    assert got == brute(rows, join)


def test_copies_of_a_set_join_their_class_alike(make, monkeypatch):
    monkeypatch.setattr(common, "HOT_GROUPS", 8)
    rows = corpus(3)
    rows += [(1000 + i, "a set with many copies") for i in range(120)] + [(2000 + i, f"few copies of {i % 6}") for i in range(18)]
    join = Join(3, 90, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(make(rows).repartition(4), join=join).collect()}
    assert got == brute(rows, join)


@pytest.mark.parametrize("join", [Join(3, 90, 100), Join(5, 80, 100, 2)])
def test_similar_sets_share_a_signature(join):
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(2, 900))
        a = rng.integers(0, 1 << 63, n, np.uint64)
        common = rng.integers(0, n // 8 + 1)
        b = np.concatenate([a[common:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1)), np.uint64)])
        a, b = np.unique(a), np.unique(b)
        inter = len(np.intersect1d(a, b))
        if inter * join.over >= join.under * (len(a) + len(b) - inter):
            sa, sb = ({int(s) for band in join.of(len(x)) for s in partenum.signatures(x, band)} for x in (a, b))
            assert sa & sb


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    band = Join(3, 90, 100).of(300)[0]
    for extra in (0, 5, 50):
        a = np.unique(rng.integers(0, 1 << 63, 300, np.uint64))
        b = np.union1d(a, rng.integers(0, 1 << 63, extra, np.uint64))
        apart = int(np.bitwise_count(partenum.sketch(a, band).view(np.uint64) ^ partenum.sketch(b, band).view(np.uint64)).sum())
        assert apart <= len(b) - len(a)


def test_long_texts_are_hashed_alike_in_any_slice(monkeypatch):
    texts = ["a b c d e f g " * 3000, "", "x", "Long Word " + "y" * 9000, "a b c d e f g " * 3000]
    whole = [s.tolist() for s in partenum.shingle_sets(texts, 3)]
    monkeypatch.setattr(partenum, "SLICE_BYTES", 10)
    assert [s.tolist() for s in partenum.shingle_sets(texts, 3)] == whole and whole[0] == whole[4]
    assert [len(s) for s in whole] == [len(shingles(t, 3)) for t in texts]


def test_null_ids_repeated_rows_extra_columns_and_empty(make):
    docs = make([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A B C"), (2, "other text here"), (3, "")]).withColumnRenamed("lang", "rep").withColumnRenamed("source", "sig")
    got = partenum.jaccard_components(docs, join=Join(3, 90, 100)).collect()
    assert len(got) == 6 and Counter(r["component_id"] for r in got if r["doc_id"] is None) == {None: 1}
    assert {r["component_id"] for r in got if r["doc_id"] == 1} == {1} and [r["n_shingles"] for r in got if r["doc_id"] == 3] == [0]
    assert partenum.jaccard_components(make([])).count() == 0


def brute_rows(rows, join):
    """Components of ids whose rows are linked or shared."""
    numbered = brute([(n, t) for n, (_, t) in enumerate(rows)], join)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, _) in enumerate(rows):
        x, y = find(i), find(rows[numbered[n][1]][0])
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def two_texts():
    one, two = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    return [(5, one), (5, two), (6, two), (7, two + " end"), (8, one + " end"), (9, "far from all else here"), (9, "and this too is alone"),
            (10, "far from ALL else here"), (2, None), (2, ""), (11, one.upper()), (11, "")]


@pytest.mark.parametrize("shift", [0, (1 << 63) - 12, -(1 << 63)])
def test_an_id_with_several_texts_has_the_links_of_all(make, shift):
    rows = [(i + shift, t) for i, t in two_texts()]
    join = Join(3, 80, 100)
    for parts in (1, 4):
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(make(rows).repartition(parts), join=join).collect()]
        want = brute_rows(rows, join)
        assert sorted(got) == sorted((i, len(shingles(t, 3)), want[i]) for i, t in rows)


def test_near_duplicates_go_by_id_and_text(make):
    base = " ".join(f"a{i}" for i in range(60))
    rows = [(1, base + " more"), (6, base), (6, "near to nothing at all"), (7, "plain other text of some words")]
    gone = sorted((r["id"], r["digest"]) for r in partenum.near_duplicates(make(rows), join=Join(3, 80, 100)).collect())
    assert gone == [(6, hashlib.sha256(base.encode()).hexdigest())]
    rows = [(1, base + " more"), (6, base), (7, "plain other text of some words")]
    assert [tuple(r) for r in partenum.near_duplicates(make(rows), join=Join(3, 80, 100)).collect()] == [(6, None)]
    # two near texts of the smallest id: one stays
    rows = [(1, base + " more"), (1, base), (6, base + " else")]
    gone = [tuple(r) for r in partenum.near_duplicates(make(rows), join=Join(3, 80, 100)).collect()]
    assert len(gone) == 2 and [i for i, _ in gone].count(6) == 1


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 199)]
    got = {r["node"]: r["component"] for r in partenum.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {199: 199, 200: 199}
    assert got == want
