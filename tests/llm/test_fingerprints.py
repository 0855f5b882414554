import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldframe.llm import fingerprints as fp

words = st.text(alphabet="ab\U0001d54f", max_size=40)


@settings(max_examples=60, deadline=None)
@given(words, words, st.integers(0, 40), st.integers(0, 40), st.integers(0, 40))
def test_spans_and_extensions_against_slices(a, b, i, j, n):
    i, j = min(i, len(a)), min(j, len(b))
    p, q = fp.Prefixes(a), fp.Prefixes(b)
    n = min(n, len(a) - i, len(b) - j)
    assert p.equal(i, q, j, n) == (a[i:i + n] == b[j:j + n])
    common = 0
    while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
        common += 1
    assert p.common_extension(i, q, j) == common


ROWS = [(5, "alpha beta gamma delta " * 9), (3, None), (9, "other words entirely, not the same " * 4), (4, "short"), (1, "é\U0001d54f" * 30_000), (7, ""), (2, "alpha beta gamma delta " * 9)]


def test_edits_against_brute_force(spark, make):
    got = {r["doc_id"]: r for r in fp.compare_edits(make(ROWS).repartition(4)).collect()}
    order = sorted(ROWS, key=lambda r: -r[0])
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        new = text[:len(text) - len(text) // 3] + after[:len(text) // 3]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (got[i]["edited_fingerprint"] == got[i]["fingerprint"]) == (new == text)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[5]["fingerprint"] == got[2]["fingerprint"] and got[3]["fingerprint"] == got[7]["fingerprint"]
    assert got[5]["near_edited"] > got[5]["near_next"]


def test_likeness_follows_the_share_of_common_spans():
    rng = np.random.default_rng(1)
    base = "".join(map(chr, rng.integers(97, 123, 8000)))
    for part in (0.2, 0.5, 0.9):
        other = base[: int(8000 * part)] + "".join(map(chr, rng.integers(97, 123, 8000 - int(8000 * part))))
        a, b = fp.Prefixes(base), fp.Prefixes(other)
        true = part / (2 - part)
        assert abs(fp.likeness(fp.sketch(a), fp.sketch(b)) - true) < 0.2


def test_repeated_null_and_single_rows(make):
    rows = [(1, "b"), (1, "a"), (1, "a"), (None, "n"), (None, None)]
    got = fp.compare_edits(make(rows)).collect()
    assert len(got) == 5 and sorted(r["n_chars"] for r in got) == [0, 1, 1, 1, 1]
    (one,) = fp.compare_edits(make([(8, "abcdef")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert fp.compare_edits(make([])).count() == 0
    assert [r["n_chars"] for r in fp.compare_edits(make([(None, "xy")])).collect()] == [2]


def test_extra_columns_with_names_of_results(make):
    plain = make([(i, "some words here " * i) for i in range(1, 9)])
    renamed = plain.withColumnRenamed("lang", "fingerprint").withColumnRenamed("source", "range").withColumnRenamed("n_chars", "ghost")
    rows = [{tuple(r) for r in fp.compare_edits(d).collect()} for d in (plain, renamed)]
    assert rows[0] == rows[1] and len(rows[0]) == 8
