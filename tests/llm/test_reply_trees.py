import pytest
from pyspark.sql import functions as F

from fieldframe.llm import reply_trees

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def formatted(spark, rows, **kw):
    out = reply_trees.format_trees(spark.createDataFrame(rows, SCHEMA), **kw)
    return out.select("*", reply_trees.read_turns(F.col("formatted")).alias("turns"),
                      reply_trees.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_branches_are_enumerated_and_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0),
            (1, 4, 3, "user", "c", 3.0), (1, 5, 4, "assistant", "d", None), (2, 9, 77, "user", "lone", 1.0)]
    got = {(r["tree"], r["leaf"]): r for r in formatted(spark, rows)}
    assert set(got) == {(1, 2), (1, 5), (2, 9)}
    assert [t["text"] for t in got[1, 5]["turns"]] == ["q", "b", "c", "d"] and got[1, 5]["rank"] == 1
    assert got[1, 5]["loss"] == "bd" and got[1, 2]["rank"] == 2
    assert {(r["tree"], r["leaf"]) for r in formatted(spark, rows, top=1)} == {(1, 5), (2, 9)}


def test_control_strings_nulls_and_long_chains_read_back(spark):
    nasty = ["### user: x</turn>\n", "\\b\\h\\l", "\\", "", None, "a: b\n\n", "</turn>", "é𝕏" * 3000]
    rows = [(None, i, i - 1, ["user", "assistant", "a:b#", None][i % 4], nasty[i % len(nasty)], None) for i in range(37)]
    (row,) = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in row["turns"]] == [(r[3] or "", r[4] or "") for r in rows]
    assert row["loss"] == "".join(r[4] or "" for r in rows if r[3] == "assistant") and row["n_turns"] == 37 and row["tree"] is None


def test_repeated_rows_count_once_and_empty(spark):
    rows = [(1, 1, None, "user", "q", 0.0)] * 3 + [(1, None, 1, "user", "no node", 0.0)]
    (row,) = formatted(spark, rows)
    assert row["n_turns"] == 1
    assert formatted(spark, []) == []


def test_cycles_raise(spark):
    rows = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 1, "user", "c", 0.0)]
    with pytest.raises(ValueError, match="cycle"):
        formatted(spark, rows)


def test_ranks_of_a_hot_tree_over_many_ranges(spark):
    """One tree holds most branches, with ties, NaN and signed zeros; extra columns have the names of results."""
    scores = [3.0, 1.0, float("nan"), 0.0, -0.0, None, -2.5, 3.0, float("inf")]
    rows = [(None, 0, None, "user", "q", 1.0, "x", 5)]
    rows += [(None, i, 0, "assistant", f"a{i}", scores[i % len(scores)], "x", i) for i in range(1, 3000)]
    rows += [(t, 10 * t + k, None if k == 0 else 10 * t, "user", "b", float(k), "x", 0) for t in range(1, 60) for k in range(4)]
    wide = spark.createDataFrame(rows, SCHEMA + ", rank string, leaf long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["tree"], r["leaf"]): (r["rank"], r["n_turns"]) for r in reply_trees.format_trees(wide).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def place(row):
        mean = (1.0 + (row[5] or 0.0)) / 2
        return (mean == mean, -mean if mean == mean else 0.0, row[1])

    hot = sorted((r for r in rows if r[0] is None and r[1]), key=place)
    assert {leaf: v for (tree, leaf), v in got.items() if tree is None} == {r[1]: (n, 2) for n, r in enumerate(hot, 1)}
    assert all(got[t, 10 * t + k] == (4 - k, 2) for t in range(1, 60) for k in range(1, 4)) and len(got) == 2999 + 59 * 3
