from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fieldframe.llm import mixing
from fieldframe.llm.common import read
from fieldframe.llm.queries import QUERIES, SQL
from tests.llm.test_partenum import brute


def test_queries_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    with duckdb.connect() as con:
        for table in ("documents", "pages", "conversations"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        want = con.sql(SQL[name]).df()

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))

    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op11_whitening"}))
def test_query_has_a_row_for_each_input(spark, sf, name):
    table = "pages" if name.startswith("op1_") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    want = sorted(r[0] for r in read(spark, sf, table).select(key).collect())
    assert sorted(r[0] for r in QUERIES[name](spark, sf).select(key).collect()) == want


def test_stages_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    columns = docs.columns
    clean = corpus_pipeline.toxicity_filter(spark, docs, sf)
    assert clean.columns == columns
    rows = {r["doc_id"]: r for r in clean.collect()}
    distinct = {}
    for i, r in rows.items():
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        distinct[text] = max(i, distinct.get(text, i))
    kept = corpus_pipeline.exact_duplicates(spark, clean, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(distinct.values()) and kept.columns == columns
    found = brute([(i, rows[i]["text"]) for i in distinct.values()], corpus_pipeline.NEAR)
    near = corpus_pipeline.near_duplicates(spark, kept, sf)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, (_, c) in found.items() if i == c)
    mixed = corpus_pipeline.source_mix(spark, near, sf)
    planned = Counter(r["doc_id"] for r in mixing.plan(near, corpus_pipeline.MIX).collect())
    assert Counter(r["doc_id"] for r in mixed.collect()) == planned and set(planned) == {i for i, (_, c) in found.items() if i == c}
    whole = corpus_pipeline.run(spark, sf)
    assert Counter(r["doc_id"] for r in whole.select("doc_id").collect()) == planned
    assert whole.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_stages_on_an_empty_table(spark, sf, make):
    docs = make([])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        if name != "token_ids":
            assert out.columns == docs.columns


def test_stages_keep_columns_of_any_name_and_a_second_text(spark, sf, make):
    base = " ".join(f"a{i}" for i in range(60))
    docs = make([(1, base + " more"), (6, base), (6, "near to nothing at all"), (None, base)]).selectExpr("*", "1 AS `a.b`", "2 AS _toxicity", "3 AS score", "4 AS row", "5 AS _id")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", base + " more"), ("6", "near to nothing at all"), ("None", base)]
    clean = corpus_pipeline.toxicity_filter(spark, docs, sf)
    assert clean.columns == docs.columns and {r["_toxicity"] for r in clean.collect()} <= {2}
