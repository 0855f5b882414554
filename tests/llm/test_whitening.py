import math

import numpy as np
import pytest

from fieldframe.llm import whitening
from fieldframe.llm.queries import QUERIES
from fieldframe.llm import vector_queries  # noqa: F401

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, components):
    """Rows by id: exact deviations, whitened values with the sign of the first row's, explained shares."""
    kept = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    centred = x - s / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return [i for i, _ in kept], n, deviation, centred @ v / np.sqrt(e), e / np.trace(cov)


def check(rows, vectors, components):
    ids, n, deviation, whitened, explained = brute(vectors, components)
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted((str(i), k + 1) for i in ids for k in range(len(explained)))
    for k in range(len(explained)):
        of = sorted((r for r in rows if r["component"] == k + 1), key=lambda r: (str(r["vec_id"]), r["deviation"]))
        order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), deviation[i]))
        assert [int(r["deviation"]) for r in of] == [deviation[i] for i in order] and {r["n"] for r in of} == {n}
        got, want = np.array([r["whitened"] for r in of]), whitened[order, k]
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert abs(of[0]["explained"] / explained[k] - 1) < 1e-9
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-8


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 8 * 9 * 8, "TASK_BYTES": 400, "BLOCK_COLUMNS": 3, "GROUP_BLOCKS": 8}])
def test_equals_numpy(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(whitening, name, value)
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(90, 7)) @ rng.normal(size=(7, 7)) * 0.2).astype(np.float32).tolist()
    rows = [(i, v, None) for i, v in enumerate(base)]
    rows += [(5, base[5], 1), (None, base[6], 1), (100, None, 1), (101, [None] + base[0][1:], 1), (102, [float("nan")] + base[0][1:], 1),
             (103, base[0][1:] + [float("inf")], 1), (104, [], 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "2 AS component", "3 AS `a.b`").repartition(3)
    out = whitening.whiten(docs, components=4)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), [(r[0], r[1]) for r in rows], 4)


def test_no_variance_and_empty(spark):
    out = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in out) == [
        (i, k, 0, 0.0, 0.0, 0.0) for i in (1, 2) for k in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.75, 1.5], 0)], SCHEMA)).collect()
    assert sorted((r["vec_id"], round(abs(r["whitened"]), 9)) for r in line if r["component"] == 1) == [(1, 1.0), (2, 1.0)]
    assert [r["whitened"] for r in line if r["component"] == 2] == [0.0, 0.0]
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.5], 0)], SCHEMA))


def test_large_deviations_are_exact(spark):
    rows = [(i, [float(2**30 * (i % 3)), float(i)], 0) for i in range(50)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA), components=1).collect()
    check(out, [r[:2] for r in rows], 1)
    assert max(int(r["deviation"]) for r in out) > 2**63


def test_query_on_the_table(spark, sf):
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op11_whitening"](spark, sf).collect(), vectors, 8)
