"""Whitening against a dense eigendecomposition, and its defined results on odd vectors."""

import numpy as np
import pytest

from messy_tables import SF_DIR
from kinetable.llm import whitening
from kinetable.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, row string, deviation int, x int"


def dense(vectors):
    """Exact deviations, and whitened values of the first eight components by a dense solver."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = n * x - s
    c = y / n
    values, turned = np.linalg.eigh(c.T @ c / n)
    values, turned = values[::-1][:8], turned[:, ::-1][:, :8]
    return (y.astype(object) ** 2).sum(1).tolist(), c @ turned / np.sqrt(values), values / (c ** 2).sum() * n


def compare(rows, ids, vectors):
    deviations, want, share = dense(vectors)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(ids) and len(rows) == len(ids) * want.shape[1]
    for i, d in zip(ids, deviations):
        assert {r.deviation for r in got[i].values()} == {d} and {r.n for r in got[i].values()} == {len(ids)}
    for k in range(want.shape[1]):
        mine = np.array([got[i][k + 1].whitened for i in ids])
        assert min(np.abs(mine - want[:, k]).max(), np.abs(mine + want[:, k]).max()) < 1e-9
        assert abs(got[ids[0]][k + 1].explained / share[k] - 1) < 1e-9
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query_equals_dense_solver(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    compare(QUERIES["op12_whitening"](spark, SF_DIR).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_flat_spectrum_doubles_the_block(spark, monkeypatch):
    """Eigenvalues closer than a few rounds can tell apart: the block grows until the vectors are certified."""
    monkeypatch.setattr(whitening, "ROUNDS", 1)
    monkeypatch.setattr(whitening, "BLOCK", 10)
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((300, 24)) * np.linspace(1.0, 1.2, 24)).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    model = whitening.fitted(df)
    assert model.residual < 1e-12
    compare(whitening.components(df, model).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect(),
            list(range(300)), vectors)


def test_filter_damps_the_unwanted_interval():
    v = np.diag(np.array([10.0, 9, 8, 4, 3, 2, 1]))
    x = np.eye(7)
    y = whitening._filtered(lambda q: v @ q, x, v @ x, 1.0, 4.0, 10.0).diagonal()
    assert y[0] == pytest.approx(1.0) and min(abs(y[:3])) > 100 * max(abs(y[3:]))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [rng.standard_normal(3).astype(np.float32).tolist() for _ in range(40)]
    rows = [(i, v, "r", 1, 2) for i, v in enumerate(good)]
    rows += [(100, None, None, None, None), (101, [1.0, None, 2.0], "", 1, 1), (102, [nan, 1.0, 1.0], "", 1, 1), (103, [1.0, -inf, 1.0], "", 1, 1)]
    rows += [(None, good[0], None, None, None), (0, good[0], "r", 1, 2), (104, [0.5], "", 1, 1), (105, [], "", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fitted(df)
    out = whitening.whitened(df, model)
    assert out.columns == ["row", "deviation", "whitened"] and out.schema["row"].dataType == df.select(*df.columns).schema
    got = out.select("row.vec_id", "deviation", "whitened").collect()
    filled = [*good, good[0], good[0], [0.5, 0, 0], [0, 0, 0]]
    assert sorted(map(str, (r.vec_id for r in got))) == sorted(map(str, [*range(40), None, 0, 104, 105]))
    deviations, want, _ = dense(filled)
    assert sorted(r.deviation for r in got) == sorted(deviations)
    assert sorted(r.deviation for r in got if r.vec_id in (0, None)) == [deviations[0]] * 3
    assert np.allclose(sorted(abs(r.whitened[0]) for r in got), sorted(abs(want[:, 0])))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0])] * 5])
def test_tables_without_variance_have_no_components(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = whitening.fitted(df)
    kept = [r for r in rows if r[1] is not None]
    assert [(r.deviation, r.whitened) for r in whitening.whitened(df, model).collect()] == [(0, [])] * len(kept)
    assert whitening.components(df, model).collect() == []


def test_huge_entries(spark):
    """Deviations beyond a long are null; nothing overflows on the way."""
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r[0]: r for r in whitening.whitened(df, whitening.fitted(df)).select("row.vec_id", "deviation", "whitened").collect()}
    assert got[1].deviation is None and got[2].deviation is None
    a, b = [(1 << 53) + 100_000, -(1 << 53) + 100_000, 3 * 1024 + 100_000], [100_000, 101_024, 102_048]
    exact = (3 * a[2] - sum(a)) ** 2 + (3 * b[2] - sum(b)) ** 2
    assert got[3].deviation == exact and all(np.isfinite(got[k].whitened).all() for k in got)
