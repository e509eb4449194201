"""Whitening against a dense eigensolver, and its solver on hard spectra."""

import numpy as np
import pytest

from modelloom.llm.queries import QUERIES
from modelloom.llm.whitening import leading_eigenpairs, whiten
from tests.conftest import DATA


@pytest.mark.parametrize(
    "spectrum",
    [
        1 + np.arange(64) / 64,
        1.5 ** -np.arange(64.0),
        np.r_[np.ones(20) + 1e-6 * np.arange(20), np.linspace(0.1, 0.9, 200)],
        np.r_[3, 2, np.zeros(40)],
        np.ones(100),
        np.array([1.0]),
        np.array([5.0, 5.0, 1.0]),
    ],
)
def test_solver_reaches_double_precision(spectrum):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((d, d)))[0]
    matrix = (q * spectrum * 1e5) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = leading_eigenpairs(lambda block: matrix @ block, d, 8)
    exact = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    assert len(values) == min(8, d)
    assert np.abs(values - exact).max() < 1e-13 * exact[0]
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-12 * exact[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def dense(rows):
    x = np.array([np.floor(1024 * np.asarray(r, dtype=np.float64)) + 100000 for r in rows])
    n = len(x)
    c = x - x.mean(axis=0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    xi, sums = x.astype(int).astype(object), x.astype(int).sum(axis=0)
    return n, e, (c @ u) / np.sqrt(np.maximum(e, 1e-30)), [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in xi]


def test_query_equals_dense_solver(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    n, e, w, deviation = dense([r.embedding for r in rows])
    found = QUERIES["op12_embedding_whitening"](spark, DATA).collect()
    assert len(found) == 8 * n
    at = {r.vec_id: i for i, r in enumerate(rows)}
    signs = {r.component: np.sign(r.whitened * w[at[r.vec_id], r.component - 1]) for r in found if r.vec_id == rows[0].vec_id}
    for r in found:
        i, k = at[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == deviation[i]
        assert abs(r.whitened * signs[r.component] - w[i, k]) < 1e-8
        assert abs(r.explained / (e[k] / e.sum()) - 1) < 1e-10 and r.identity_error < 1e-10


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], "x"), (1, [1.0, 2.0], "x"), (2, [3.0, -1.0], None), (None, [0.5, 0.25], "x"),
        (3, None, "x"), (4, [1.0, None], "x"), (5, [nan, 1.0], "x"), (6, [1.0, inf], "x"), (7, [], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, WHITENED string")
    found = whiten(df).collect()
    n, e, w, deviation = dense([r[1] for r in rows[:4]])
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r.deviation for r in found if r.vec_id == 2} == {deviation[2]} and {r.n for r in found} == {4}
    assert {round(abs(r.whitened), 9) for r in found if r.vec_id == 2} == {round(abs(x), 9) for x in w[2]}
    assert whiten(df.where("vec_id = 1")).count() == 0  # no variance
    assert whiten(df.where("vec_id > 2")).count() == 0 and whiten(df.where("false")).count() == 0
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="one length"):
        whiten(mixed)


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.deviation for r in whiten(df).collect()}
    assert found[1] is None and found[2] is None
    _, _, _, exact = dense([[1e9, 0.0], [-1e9, 0.0], [0.0, 1.0]])
    assert found[3] == exact[2]
