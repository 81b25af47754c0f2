"""Whitening against numpy's eigendecomposition of the whole covariance."""

import numpy as np
import pytest
from conftest import DATA

from caselink.llm import whitening
from caselink.llm.whitening import Spectrum


@pytest.mark.parametrize("kind", ["plain", "repeated", "low rank", "one axis", "clusters"])
def test_rank_one_updates(kind):
    r = np.random.default_rng(4)
    x = r.integers(-40, 40, (300, 12))
    if kind == "repeated":
        x = np.repeat(x[:40], 6, axis=0)
    elif kind == "low rank":
        x[:, 5:] = x[:, :1] * 2
    elif kind == "one axis":
        x[:, 1:] = 7
    elif kind == "clusters":
        x = np.where(r.random((300, 1)) < 0.5, 1000, 0) + r.integers(0, 2, (300, 12))
    whole, halves = Spectrum(12), [Spectrum(12), Spectrum(12)]
    whole.add(x)
    halves[0].add(x[:90])
    halves[1].add(x[90:])
    halves[0].merge(halves[1])
    y = x - x.mean(0)
    want = y.T @ y
    for s in (whole, halves[0]):
        assert s.n == len(x) and s.sums == x.sum(0).tolist()
        assert np.abs(s.vectors.T @ s.vectors - np.eye(12)).max() < 1e-11
        assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() < 1e-11 * max(np.trace(want), 1)


def test_roots_fall_between_poles():
    r = np.random.default_rng(1)
    for _ in range(50):
        k = int(r.integers(1, 20))
        poles, weights = np.cumsum(10.0 ** r.uniform(-9, 2, k)), 10.0 ** r.uniform(-12, 2, k)
        want = np.linalg.eigvalsh(np.diag(poles) + np.sqrt(np.outer(weights, weights)))
        assert np.abs(whitening.secular_roots(poles, weights)[1] - want).max() < 1e-12 * max(want[-1], 1)


def brute(rows):
    """{vec_id: rows} and the components, from the covariance at once."""
    ok = [(i, np.floor(64 * np.float32(v).astype(float)).astype(int) + 1000000) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    fit = np.unique(np.array([x for _, x in ok]), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return ok, n, s, values[::-1], vectors[:, ::-1]


def check(rows, got, dims):
    ok, n, s, values, vectors = brute(rows)
    k = min(16, dims)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, c) for i, _ in ok for c in range(1, k + 1))
    at = {}
    for r in got:
        at[r.vec_id, r.component] = r
        assert r.n == n and r.identity_error <= 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-10
    for c in range(1, k + 1):
        want = np.array([(x - s / n) @ vectors[:, c - 1] for _, x in ok]) / np.sqrt(values[c - 1])
        have = np.array([at[i, c].whitened for i, _ in ok])
        sign = np.sign(want @ have)
        assert np.abs(sign * have - want).max() < 1e-8
    for i, x in ok:
        assert at[i, 1].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))


@pytest.mark.parametrize("dims", [5, 24])
def test_whitening_equals_brute_force(spark, dims):
    r = np.random.default_rng(dims)
    turn = r.standard_normal((dims, dims)) * np.linspace(0.2, 3, dims)
    rows = [(i, (r.standard_normal(dims) @ turn).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(150)] + [(600, None), (601, [0.0] * dims), (602, [None] * dims), (603, [float("inf")] + [0.0] * (dims - 1)), (604, []), (3, rows[3][1]), (None, rows[5][1])]
    table = spark.createDataFrame([(*x, 1, "a") for x in rows], "vec_id long, embedding array<float>, n int, component string").repartition(40)
    check(rows, whitening.whiten(table).collect(), dims)
    other = table.unionByName(spark.createDataFrame([(999, [1.0], 1, "a")], table.schema))
    assert whitening.whiten(other).where("vec_id = 999").count() == 0


def test_without_components(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    far = spark.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1e300])], schema)
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(far).collect()} == {(1, None), (2, None)}


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(rows, whitening.op13_embedding_whitening(spark, DATA).collect(), 64)
