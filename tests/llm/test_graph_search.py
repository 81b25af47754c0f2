"""Graph search against all cosines."""

import numpy as np
import pytest
from conftest import DATA
from oracle import same
from pyspark.sql import functions as F

from caselink.llm import graph_search, queries
from caselink.llm.graph_search import Graph

SCHEMA = "vec_id long, embedding array<float>, shard int, times string"


def brute(rows, every, k=5):
    ok = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q in sorted({i for i, _ in ok if i % every == 0}):
        x = next(v for i, v in ok if i == q)
        near = [(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), i) for i, v in ok if i != q and len(v) == len(x)]
        out[q] = sorted(near, key=lambda p: (-round(p[0], 12), p[1]))[:k]
    return out


def recall(got, want):
    """Share of the nearest that were found; the scores of what was found are checked on the way."""
    by, hit, total = {}, 0, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {q for q, w in want.items() if w}
    for q, w in want.items():
        mine = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(w) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine) and all(r.vec_id != q for r in mine)
        hit += sum(r.score >= w[-1][0] - 1e-12 for r in mine)
        total += len(w)
    return hit / total


def test_copies_ties_and_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(400)]  # one vector holds more than half of all rows
    rows += [(801, rows[0][1]), (802, rows[0][1]), (802, rows[0][1]), (0, rows[0][1])]
    rows += [(850, None), (851, [0.0] * 8), (852, [None] * 8), (853, [float("nan")] * 8), (854, []), (900, [1.0, 2.0]), (901, [2.0, 4.0]), (1000, [1.0, 2.0, 3.0]), (None, rows[1][1])]
    table = spark.createDataFrame([(*x, 1, "a") for x in rows], SCHEMA).repartition(7)
    want = brute(rows, 50)
    for shard in (10_000, 100):
        got = graph_search.nearest(table, F.col("vec_id") % 50 == 0, shard=shard).collect()
        exact = {(g.query_id, g.rank): (g.vec_id, round(g.score, 12)) for g in got}
        assert exact == {(q, k): (v, round(s, 12)) for q, w in want.items() for k, (s, v) in enumerate(w, 1)}
    assert want[900] == [(pytest.approx(1.0), 901)] and [v for _, v in want[0]][:3] == [801, 802, 802] and not want[1000] and want[300][0][1] == 50
    empty = spark.createDataFrame([], SCHEMA)
    assert graph_search.nearest(empty, F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_recall(spark, kind):
    r = np.random.default_rng(6)
    x = r.standard_normal((9000, 64))
    if kind == "clusters":  # far apart, and tight
        x = 0.1 * x + r.standard_normal((30, 64))[r.integers(0, 30, 9000)]
    rows = [(i, v.tolist()) for i, v in enumerate(np.float32(x))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = graph_search.nearest(table, F.col("vec_id") % 50 == 0, shard=4000).collect()
    assert recall(got, brute(rows, 50)) >= 0.95


def test_graph_is_pruned_and_reaches_all():
    r = np.random.default_rng(1)
    x = graph_search._units(r.standard_normal((3000, 16)))
    g = Graph(x, degree=16)
    seen, front = set(g.entries.tolist()), list(g.entries.tolist())
    while front:
        front = [int(b) for a in front for b in g.out[a] if b >= 0 and b not in seen and not seen.add(int(b))]
    assert len(seen) >= 2990 and (g.out >= 0).sum(1).max() <= 16 and not (g.out == np.arange(3000)[:, None]).any()
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in g.out)


def test_query_equals_its_sql(spark):
    same(spark, queries.QUERIES["op11_robust_pruned_graph"], queries.ORACLES["op11_robust_pruned_graph"], DATA)
    same(spark, queries.QUERIES["op11_robust_pruned_graph"], queries.ORACLES["op11_robust_pruned_graph"], "/root/testdata/sf0.01")
