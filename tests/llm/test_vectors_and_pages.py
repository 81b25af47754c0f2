"""Embedding, search and archive operators against brute force; the registered SQL; the pipeline."""

import gzip
import io
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import DATA
from oracle import same
from pyspark.sql import functions as F

from caselink.llm import embedding_dedup, queries, topk_search, warc
from caselink.session import new_path

SCHEMA = "vec_id long, embedding array<float>, label int, keys string, v string"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    out = []
    for i in range(300):
        out.append((i, r.standard_normal(16).tolist(), int(i % 3)))
    dense = r.standard_normal(16)
    for i in range(300, 450):  # a dense group, wider than the window
        out.append((i, (dense + 0.06 * r.standard_normal(16)).tolist(), 1))
    out += [(450, out[5][1], out[5][2]), (451, out[5][1], 7), (452, None, 1), (453, [0.0] * 16, 1), (454, [1.0, None, *[2.0] * 14], 1), (455, [float("nan")] * 16, 1), (456, out[0][1], None), (457, [1.0, 2.0], 1), (458, [], 1), (None, out[0][1], 0), (460, out[7][1], out[7][2]), (460, out[7][1], out[7][2])]
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3).cache()


def test_near_vectors(vectors, rows):
    ok = [(i, np.float32(v).astype(float), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n = len(ok)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]):
                link[a, b] = ok[a][1] @ ok[b][1] / np.linalg.norm(ok[a][1]) / np.linalg.norm(ok[b][1]) >= 0.98
    root = np.array([i for i, _, _ in ok])
    for _ in range(n):
        new = np.array([min([root[a], *root[link[a]]]) for a in range(n)])
        if (new == root).all():
            break
        root = new
    want = sorted((i, int(link[k].sum()), int(root[k])) for k, (i, _, _) in enumerate(ok))
    got = embedding_dedup.near_vectors(vectors, window=8, rows=32, tile=40).collect()
    assert len(got) == len(rows) and max(w[1] for w in want) > 60
    alive = {i for i, _, _ in ok}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in alive) == want
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id not in alive)


@pytest.mark.parametrize("crowded", [True, False])
def test_near_vectors_recall(spark, crowded):
    """Pairs at cosine 0.9803 among vectors of one label, also where all crowd around a common direction."""
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(r.standard_normal((3000, 64)))
    x = unit(np.sqrt(0.08) * x + np.sqrt(0.92) * unit(r.standard_normal((1, 64)))) if crowded else x
    z = r.standard_normal((500, 64))
    z = unit(z - (z * x[:500]).sum(1, keepdims=True) * x[:500])
    every = np.r_[x, 0.9803 * x[:500] + np.sqrt(1 - 0.9803**2) * z]
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int")
    got = {g.vec_id: g for g in embedding_dedup.near_vectors(table).collect()}
    want = every @ every.T >= 0.98
    np.fill_diagonal(want, False)
    found = sum(g.n_links for g in got.values())
    assert want.sum() >= 1000 and 0.99 * want.sum() <= found <= want.sum()
    assert np.mean([got[i].component_id == got[3000 + i].component_id for i in range(500)]) >= 0.99


def test_top_k(vectors, rows):
    ok = [(i, np.floor(1024 * np.float32(v).astype(float))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in ok:
        if i % 20 == 0:
            scored = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    got = topk_search.top_k(vectors, F.col("vec_id") % 20 == 0, shard=64).collect()
    # a repeated query row is asked once
    assert sorted(tuple(r) for r in got) == sorted(want[i] for i in range(len(want)) if want[i][0] != 460 or i == want.index(want[i]))


def test_kd_tree_alone():
    r = np.random.default_rng(1)
    x, q = np.floor(r.standard_normal((500, 8)) * 100), np.floor(r.standard_normal((5, 8)) * 100)
    tree = topk_search.KDTree(np.arange(500), x, 16)
    for one, bounds in zip(q, tree.bounds(q), strict=True):
        assert tree.search(-1, one, bounds, 10, -np.inf) == [(float(s), int(i)) for s, i in sorted(((v, k) for k, v in enumerate(x @ one)), key=lambda t: (-t[0], t[1]))[:10]]


def test_archives(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (9, None, None), (2, "x", ""), (None, "y", "same"), (7, "é\n", "ü" * 10), (8, "z", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1)).withColumn("digest", F.lit("x"))
    whole = warc.write_archives(pages, new_path(spark, "w"))
    normal = warc.normalise(whole, new_path(spark, "n"))
    got = {r.page_id: r for r in warc.read_archives(normal, per_range=2).collect()}
    assert len(got) == len(rows)
    first = {"same": 3, "": 2}
    for i, _, html in rows:
        r, body = got[i], (html or "").encode()
        assert r.payload_bytes == len(body) and r.payload_digest == warc.payload_digest(body)
        other = first.get(html or "")
        assert (r.record_type, r.refers_to) == (("revisit", other) if other is not None and other != i else ("response", None))
        assert r.payload is None or bytes(r.payload) == body
    for r in normal.collect():  # every record is a member of its own, where the index says
        raw = open(r.path.removeprefix("file://"), "rb").read()
        places = [tuple(map(int, x.split("\t")[1:])) for x in open(r["index"].removeprefix("file://")).read().splitlines()]
        assert sum(n for _, n in places) == len(raw)
        assert all(gzip.decompress(raw[o : o + n]).startswith(b"WARC/1.1\r\n") for o, n in places)
    few = warc.read_archives(warc.normalise(warc.write_archives(pages, new_path(spark, "w"), least_bytes=5), new_path(spark, "n")))
    assert few.where("record_type = 'revisit'").isEmpty()
    assert warc.read_archives(warc.normalise(warc.write_archives(pages.limit(0), new_path(spark, "w")), new_path(spark, "n"))).isEmpty()


def test_records_are_split_at_any_piece_size():
    raw = b"".join(warc.record(i, "u", bytes([65 + i]) * i, None) for i in range(20))
    packed = gzip.compress(raw[:300]) + gzip.compress(raw[300:])
    assert b"".join(warc.inflated(io.BytesIO(packed))) == raw
    for n in (1, 7, 1000):
        assert b"".join(r for _, r in warc.split_records(iter([raw[i : i + n] for i in range(0, len(raw), n)]))) == raw
    with pytest.raises(ValueError):
        list(warc.split_records(iter([raw[:-9]])))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name], DATA)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_vectors(none).isEmpty() and topk_search.top_k(none, F.col("vec_id") % 20 == 0).isEmpty()


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        if name == "toxicity":
            gone = {r.doc_id for r in before.select("doc_id").subtract(docs.select("doc_id")).collect()}
            assert sum(labels.get(i) == 0 for i in gone) <= 0.05 * before.count()
        if name == "near_dedup":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "pii":
            assert docs.count() == before.count() and docs.where("text like '%[EMAIL]%'").count() > 0
        if name == "mixing":
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    out = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == docs.count() and out.where("n_tokens <> size(ids)").isEmpty()
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0)], docs.schema)
    for _, stage in pipeline.STAGES:
        odd = stage(spark, odd, DATA).cache()
        odd.count()


def test_queries_carry_their_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_links_from_a_similarity_of_080(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]
    # 100 shingles each; the changed last words leave 90 of 110 in common, 0.82
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:94], *(f"x{i}" for i in range(10))])), (3, "other words stand here alone")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == [1, 3]


def test_pipeline_stages_with_any_column_names(spark):
    """Columns that operators use inside pass every stage as they are; repeated rows, null and empty texts have their place."""
    import corpus_pipeline as pipeline

    names = ["score", "predicted", "held_out", "_toxic_f0", "scored_text", "_chunk", "_n", "row", "id", "times", "turn", "size", "key", "n", "part", "whole", "target",
             "bound", "filler", "source_size", "mix_size", "mix_copies", "ids", "decoded", "spans", "component_id", "kept", "band", "k", "label", "fit"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({c: F.lit(f"own {c}") for c in names})
    odd = docs.limit(1)
    docs = docs.unionByName(odd).unionByName(odd.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-5).cast("long")))
    docs = docs.unionByName(odd.withColumn("text", F.lit("another text of this very id"))).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns[-len(names):] == names and not docs.isEmpty()
        assert docs.where(" or ".join(f"{c} is null or {c} <> 'own {c}'" for c in names)).isEmpty()
        if name == "near_dedup":
            assert docs.where("text = 'another text of this very id'").count() == 1 and docs.where("doc_id = -5").count() == 1
    out = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and out.count() == docs.count()
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, DATA)
        assert none.isEmpty()
