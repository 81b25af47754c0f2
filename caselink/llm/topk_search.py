"""Exact top-k inner-product search with a KD-tree per shard.

Candidates are hashed into shards of about ``shard`` rows. A task builds its shard's tree once, by median splits of the
widest dimension with tight bounding boxes, then answers the queries that stream past. A query goes through the tree best
first: the bound of a box is the sum of the larger end products, and nothing below the k-th best score is opened. Every
query is first answered by one home shard; its k-th score goes with it to all the others.

A stated share of the rows is the query set, in blocks against all rows: each query meets each shard once, and a shard
returns at most k rows for it, none of them below the k-th score from home.

Edge cases: vectors that are null, empty or hold null or non-finite components, and rows with a null vec_id, take no
part; rows that share the query's vec_id are its own, and one of them is asked; candidates of another length are not scored; a query with fewer
candidates gets all; equal scores go to the smaller vec_id; scores are exact up to 2**53; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselink.llm.vectors import usable
from caselink.session import durable, ship

HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class KDTree:
    """Median splits with tight boxes over the rows of a matrix; ids are ascending within equal scores."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = 64) -> None:
        self.ids, self.rows = ids, rows
        self.low, self.high, self.kids, self.members = [], [], [], []
        self._build(np.arange(len(ids)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, at: np.ndarray, leaf: int) -> int:
        me = len(self.kids)
        part = self.rows[at]
        low, high = part.min(0), part.max(0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.members.append(None)
        if len(at) <= leaf or not (high > low).any():
            self.members[me] = (self.ids[at], part)
            return me
        wide = int((high - low).argmax())
        order = at[np.argpartition(part[:, wide], len(at) // 2)]
        self.kids[me] = (self._build(order[: len(at) // 2], leaf), self._build(order[len(at) // 2 :], leaf))
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product of each query with any point of each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, id) with a score of at least ``floor``, best first."""
        best: list[tuple[float, int]] = []  # a heap of (score, -id)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            if self.kids[node] is None:
                ids, rows = self.members[node]
                scores = rows @ query
                for j in np.flatnonzero(scores >= floor):
                    if ids[j] != own:
                        item = (float(scores[j]), -int(ids[j]))
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            else:
                for child in self.kids[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _prepare(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, vectors = usable(batch.column(1))
            ids = batch.column(0).to_pylist()
            got = [(i, len(v), np.floor(scale * v).tobytes()) for i, v in zip(ids, vectors, strict=True) if v is not None and i is not None]
            cols = list(zip(*got, strict=True)) if got else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "dim", "v"])

    return run


def _answer(k: int):
    """From rows (shard, kind, dim, id, floor, v) sorted so that a shard's candidates come before its queries."""

    def run(batches):
        key, held, tree = None, [], None

        def hits(ids, floors, q):
            bounds = tree.bounds(q)
            out = [(i, vec, int(s)) for i, f, x, b in zip(ids, floors, q, bounds, strict=True) for s, vec in tree.search(i, x, b, k, f)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=HITS)

        for batch in batches:
            shard, kind, dim, ids, floors = (batch.column(i).to_numpy() for i in range(5))
            raw = batch.column(5).to_pylist()
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (kind[1:] != kind[:-1]), True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rows = np.frombuffer(b"".join(raw[lo:hi]), np.float64).reshape(hi - lo, -1)
                if (shard[lo], dim[lo]) != key:
                    key, held, tree = (shard[lo], dim[lo]), [], None
                if kind[lo] == 0:
                    held.append((ids[lo:hi], rows))
                elif held:
                    if tree is None:
                        tree = KDTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    for i in range(lo, hi, 256):
                        yield hits(ids[i : min(hi, i + 256)].tolist(), floors[i : min(hi, i + 256)], rows[i - lo : i - lo + 256])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shard: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where ``is_query`` (a column of vec_id) holds, the k best of all others."""
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    ready = durable(own.mapInArrow(_prepare(scale), "vec_id long, dim int, v binary"), "search-ready")
    shards = max(1, -(-ready.count() // shard))
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    columns = ["shard", "kind", "dim", "vec_id", "floor", "v"]
    base = ready.select(home("vec_id").alias("shard"), F.lit(0).alias("kind"), "dim", "vec_id", F.lit(0.0).alias("floor"), "v")
    queries = ready.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v", F.lit(1).alias("kind"))

    def answered(rows: DataFrame) -> DataFrame:
        both = base.unionByName(rows.select(*columns)).repartition("shard", "dim").sortWithinPartitions("shard", "dim", "kind")
        return durable(both.mapInArrow(_answer(k), "query_id long, vec_id long, score long"), "search-hits")

    nowhere = F.lit(float("-inf"))
    first = answered(queries.withColumn("shard", home("vec_id")).withColumn("floor", nowhere))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    others = (queries.join(kth, F.col("vec_id") == F.col("query_id"), "left").withColumn("floor", F.coalesce(F.col("kth").cast("double"), nowhere))
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home("vec_id")))
    found = first.union(answered(others)) if shards > 1 else first
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_kd_tree_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
