"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

A shard's task builds its graph by inserting rows in batches that double: a greedy beam search from the entry rows through
the graph so far proposes neighbours, of which relaxed distance pruning keeps a diverse few: the nearest is taken, and what
is nearer to it, by the factor ``relax``, than to the row itself is dropped, and so on. Each kept edge is also offered
backwards, and lists that grow too long are pruned alike. Then the queries stream past, and a beam search of each through
the graph gives the shard's nearest rows. Rows are dealt to shards by hash, every query is asked in every shard, and the
best of all shards are ranked.

Equal vectors are one row of the graph; of a group of copies only the smallest ids that can be needed travel, so a group's
size costs nothing. Walks are in single precision; what they end on is scored in double precision on the vectors as given.

A task holds one shard: ``shard`` vectors and ``degree`` edges of each. Queries are a stated share of all rows; each of them
goes to each shard once and brings at most k rows back.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, take no
part; rows that share the query's vec_id are its own, and one of them (with the smallest vector bytes) is asked; candidates
of another length are not compared; repeated rows of another vec_id are candidates of their own; a query with fewer
candidates gets all; equal cosines go to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselink.llm.vectors import usable
from caselink.session import durable, ship

HITS = "query_id long, vec_id long, times int, score double"


class Graph:
    """A directed graph over unit rows (single precision) in which nearest rows are found by walking."""

    def __init__(self, rows: np.ndarray, degree: int = 28, beam: int = 48, relax: float = 1.2, entries: int = 8, seed: int = 11) -> None:
        self.rows, self.degree, self.beam, self.relax = rows, degree, beam, relax
        n = len(rows)
        self.out = np.full((n, degree), -1, np.int32)
        self.order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.entries = self.order[:entries]
        done = min(n, entries)
        if done:
            self._join(self.order[:done], np.tile(self.order[:done], (done, 1)))
        while done < n:
            take = self.order[done : done + min(max(done, 1), 512)]
            found, _ = self.walk(rows[take], beam, done)
            self._join(take, found)
            done += len(take)

    def walk(self, queries: np.ndarray, beam: int, known: int | None = None, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the ``beam`` best rows that a greedy search from the entries meets, best first; -1 where it
        meets fewer. Each step opens the ``wide`` best rows that aren't open yet, of all queries at once."""
        m, n, starts = len(queries), len(self.rows), self.entries[: known or len(self.entries)]
        ids = np.full((m, beam + wide * self.degree), -1, np.int32)
        near = np.full(ids.shape, -np.inf, np.float32)
        shut = np.zeros((m, beam), bool)  # rows of the beam that were opened
        met = np.zeros((m, n), np.int32)
        first = starts[:beam]
        ids[:, : len(first)] = first
        near[:, : len(first)] = queries @ self.rows[first].T
        met[:, first] = 1
        going, turn = np.arange(m), 1
        while len(going):
            open_ = np.where(shut[going] | (ids[going, :beam] < 0), -np.inf, near[going, :beam])
            pick = np.argpartition(-open_, min(wide, beam - 1), axis=1)[:, :wide]
            have = np.take_along_axis(open_, pick, 1) > -np.inf
            alive = have.any(1)
            if not alive.all():
                going, pick, have = going[alive], pick[alive], have[alive]
                if not len(going):
                    break
            shut[going[:, None], pick] |= have
            nodes = np.where(have, ids[going[:, None], pick], -1)
            nb = np.where(nodes[:, :, None] >= 0, self.out[nodes], -1).reshape(len(going), -1)
            at = np.maximum(nb, 0)
            new = (nb >= 0) & (met[going[:, None], at] == 0)
            stamp = turn + 1 + np.arange(nb.shape[1], dtype=np.int32)
            turn += nb.shape[1]
            r, c = np.nonzero(new)
            met[going[r], at[r, c]] = stamp[c]
            new[r, c] = met[going[r], at[r, c]] == stamp[c]  # a row that two opened rows point to is new once
            r, c = np.nonzero(new)
            dots = np.full(nb.shape, -np.inf, np.float32)
            dots[r, c] = np.einsum("ij,ij->i", queries[going[r]], self.rows[at[r, c]])
            ids[going, beam:], near[going, beam:] = np.where(new, nb, -1), dots
            order = np.argsort(-near[going], axis=1, kind="stable")[:, :beam]
            was = np.concatenate([shut[going], np.zeros(nb.shape, bool)], axis=1)
            ids[going, :beam] = np.take_along_axis(ids[going], order, 1)
            near[going, :beam] = np.take_along_axis(near[going], order, 1)
            shut[going] = np.take_along_axis(was, order, 1)
        return ids[:, :beam], near[:, :beam]

    def prune(self, own: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """For each row the proposed neighbours that relaxed distance pruning keeps, at most ``degree``, -1 after them."""
        out = np.full((len(own), self.degree), -1, np.int32)
        x = self.rows[np.maximum(proposed, 0)]
        ok = (proposed >= 0) & (proposed != own[:, None])
        far = np.where(ok, 1 - np.einsum("ijk,ik->ij", x, self.rows[own]), np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        far, proposed, x = np.take_along_axis(far, order, 1), np.take_along_axis(proposed, order, 1), np.take_along_axis(x, order[:, :, None], 1)
        apart = 1 - x @ x.transpose(0, 2, 1)
        line = np.arange(len(own))
        for k in range(self.degree):
            pick = far.argmin(1)
            live = far[line, pick] < np.inf
            if not live.any():
                break
            out[live, k] = proposed[line, pick][live]
            near = self.relax * apart[line, pick] <= far
            near[line, pick] = True
            near |= proposed == proposed[line, pick][:, None]
            far = np.where(near & live[:, None], np.inf, far)
        return out

    def _join(self, own: np.ndarray, proposed: np.ndarray) -> None:
        """Give rows their edges and offer these backwards."""
        self.out[own] = self.prune(own, proposed)
        src, dst = np.repeat(own, self.degree), self.out[own].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, first, much = np.unique(dst, return_index=True, return_counts=True)
        if not len(to):
            return
        held = (self.out[to] >= 0).sum(1)
        fits = held + much <= self.degree
        place = np.arange(len(dst)) - np.repeat(first, much)
        rows = np.repeat(np.arange(len(to)), much)
        easy = fits[rows]
        self.out[to[rows[easy]], (held[rows] + place)[easy]] = src[easy]
        hard = np.flatnonzero(~fits)
        for size in (1, 2, 4, 8, 16):  # lists that outgrow the degree, those of like lengths together
            part = hard[(much[hard] <= size * self.degree) & (much[hard] > (size // 2) * self.degree)] if size < 16 else hard[much[hard] > 8 * self.degree]
            for i in range(0, len(part), max(1, 512 // size)):
                some = part[i : i + max(1, 512 // size)]
                wide = np.full((len(some), self.degree + int(much[some].max())), -1, np.int32)
                wide[:, : self.degree] = self.out[to[some]]
                for w, s in zip(wide, some.tolist(), strict=True):
                    w[self.degree : self.degree + much[s]] = src[first[s] : first[s] + much[s]]
                self.out[to[some]] = self.prune(to[some], wide)


def _ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors, in their own precision."""
    for batch in batches:
        single = pa.types.is_float32(batch.schema.field(1).type.value_type)
        _, vectors = usable(batch.column(1))
        got = [(i, len(v), (v.astype(np.float32) if single else v).tobytes()) for i, v in zip(batch.column(0).to_pylist(), vectors, strict=True) if v is not None and i is not None and v.any()]
        cols = list(zip(*got, strict=True)) if got else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "dim", "v"])


def _vectors(raw: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32 if len(raw[0]) == 4 * d else np.float64).reshape(-1, d).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector and rows, in double precision. Powers of two are taken out first: nothing overflows."""
    q, x = (np.ldexp(v, -np.frexp(np.abs(v).max(-1, keepdims=True))[1]) for v in (q, x))
    return (x @ q) / (np.sqrt((x * x).sum(1)) * np.sqrt(q @ q))


def _search(k: int, settings: dict, beam: int):
    """From rows (shard, dim, kind, vec_id, v, ids, times), sorted so that a shard's vectors come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, graph = None, [], None
        for batch in batches:
            shard, dim, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (kind[1:] != kind[:-1]), True]) if len(shard) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (shard[lo], dim[lo]) != key:
                    key, held, graph = (shard[lo], dim[lo]), [], None
                part = batch.slice(lo, hi - lo)
                x = _vectors(part.column(4).to_pylist(), int(dim[lo]))
                if kind[lo] == 0:
                    held.append((x, part.column(5), part.column(6)))
                elif held:
                    if graph is None:
                        rows = np.concatenate([h[0] for h in held])
                        ids, times = (pa.concat_arrays([h[i] for h in held]) for i in (1, 2))
                        graph = Graph(_units(rows), **settings)
                    own = part.column(3).to_pylist()
                    for i in range(0, len(x), 256):
                        found, _ = graph.walk(_units(x[i : i + 256]), beam)
                        out = []
                        for query, q, at in zip(own[i : i + 256], x[i : i + 256], found, strict=True):
                            at = at[at >= 0]
                            score = cosines(q, rows[at])
                            best, room = np.argsort(-score, kind="stable"), k
                            for j in best.tolist():
                                if room <= 0 and score[j] < last:  # noqa: F821
                                    break
                                mine = [(v, t) for v, t in zip(ids[int(at[j])].as_py(), times[int(at[j])].as_py(), strict=True) if v != query]
                                out += [(query, v, t, score[j]) for v, t in mine]
                                room, last = room - sum(t for _, t in mine), score[j]  # noqa: F841
                        cols = list(zip(*out, strict=True)) if out else [[]] * 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["query_id", "vec_id", "times", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = 8192, beam: int = 96, **settings) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where ``is_query`` (a column of vec_id) holds, the k nearest found of
    all others. Shards hold about ``shard`` different vectors; ``settings`` are those of ``Graph``."""
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    if own.schema["v"].dataType.elementType.simpleString() not in ("float", "double"):
        own = own.withColumn("v", F.col("v").cast("array<double>"))
    ready = durable(own.mapInArrow(_ready, "vec_id long, dim int, v binary"), "graph-ready")
    # copies: of each different vector the k + 1 smallest ids, one of which may be the query's own
    turn = F.row_number().over(Window.partitionBy("v", "dim").orderBy("vec_id"))
    some = ready.groupBy("v", "dim", "vec_id").agg(F.count("*").alias("times")).withColumn("turn", turn).where(F.col("turn") <= k + 1)
    each = F.sort_array(F.collect_list(F.struct("vec_id", F.least("times", F.lit(k)).cast("int").alias("times"))))
    distinct = some.groupBy("v", "dim").agg(each.alias("held")).select("v", "dim", F.col("held.vec_id").alias("ids"), F.col("held.times").alias("times"))
    distinct = durable(distinct, "graph-distinct")
    shards = max(1, -(-distinct.count() // shard))
    asked = ready.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("x"))
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "x.dim", F.lit(1).alias("kind"), "vec_id", "x.v", *(F.lit(None).cast(distinct.schema[c].dataType).alias(c) for c in ("ids", "times")))
    base = distinct.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(0).alias("kind"), F.col("ids")[0].alias("vec_id"), "v", "ids", "times")
    both = base.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind", "vec_id")
    found = both.mapInArrow(_search(k, settings, max(beam, 2 * k)), HITS)
    each = found.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_robust_pruned_graph(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: What the search must find where it misses nothing, as in small tables.
OP11_SQL = """
WITH ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (sqrt(list_inner_product(c.v, c.v)) * sqrt(list_inner_product(q.v, q.v))) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
