"""Text chunks of cases, their index, and ranked retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselink.session import ship


def cut_points(text: str, most: int, overlap: int) -> list[str]:
    """Chunks of at most ``most`` characters, cut at the last line feed or space of a window's second half."""
    if not text.strip():
        return [""]
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + most)
        if end < len(text):
            cut = max(text.rfind("\n", start + most // 2, end), text.rfind(" ", start + most // 2, end))
            end = cut if cut > start else end
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunk_text(df: DataFrame, most: int = 2400, overlap: int = 240) -> DataFrame:
    """(case_id, item_id, chunk_no, chunk_id, text, digest) of (case_id, item_id, text); the cursor is sequential, so this
    runs in pandas batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [cut_points(t or "", most, overlap) for t in b["text"]]
            rows = b.assign(piece=parts).explode("piece")
            rows["chunk_no"] = rows.groupby(level=0).cumcount().astype("int32")
            yield rows[["case_id", "item_id", "chunk_no", "piece"]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    cut = df.select("case_id", "item_id", "text").mapInPandas(run, f"case_id {kinds['case_id']}, item_id {kinds['item_id']}, chunk_no int, piece string")
    name = F.concat_ws(":", F.col("case_id").cast("string"), F.col("item_id").cast("string"), F.format_string("%03d", "chunk_no"))
    return cut.select("case_id", "item_id", "chunk_no", name.alias("chunk_id"), F.col("piece").alias("text"), F.sha2("piece", 256).alias("digest"))


def build_chunks(chunks: DataFrame, occ: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chunks with a header, the item's values and the items it is linked with."""
    values = occ.groupBy("case_id", "item_id").agg(F.array_sort(F.collect_set("value")).alias("entity_values"))
    both = pairs.select("case_id", F.col("a").alias("item_id"), F.col("b").alias("other")).union(pairs.select("case_id", "b", "a"))
    related = both.groupBy("case_id", "item_id").agg(F.array_sort(F.collect_set("other")).alias("related"))
    return (chunks.join(values, ["case_id", "item_id"], "left").join(related, ["case_id", "item_id"], "left")
            .withColumn("text", F.concat_ws("\n", F.concat(F.lit("item "), F.col("item_id").cast("string")), "text")).withColumn("digest", F.sha2("text", 256)))


def sync_chunks(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """What to do with each chunk id: add, update, delete or keep."""
    both = existing.select("chunk_id", F.col("digest").alias("old")).join(desired.select("chunk_id", F.col("digest").alias("new")), "chunk_id", "full")
    return both.select("chunk_id", F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("keep").alias("action"))


def _nearest(k: int):
    """From rows (scope, dim, block, kind, id, v), sorted so that a block's vectors come before its queries: each query's k
    nearest vectors of the block. Products pick who can be among them, plain differences decide."""

    def answers(ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, queries: np.ndarray):
        square, own = (rows * rows).sum(1), (queries * queries).sum(1)
        rough = own[:, None] + square - 2 * (queries @ rows.T)
        slack = 1e-9 * (own + square.max())
        cut = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1] + slack
        out = []
        for q, x, near, most in zip(asked.tolist(), queries, rough, cut, strict=True):
            at = np.flatnonzero(near <= most)
            exact = np.sqrt(((rows[at] - x) ** 2).sum(1))
            out += [(q, int(ids[at[j]]), float(exact[j])) for j in np.lexsort((ids[at], exact))[:k]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            marks = list(zip(*columns, strict=True))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                *here, kind = marks[lo]
                if here != key:
                    key, held, block = here, [], None
                ids, flat = batch.column(4).slice(lo, hi - lo).to_numpy(), batch.column(5).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
                rows = flat.reshape(hi - lo, here[1])
                if kind == 0:
                    held.append((ids, rows))
                elif held:
                    block = block or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    for i in range(0, hi - lo, 256):
                        yield answers(*block, ids[i : i + 256], rows[i : i + 256])

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 8192) -> DataFrame:
    """Nearest vectors of each query within its scope: (query_id, scope, v) against (vec_id, scope, v), by L2 distance, ties
    to the smaller vec_id; score 1 / (1 + distance). Ids are whole numbers; null vectors and scopes take no part, nor do
    vectors of another length than the query.

    The vectors of a scope are dealt into blocks of about ``block``, and a query goes once to each block of its scope; a
    block answers its queries by matrix products and returns k rows for each, so that no pair leaves a task.
    """
    ship(vectors.sparkSession)
    usable = F.col("v").isNotNull() & F.col("scope").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    own = vectors.where(usable).select(F.col("vec_id").cast("long").alias("id"), "scope", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"))
    blocks = own.groupBy("scope", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # a scope and length is one of few: its number of blocks meets the rows by a join on it
    base = own.join(blocks, ["scope", "dim"]).select("scope", "dim", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    asked = queries.where(usable).select(F.col("query_id").cast("long").alias("id"), "scope", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"))
    asked = asked.join(blocks, ["scope", "dim"]).select("scope", "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "v")
    both = base.unionByName(asked).repartition("scope", "dim", "block").sortWithinPartitions("scope", "dim", "block", "kind")
    met = both.mapInArrow(_nearest(k), "query_id long, vec_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"), F.round(1 / (1 + F.col("distance")), 6).alias("score"))


def tokens(text):
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 2))


def hybrid_rank(questions: DataFrame, chunks: DataFrame, near: DataFrame, least: float = 0.18) -> DataFrame:
    """Chunks by vector score (0.65), share of the question's words (0.35, through an inverted word table), the exact id and
    the entity value they hold.

    questions: (query_id, text, entity, exact_id); near: (query_id, item_id, score), as knn gives it. A chunk that shares
    no word, vector or id with a question isn't looked at: an entity value of a question is words of it.
    """
    asked = questions.withColumn("words", tokens(F.col("text")))
    want = asked.select("query_id", F.size("words").alias("n"), F.explode("words").alias("w"))
    held = chunks.select("chunk_id", F.explode(tokens(F.col("text"))).alias("w"))
    words = want.join(held, "w").groupBy("query_id", "chunk_id", "n").agg(F.count("*").alias("m")).select("query_id", "chunk_id", (F.col("m") / F.col("n")).alias("words"))
    names = chunks.select("chunk_id", "item_id")
    vector = near.groupBy("query_id", "item_id").agg(F.max("score").alias("vector")).join(names, "item_id").select("query_id", "chunk_id", "vector")
    exact = asked.select("query_id", F.col("exact_id").alias("item_id")).join(names, "item_id").select("query_id", "chunk_id", F.lit(1).alias("exact"))
    found = words.join(vector, ["query_id", "chunk_id"], "full").join(exact, ["query_id", "chunk_id"], "full").na.fill(0, ["words", "vector", "exact"])
    scored = found.join(asked.select("query_id", "entity"), "query_id").join(chunks.select("chunk_id", "item_id", "text"), "chunk_id")
    entity = F.when(F.col("entity").isNotNull() & F.contains(F.col("text"), F.col("entity")), 0.55).otherwise(0.0)
    score = 0.65 * F.col("vector") + 0.35 * F.col("words") + entity + 0.85 * F.col("exact")
    return scored.select("query_id", "chunk_id", "item_id", F.round(F.least(F.lit(1.0), score), 6).alias("score")).where(F.col("score") >= least)


def expand_and_diversify(hits: DataFrame, related: DataFrame, k: int = 8) -> DataFrame:
    """Hits pull in related items at 0.72 of their score; the best of each item comes before any second; k a query."""
    pulled = hits.join(related, "item_id").select("query_id", F.concat_ws(":", F.col("other").cast("string"), F.lit("000")).alias("chunk_id"), F.col("other").alias("item_id"), F.round(F.col("score") * 0.72, 6).alias("score"))
    best = hits.select("query_id", "chunk_id", "item_id", "score").union(pulled).groupBy("query_id", "chunk_id", "item_id").agg(F.max("score").alias("score"))
    best = best.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy(F.col("score").desc(), "chunk_id")))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", F.col("score").desc(), "chunk_id"))).where(F.col("rank") <= k)


def missing_constraints(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Exact values (money, long ids, e-mail addresses, hashes) of a question that none of its hits holds."""
    pattern = r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|\b[a-f0-9]{32,64}\b|(?:NPR|Rs\.?|USD|\$)\s?[0-9][0-9,]*|\b[0-9]{6,}\b"
    want = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("value"))
    held = hits.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("value")).distinct()
    return want.join(held, ["query_id", "value"], "left_anti")


def citation_scores(expected: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, precision, recall, f1) of the distinct items that an answer cites against those it should: precision is 0
    without a citation, recall 1 where none was expected."""
    keys = ["query_id", "item_id"]
    both = expected.select(*keys).distinct().withColumn("e", F.lit(1)).join(cited.select(*keys).distinct().withColumn("c", F.lit(1)), keys, "full")
    # a query that only one side has, with no item there, is still a query
    ids = both.where("item_id is not null").groupBy("query_id").agg(F.count_if(F.col("e").isNotNull() & F.col("c").isNotNull()).alias("tp"), F.count("e").alias("want"), F.count("c").alias("got"))
    every = expected.select("query_id").union(cited.select("query_id")).distinct().join(ids, "query_id", "left").na.fill(0, ["tp", "want", "got"])
    p, r = F.when(F.col("got") > 0, F.col("tp") / F.col("got")).otherwise(0.0), F.when(F.col("want") > 0, F.col("tp") / F.col("want")).otherwise(1.0)
    return every.select("query_id", p.alias("p"), r.alias("r")).select("query_id", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"),
                                                                      F.round(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0), 6).alias("f1"))


def retrieval_metrics(expected: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """Macro recall and precision at k, and mean reciprocal rank, over the queries with an expectation."""
    top = found.where(F.col("rank") <= k)
    n = expected.groupBy("query_id").agg(F.count_distinct("item_id").alias("want"))
    got = expected.select("query_id", "item_id").distinct().join(found, ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.count_distinct(F.when(F.col("rank") <= k, F.col("item_id"))).alias("hit"))
    size = top.groupBy("query_id").agg(F.count_distinct("item_id").alias("shown"))
    rows = n.join(got, "query_id", "left").join(size, "query_id", "left").na.fill(0, ["hit", "shown"])
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit") / F.col("want")), 6).alias("recall"), F.round(F.avg(F.when(F.col("shown") > 0, F.col("hit") / F.col("shown")).otherwise(0.0)), 6).alias("precision"),
                    F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
