"""Embedding near-duplicates by sorted projection passes.

In every pass each vector gets a key, a row of random hashes written one after the other: each hash says which of 16
random directions the vector, seen from its label's mean, points along or against the most. Vectors of a label are put
in key order and each is compared with the next ``window`` ones; verified pairs of all passes are united. Seen from the
mean, vectors that crowd around a common direction spread over all hashes; cosines are always those of the vectors
themselves. Order places come from a range-partitioned sort and are cut into blocks that also hold the next block's
first ``window`` rows, so no task holds a label whole.

Equal vectors of a label are one vector with a weight from the start. As links never leave a component, the exact
number of links is then counted inside the components, in tiles of at most about ``tile`` rows a side: neighbours beyond
the window, as in dense groups, are so counted too.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link
with nothing; vectors of different lengths don't link; repeated rows of one vec_id are rows of their own that link with
each other; a null vec_id links with nothing and gets a null component_id and kept = true; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.minhash_dedup import _runs
from caselink.llm.vectors import block, usable
from caselink.operators.components import component_roots
from caselink.session import durable, ship

ROWS = pa.schema([("vec_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("space", pa.string()), ("v", pa.binary()), ("keys", pa.list_(pa.int64()))])


WIDTH = 16


def directions(dim: int, passes: int, hashes: int) -> np.ndarray:
    return np.random.default_rng([11, dim]).standard_normal((passes * hashes * WIDTH, dim))


def order_keys(units: np.ndarray, planes: np.ndarray, passes: int, hashes: int) -> np.ndarray:
    """The key of each row in each pass."""
    p = (units @ planes.T).reshape(len(units), passes, hashes, WIDTH)
    most = np.abs(p).argmax(3)
    against = np.take_along_axis(p, most[..., None], 3)[..., 0] < 0
    return (most * 2 + against) @ ((2 * WIDTH) ** np.arange(hashes - 1, -1, -1, dtype=np.int64))


def _units(batch: pa.RecordBatch) -> Iterator[tuple]:
    """vec_id, space, unit vector of each row (vec_id, v, space); space and vector are None where nothing can link."""
    for i, space, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), usable(batch.column(1))[1], strict=True):
        norm = float(np.linalg.norm(v / np.abs(v).max())) * np.abs(v).max() if v is not None and v.any() else 0.0
        good = i is not None and space is not None and norm and np.isfinite(norm)
        yield (i, space, v, v / norm) if good else (i, None, None, None)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """space, n and the sum of its unit vectors, once a run of rows."""
    sums: dict[str, list] = {}
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()], pa.int64()),
                                              pa.array([s for _, s in sums.values()], pa.list_(pa.float64()))], names=["space", "n", "s"])
    for batch in batches:
        for _, space, _, unit in _units(batch):
            if space is not None:
                n, s = sums.get(space, (0, 0.0))
                sums[space] = [n + 1, s + unit]
        if len(sums) > 10_000:
            yield out()
            sums.clear()
    yield out()


def space_means(own: DataFrame) -> DataFrame:
    """space, mean: of the unit vectors, rounded so that the order of sums can't show."""
    parts = own.mapInArrow(_sums, "space string, n long, s array<double>").select("space", "n", F.posexplode("s").alias("i", "x"))
    means = parts.groupBy("space", "i").agg(F.round(F.sum("x") / F.sum("n"), 6).alias("x"))
    return means.groupBy("space").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("mean"))


def _prepare(passes: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            means, out = batch.column(3).to_pylist(), []
            for (i, space, v, unit), mean in zip(_units(batch), means, strict=True):
                if space is None:
                    out.append((i, None, None, None, None, None))
                    continue
                k = np.frombuffer(hashlib.blake2b(v.tobytes() + space.encode(), digest_size=16).digest(), np.int64)
                if len(v) not in planes:
                    planes[len(v)] = directions(len(v), passes, hashes)
                keys = order_keys((unit - np.array(mean))[None], planes[len(v)], passes, hashes)[0]
                out.append((i, int(k[0]), int(k[1]), space, unit.tobytes(), keys.tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, ROWS, strict=True)], schema=ROWS)

    return run


def _roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component of each of n rows, as its first row, from the linked pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _windows(window: int, least: float):
    """From rows (block, place, own, pass, space, rep, v) sorted by block and place: links of every row to its block's groups."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for table in _runs(batches, 0):
            names, own, turn = table.column(0).to_numpy(), table.column(2).to_numpy(), table.column(3).to_numpy()
            rep, spaces = table.column(5).to_numpy(), np.unique(np.array(table.column(4).to_pylist()), return_inverse=True)[1]
            raw = table.column(6).to_pylist()
            key = spaces.astype(np.int64) << 32 | turn
            cuts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (key[1:] != key[:-1]), True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                x = np.frombuffer(b"".join(raw[lo:hi]), np.float64).reshape(hi - lo, -1)
                mine = own[lo:hi]
                left, right = [], []
                for i in range(0, hi - lo, window):
                    s = x[i : i + window] @ x[i : i + 2 * window].T
                    r, c = np.nonzero(s >= least)
                    ok = (c > r) & (c - r <= window) & mine[i + r]
                    left.append(i + r[ok])
                    right.append(i + c[ok])
                a, b = np.concatenate(left), np.concatenate(right)
                root = _roots_of(hi - lo, a, b)
                at = np.flatnonzero(root != np.arange(hi - lo))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[lo + at]), pa.array(rep[lo + root[at]])], schema=schema)

    return run


def _count_links(least: float):
    """From rows (pair, side, rep, weight, v) sorted by pair: linked weight of every row within the pair of tiles."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64())])

    def run(batches):
        for table in _runs(batches, 0):
            pair, side, rep, weight = (table.column(i).to_numpy() for i in range(4))
            raw = table.column(4).to_pylist()
            cuts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                x = np.frombuffer(b"".join(raw[lo:hi]), np.float64).reshape(hi - lo, -1)
                w, s = weight[lo:hi], side[lo:hi]
                links = np.zeros(hi - lo, np.int64)
                for i in range(0, hi - lo, 256):
                    near = x[i : i + 256] @ x.T >= least
                    # side 2: both tiles are the same one; else only the other tile counts
                    near &= (s[i : i + 256, None] == 2) | (s[i : i + 256, None] != s[None, :])
                    near[np.arange(len(near)), i + np.arange(len(near))] = False
                    links[i : i + 256] = near @ w
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[lo + at]), pa.array(links[at])], schema=schema)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98,
                 passes: int = 32, hashes: int = 10, window: int = 128, rows: int = 1024, tile: int = 2048) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"),
                         F.concat(F.col(label_col).cast("string"), F.lit("/"), F.size(vector_col).cast("string")).alias("space"))
    with_mean = own.join(durable(space_means(own), "vectors-means"), "space", "left").select("vec_id", "v", "space", "mean")
    ready = durable(with_mean.mapInArrow(_prepare(passes, hashes), "vec_id long, k1 long, k2 long, space string, v binary, keys array<long>"), "vectors-ready")
    classes = ready.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    reps = durable(classes.join(ready.select("k1", "k2", "vec_id", "space", "v", "keys").dropDuplicates(["k1", "k2", "vec_id"]), ["k1", "k2", "vec_id"]).withColumnRenamed("vec_id", "rep"), "vectors-reps")
    turns = reps.select("rep", "k1", "space", F.posexplode("keys").alias("turn", "key"), "v")
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["space", "turn", "key", "rep", "k1"]
    placed = durable(turns.repartitionByRange(spread, *order).sortWithinPartitions(*order).select(
        "rep", "space", "turn", "v", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("at")), "vectors-order")
    sizes = placed.groupBy("part").agg((F.max("at") + 1).alias("n")).collect()  # one number a partition
    start, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts += [F.lit(r["part"]), F.lit(start)]
        start += r["n"]
    place = F.element_at(F.create_map(*starts), F.col("part")) + F.col("at") if starts else F.lit(0)
    placed = placed.withColumn("place", place.cast("long")).withColumn("block", F.floor(F.col("place") / rows))
    halo = placed.where((F.col("place") % rows < window) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    blocks = (placed.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))
              .select("block", "place", "own", "turn", "space", "rep", "v").repartition("block").sortWithinPartitions("block", "place"))
    links = blocks.mapInArrow(_windows(window, least), "a long, b long")
    # a vector's classes in several labels may share a vec_id only if rows repeat it; such rows are one node
    roots = durable(component_roots(links, "a", "b"), "vectors-roots")
    joined = roots.select(F.col("node").alias("rep"), "component").union(roots.select(F.col("component").alias("rep"), "component").distinct())
    members = durable(reps.select("rep", "space", "weight", "v").join(joined, "rep"), "vectors-members")
    tiles = members.groupBy("component", "space").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sided = (members.join(tiles, ["component", "space"]).withColumn("mine", F.pmod(F.xxhash64("rep", "space"), F.col("tiles")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select(F.xxhash64("component", "space", F.least("mine", "other"), F.greatest("mine", "other")).alias("pair"),
                     F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"), "rep", "weight", "v"))
    counted = (sided.repartition("pair").sortWithinPartitions("pair", "rep").mapInArrow(_count_links(least), "rep long, links long")
               .groupBy("rep").agg(F.sum("links").alias("links")))
    named = classes.select("k1", "k2", F.col("vec_id").alias("rep"), "weight").join(joined, "rep", "left").join(counted, "rep", "left")
    out = ready.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("vec_id", F.coalesce(F.col("links"), F.lit(0)).cast("long").alias("linked"), "weight", F.coalesce("component", "rep", "vec_id").alias("component_id")).select(
        "vec_id", (F.col("linked") + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(v, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links, min(r)::BIGINT AS component_id, min(r) = e.vec_id AS kept
FROM embeddings e JOIN reach ON reach.v = e.vec_id GROUP BY e.vec_id
"""
