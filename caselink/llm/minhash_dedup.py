"""MinHash near-duplicates with Odd sketches.

Every text's 5-word shingles give ``bands * rows`` MinHash samples. Banded sample keys bring candidates together; the
same samples, folded into a parity bitmap (an Odd sketch), travel with each key, and the XOR population count of two
bitmaps estimates the similarity of a candidate pair before any set is moved. What is left is confirmed on full sets.

Texts with the same word sequence are one class from the start, so a group of copies never meets itself. In a bucket
the members first link to *leaders* (one pair a member); pairs beyond these are only looked at when, after the first
components, they would still join two of them. Buckets above ``small`` members are scanned again with the components,
longer sketches and the sets at hand: a pair of two components is confirmed in the first bucket it shares, on the spot,
and only links that join components are written, so rows stay linear in a group's size and no such pair is left
untested. A large bucket's different texts (never its copies) are together in one task then.

Edge cases: null and empty texts have no shingles and link with nothing; repeated rows of one doc_id stay rows and are
one node; a null doc_id links with nothing and gets a null component_id and kept = true; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.text import chunks, mix, shingle_hashes, utf8, word_hashes
from caselink.operators.components import component_roots
from caselink.session import durable, ship

BITS = 256
FINE_SAMPLES, FINE_BITS = 480, 1024
SIG = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
PAIRS = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def samples(shingles: np.ndarray, k: int) -> np.ndarray:
    """k MinHash samples of a non-empty set of 64-bit hashes."""
    rng = np.random.default_rng(7)
    flip = rng.integers(0, 2**32, k, dtype=np.uint32)
    mul = rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, ((low[i : i + 4096, None] ^ flip) * mul).min(0), out=out)
    return out


def odd_sketch(sample: np.ndarray, bits: int = BITS) -> bytes:
    """Parity bitmap: every (sample number, sample) flips one bit."""
    at = mix(sample.astype(np.uint64) | np.arange(1, len(sample) + 1, dtype=np.uint64) << np.uint64(32)) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def band_keys(sample: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = sample.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for r in range(rows):
        key = mix(key ^ (grid[:, r] + np.uint64(r << 33)))
    return key.view(np.int64)


def most_flips(similarity: float, k: int, bits: int = BITS, sigmas: float = 6.0) -> int:
    """The XOR population count that a pair of this similarity passes but once in a billion."""
    flips = 2 * k * (1 - similarity) + sigmas * math.sqrt(4 * k * similarity * (1 - similarity))
    mean = bits / 2 * (1 - (1 - 2 / bits) ** flips)
    return math.ceil(mean + sigmas / 2 * math.sqrt(mean * (1 - mean / bits)) / 2)


def _signer(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            out: list[tuple] = []
            for i, j, part, off in chunks(data, offsets):
                words, at = word_hashes(part, off)
                for r in range(j - i):
                    mine = words[at[r] : at[r + 1]]
                    key = np.frombuffer(hashlib.blake2b(mine.tobytes(), digest_size=16).digest(), np.int64)
                    found = shingle_hashes(mine, size)
                    if len(found):
                        sample = samples(found, bands * rows)
                        out.append((ids[i + r], int(key[0]), int(key[1]), len(found), band_keys(sample, bands, rows), odd_sketch(sample)))
                    else:
                        out.append((ids[i + r], int(key[0]), int(key[1]), 0, [], b""))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), SIG, strict=True)] if out else [pa.array([], t.type) for t in SIG], schema=SIG)

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Whole runs of equal keys of a sorted partition, several runs at a time."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def _pairs_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(cols, PAIRS, strict=True)], schema=PAIRS)


def _bits(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _bucket_scan(limit: int, num: int, den: int, small: int):
    """From rows (band, doc, n, sketch) sorted by band: kind 0 leader pairs, 1 other pairs that pass, 2 members of large buckets."""

    def near(bits, n, one, rest):
        ok = np.bitwise_count(bits[rest] ^ bits[one]).sum(1, dtype=np.int64)
        sized = np.minimum(n[rest], n[one]) * den >= np.maximum(n[rest], n[one]) * num
        return np.where(sized, ok, BITS)

    def run(batches):
        for table in _runs(batches, 0):
            band = table.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
            many = np.flatnonzero(np.diff(cuts) > 1)
            if not len(many):
                continue
            ids, n, bits = table.column(1).to_numpy(), table.column(2).to_numpy(), _bits(table.column(3))
            out = []
            for lo, hi in zip(cuts[many], cuts[many + 1], strict=True):
                leaders = [lo]
                for i in range(lo + 1, hi):
                    flips = near(bits, n, i, np.array(leaders))
                    best = int(flips.argmin())
                    if flips[best] <= limit:
                        out.append((0, int(ids[leaders[best]]), int(ids[i]), 0, b""))
                    if flips[best] > limit // 4:
                        leaders.append(i)
                if hi - lo > small:
                    out += [(2, int(ids[i]), int(band[i]), int(n[i]), bits[i].tobytes()) for i in range(lo, hi)]
                elif hi - lo > 2:
                    for i in range(lo, hi - 1):
                        hit = np.flatnonzero(near(bits, n, i, np.arange(i + 1, hi)) <= limit)
                        out += [(1, int(ids[i]), int(ids[i + 1 + x]), 0, b"") for x in hit]
                if len(out) > 20_000:
                    yield _pairs_batch(out)
                    out = []
            yield _pairs_batch(out)

    return run


def _cross_scan(fine_limit: int, num: int, den: int):
    """From rows (band, doc, component, bands, fine sketch, set) sorted by band: confirmed links that join components."""

    def run(batches):
        for table in _runs(batches, 0):
            band, ids, comp = (table.column(i).to_numpy() for i in (0, 1, 2))
            keys = table.column(3).combine_chunks().flatten().to_numpy().reshape(len(band), -1)
            bits = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint64).reshape(len(band), -1)
            sets = [np.frombuffer(x, np.uint64) for x in table.column(5).to_pylist()]
            n = np.array([len(x) for x in sets])
            cuts = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = comp[lo:hi].copy()
                at = int(np.flatnonzero(keys[lo] == band[lo])[0])
                for i in range(hi - lo - 1):
                    rest = np.arange(i + 1, hi - lo)
                    rest = rest[own[rest] != own[i]]
                    if not len(rest):
                        continue
                    x, y = lo + i, lo + rest
                    ok = (np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64) <= fine_limit) & (np.minimum(n[y], n[x]) * den >= np.maximum(n[y], n[x]) * num)
                    ok &= ~(keys[y, :at] == keys[x, :at]).any(1)
                    for j in rest[ok]:
                        if own[j] != own[i] and _linked(sets[x], sets[lo + j], num, den):
                            out.append((int(ids[x]), int(ids[lo + j])))
                            own[own == own[j]] = own[i]
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _sets(size: int):
    schema = pa.schema([("doc", pa.int64()), ("set", pa.binary()), ("fine", pa.binary())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for i, j, part, off in chunks(data, offsets):
                words, at = word_hashes(part, off)
                sets = [shingle_hashes(words[at[r] : at[r + 1]], size) for r in range(j - i)]
                fine = [odd_sketch(samples(x, FINE_SAMPLES), FINE_BITS) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(fine, pa.binary())], schema=schema)

    return run


def _confirm(num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for r in range(batch.num_rows):
                keep.append(_linked(*(np.frombuffer(batch.column(c)[r].as_buffer(), np.uint64) for c in (2, 3)), num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, size: int = 5, bands: int = 24, rows: int = 5, small: int = 64) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Two texts link when den * intersection >= num * union of their shingle sets. With 24 bands of 5 samples a pair at
    the threshold shares no band once in a million.
    """
    ship(docs.sparkSession)
    limit = most_flips(num / den, bands * rows)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = durable(own.mapInArrow(_signer(bands, rows, size), "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>, sketch binary"), "minhash-sig")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    reps = sig.join(classes.withColumnRenamed("rep", "doc_id").hint("merge"), ["k1", "k2", "doc_id"], "left_semi").dropDuplicates(["k1", "k2", "doc_id"])
    keyed = reps.select(F.explode("bands").alias("band"), "doc_id", F.col("n_shingles").alias("n"), "sketch")
    found = durable(keyed.repartition("band").sortWithinPartitions("band", "doc_id").mapInArrow(_bucket_scan(limit, num, den, small), "kind byte, a long, b long, n long, sketch binary"), "minhash-pairs")
    ids = found.select(F.col("a").alias("doc_id")).union(found.where("kind < 2").select("b")).distinct()
    sets = durable(own.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(size), "doc long, set binary, fine binary").dropDuplicates(["doc"]), "minhash-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = (pairs.select("a", "b").distinct().join(sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a")).hint("merge"), "a")
                .join(sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b")).hint("merge"), "b"))
        return durable(both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(num, den), "a long, b long"), "minhash-links")

    links = confirmed(found.where("kind = 0"))
    roots = component_roots(links, "a", "b")
    of = lambda c: roots.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    rest = found.where("kind = 1").select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    more = confirmed(rest.join(found.where("kind = 0").select("a", "b").distinct(), ["a", "b"], "left_anti"))
    big = found.where("kind = 2").select(F.col("b").alias("band"), F.col("a").alias("doc"))
    roots = component_roots(links.union(more), "a", "b")
    open_buckets = (big.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).groupBy("band")
                    .agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band"))
    scan = (big.join(open_buckets, "band", "left_semi").join(roots.withColumnRenamed("node", "doc"), "doc", "left").join(sets, "doc")
            .join(reps.select(F.col("doc_id").alias("doc"), "bands").dropDuplicates(["doc"]), "doc")
            .select("band", "doc", F.coalesce("component", "doc").alias("comp"), "bands", "fine", "set").repartition("band").sortWithinPartitions("band", "doc"))
    last = durable(scan.mapInArrow(_cross_scan(most_flips(num / den, FINE_SAMPLES, FINE_BITS), num, den), "a long, b long"), "minhash-last")
    if not last.isEmpty():
        roots = component_roots(links.union(more).union(last), "a", "b")
    named = (classes.join(roots.select(F.col("node").alias("rep"), "component"), "rep", "left")
             .select("k1", "k2", F.coalesce("component", "rep").alias("component")))
    return (sig.select("doc_id", "k1", "k2", "n_shingles").join(named.hint("merge"), ["k1", "k2"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v, b FROM reach JOIN both_ways ON a = r)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id, min(r) = d.doc_id AS kept
FROM documents d JOIN reach ON v = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
