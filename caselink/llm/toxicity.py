"""Toxicity by class-conditional Kneser-Ney models of the letters in words.

Two models, toxic and ordinary, give each letter of a word its probability after the letters before it: all of them near
the word's start, the last five further on. Each subtracts a fixed discount from its own counts and hands what it took to one shared backoff: Kneser-Ney continuation
counts (how many different longer strings end in these letters) of both classes together. A rare expression so falls
back on the same probability in both and its log-likelihoods differ little.

A word's evidence is the difference of its two log-likelihoods, less the document's median (its language moves all words
alike). A document's evidence is its three strongest words, the numbers of words beyond fixed levels, the
length-normalised mean, and its length. A logistic calibration on training rows that the counts left out turns these
into a score from 0 to 1.

Counting is a Spark aggregation over all labelled rows, first of words, then of letter strings. The models are a Parquet
table in the shared folder, one row a context with the value of each letter after it and of unseen ones; every string
counts, however rare, and nothing is hashed or broadcast. For scoring, a task numbers the distinct words of a run of
documents (a chunk, bounded in text and in letters of words) and writes the words, once a chunk; their strings go by context in
packets of a range of context hashes. There a merge with the models, by the full strings, values them (as half-precision
numbers, a thousandth of their size apart), and each chunk's values meet its documents, which by then are lists of word
numbers.

Edge cases: null and empty texts, and texts without letters, have no evidence and get the calibration's value at zero;
null labels are no labels; of repeated label rows the largest counts; without both classes among the training rows the
score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from caselink.session import discard, durable, ship

ORDER = 6
START = 9
DISCOUNT = 0.75
MOST_FITTED = 20_000
CHUNK_CHARS, CHUNK_LETTERS = 16_000_000, 2_500_000
PACKETS = 1024
CAP = 8.0
LEVELS = (2.0, 3.0, 4.0, 5.0)
FEATURES = 3 + len(LEVELS) + 2
WORD = re.compile(r"[^\W\d_]+")


def _strings(word: str) -> list[str]:
    w = f"^{word}$"
    n = len(w)
    near = [w[:i] for i in range(2, min(n, START) + 1)]
    return near + [w[i - ORDER : i] for i in range(START + 1, n + 1)] if n > START else near


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())

    def out():
        words = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (counts[1], counts[0]))], names=["word", "toxic", "ordinary"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[label].update(WORD.findall((text.as_py() or "").lower()))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield out()
                counts[0].clear()
                counts[1].clear()
    yield out()


def _string_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, ordinary = Counter(), Counter()

    def out():
        columns = [pa.array([g[:-1] for g in toxic], pa.string()), pa.array([g[-1] for g in toxic], pa.string())]
        numbers = [pa.array(list(toxic.values()), pa.int64()), pa.array([ordinary[g] for g in toxic], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *numbers], names=["ctx", "ch", "t", "o"])

    for batch in batches:
        for word, t, o in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for g in _strings(word):
                toxic[g] += t
                ordinary[g] += o
        if len(toxic) > 400_000:
            yield out()
            toxic.clear()
            ordinary.clear()
    yield out()


def fit_models(train: DataFrame) -> DataFrame:
    """From (label, text): ctx, unseen, letters, v. Log-likelihood differences of each letter seen after ctx, and of any other.

    One exchange by context serves the counts of strings and the list of a context's letters, which only the alphabet
    bounds; the shared backoff is a row for the last two letters of a context.
    """
    words = (train.mapInArrow(_word_counts, "word string, toxic long, ordinary long")
             .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    strings = (words.mapInArrow(_string_counts, "ctx string, ch string, t long, o long").repartition("ctx")
               .groupBy("ctx", "ch").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
               .groupBy("ctx").agg(F.collect_list(F.struct("ch", "t", "o")).alias("s")))
    a = durable(strings.selectExpr("ctx", "right(ctx, 2) as ctx2", "s"), "toxic-strings", "zstd")
    c = a.select("ctx2", F.explode("s.ch").alias("ch")).groupBy("ctx2", "ch").agg(F.count("*").alias("n3"))
    e = c.groupBy("ch").agg(F.count("*").alias("n1")).join(c.agg(F.count("*").alias("n0")))
    shared = (c.join(e, "ch").groupBy("ctx2")
              .agg(F.sum("n3").alias("n2"), F.count("*").alias("kinds2"), F.collect_list(F.struct("ch", "n3", "n1", "n0")).alias("m"))
              .selectExpr("ctx2", f"""map_from_entries(transform(m, x -> struct(x.ch,
                  (greatest(x.n3 - {DISCOUNT}D, 0D) + {DISCOUNT}D * kinds2 * x.n1 / x.n0) / n2))) as shared"""))
    sums = [f"aggregate(s, 0L, (n, x) -> n + x.{k}) as sum_{k}" for k in "to"] + [f"size(filter(s, x -> x.{k} > 0)) as kinds_{k}" for k in "to"]
    p = lambda k: (f"if(sum_{k} > 0, (greatest(x.{k} - {DISCOUNT}D, 0D) + {DISCOUNT}D * kinds_{k} * shared[x.ch]) / sum_{k},"  # noqa: E731
                   " shared[x.ch])")
    left = lambda k: f"if(sum_{k} > 0, {DISCOUNT}D * kinds_{k} / sum_{k}, 1D)"
    value = lambda x: f"cast(ln({x('t')}) - ln({x('o')}) as float)"
    seen = a.selectExpr("ctx", "ctx2", "s", *sums).join(shared, "ctx2")
    v = f"transform(s, x -> {value(p)}) as v"
    out = durable(seen.selectExpr("ctx", f"{value(left)} as unseen", "array_join(s.ch, '') as letters", v), "toxic-models", "zstd")
    discard(a)
    return out


class Numbers(dict):
    """word: its number in the chunk, by first occurrence."""

    letters = 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.letters += len(word) + 1
        return n


def _packed(numbers: np.ndarray) -> bytes:
    """Sorted, as differences, the four bytes of each apart: most are zero, and files and shuffles compress them."""
    return np.diff(np.sort(numbers), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().cumsum()


def _packets(strings: Iterable[str]) -> dict[int, list[str]]:
    """packet: its contexts, each followed by the letters after it, in the order of the strings, which are different."""
    after, packets = defaultdict(str), defaultdict(list)
    for g in strings:
        after[g[:-1]] += g[-1]
    for ctx, letters in after.items():
        packets[zlib.crc32(ctx.encode()) % PACKETS] += ctx, letters
    return packets


SCAN_FIELDS = [StructField("_chunk", LongType()), StructField("_bag", BinaryType()), StructField("_words", BinaryType())]


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is the text. Rows of documents (_bag: numbers of their words), then one of their chunk (_words)."""
    new = lambda: (int.from_bytes(os.urandom(8)) >> 1, Numbers())
    (chunk, words), chars, names, types = new(), 0, None, None

    def rows(kept, bags, spelled):
        own = [pa.array([chunk] * len(bags), pa.int64()), pa.array(bags, pa.binary()), pa.array(spelled, pa.binary())]
        return pa.RecordBatch.from_arrays([*(kept or [pa.nulls(len(bags), t) for t in types]), *own], names=[*names, *(f.name for f in SCAN_FIELDS)])

    def finished():
        yield rows(None, [None], [zlib.compress("\n".join(words).encode(), 1)])

    for batch in batches:
        names, types = batch.schema.names[:-1], [f.type for f in batch.schema][:-1]
        texts, bags, lo = batch.column(batch.num_columns - 1), [], 0
        for r in range(batch.num_rows):
            text = texts[r].as_py() or ""
            found = WORD.findall(text.lower())
            bags.append(_packed(np.fromiter(map(words.__getitem__, found), np.uint32, len(found))))
            chars += len(text)
            full = chars > CHUNK_CHARS or words.letters > CHUNK_LETTERS
            if full or len(bags) == 1024 or r + 1 == batch.num_rows:
                yield rows(batch.slice(lo, len(bags)).columns[:-1], bags, [None] * len(bags))
                lo, bags = r + 1, []
            if full:
                yield from finished()
                (chunk, words), chars = new(), 0
    if chars or words:
        yield from finished()


def _spelled(words: bytes) -> list[str]:
    return [w for w in zlib.decompress(words).decode().split("\n") if w]


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (_chunk, _words): its packets, _n by _n."""
    for batch in batches:
        for chunk, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            packets = _packets(dict.fromkeys(chain.from_iterable(map(_strings, _spelled(words)))))
            packs = [zlib.compress("\n".join(x).encode(), 1) for x in packets.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(packets), pa.int32()), pa.array([chunk] * len(packs), pa.int64()), pa.array(packs, pa.binary())],
                                             names=["_n", "_chunk", "_pack"])


def features(x: np.ndarray) -> list[float]:
    """From the evidence of each word of a document."""
    if not len(x):
        return [0.0] * FEATURES
    x = x - np.median(x)
    top = np.clip(np.sort(np.partition(x, len(x) - 3)[-3:] if len(x) > 3 else x)[::-1], 0, CAP)
    top = [*map(float, top), *[0.0] * (3 - len(top))]
    return [*top, *(float(np.log1p((x > v).sum())) for v in LEVELS), float(np.minimum(x, CAP).mean()), float(np.log1p(len(x)))]


FEATURE_NAMES = [f"_toxic_f{i}" for i in range(FEATURES)]


def _valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by packet, its models first: packets of chunks with the values of their strings."""
    at, models = None, {}
    for batch in batches:
        out = []
        for packet, chunk, pack, ctx, unseen, letters, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if packet != at:
                at, models = packet, {}
            if chunk is None:
                models[ctx] = unseen, dict(zip(letters, v, strict=True))
                continue
            parts, values = zlib.decompress(pack).decode().split("\n"), []
            for ctx, letters in zip(parts[::2], parts[1::2], strict=True):
                other, known = models.get(ctx, (0.0, {}))
                values.extend(known.get(ch, other) for ch in letters)
            # in the order of the packet, which the chunk's words give again: the strings don't travel back
            out.append((chunk, packet, zlib.compress(np.array(values, "<f2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)))
        types = (pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["_of", "_n", "_bag"])


def _chunk_features(docs: pa.Table, strings: pa.Table) -> pa.Table:
    """Documents of a chunk with their features, by the values of its strings."""
    sent = dict(zip(strings["_n"].to_pylist(), strings["_bag"].to_pylist(), strict=True))
    words = _spelled(sent.pop(-1)) if sent else []
    # strings are numbered by first occurrence, as the packer has them; sums of half-precision numbers are exact in any order
    at: dict[str, int] = {}
    numbers = np.fromiter((at.setdefault(g, len(at)) for w in words for g in _strings(w)), np.int32)
    value = np.zeros(len(at))
    for n, parts in _packets(at).items():
        keys = [at[ctx + ch] for ctx, letters in zip(parts[::2], parts[1::2], strict=True) for ch in letters]
        value[keys] = np.ascontiguousarray(np.frombuffer(zlib.decompress(sent[n]), np.uint8).reshape(2, -1).T).view("<f2").ravel()
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
    evidence = np.add.reduceat(value[numbers], starts).astype(np.float32) if words else np.zeros(0, np.float32)
    rows = [features(evidence[_unpacked(bag.as_py())]) for bag in docs["_bag"]]
    kept = [c for c in docs.column_names if c not in ("_chunk", "_bag")]
    return pa.table([*(docs[c] for c in kept), *(pa.array(x, pa.float64()) for x in zip(*rows, strict=True))], names=[*kept, *FEATURE_NAMES])


def document_features(docs: DataFrame, models: DataFrame) -> DataFrame:
    """``docs``, whose last column is the text, with its features in place of it."""
    kept = [StructField(f.name, f.dataType) for f in docs.schema.fields[:-1]]
    scan = durable(docs.mapInArrow(_scanner, StructType([*kept, *SCAN_FIELDS])), "toxic-scan", "zstd")
    chunks = scan.where("_words is not null").select("_chunk", "_words")
    of_models = models.withColumn("_n", F.expr(f"cast(crc32(cast(ctx as binary)) % {PACKETS} as int)"))
    packets = chunks.mapInArrow(_packer, "_n int, _chunk long, _pack binary").unionByName(of_models, allowMissingColumns=True)
    packets = packets.select("_n", "_chunk", "_pack", "ctx", "unseen", "letters", "v").repartition("_n").sortWithinPartitions("_n", F.col("_chunk").asc_nulls_first())
    strings = packets.mapInArrow(_valued, "_of long, _n int, _bag binary")
    strings = strings.unionByName(chunks.selectExpr("_chunk as _of", "-1 as _n", "_words as _bag"))
    rows = scan.where("_words is null").select(*(F.col(f"`{f.name}`") for f in kept), "_chunk", "_bag")
    # as read back: a file's columns may all be null, those inside a struct too
    schema = StructType([*(scan.schema[f.name] for f in kept), *(StructField(f, DoubleType()) for f in FEATURE_NAMES)])
    return rows.groupBy("_chunk").cogroup(strings.groupBy("_of")).applyInArrow(_chunk_features, schema)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes last and isn't shrunk."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.diag([0.3] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, keep_columns: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels of held-out rows are never read. With
    ``keep_columns`` a struct ``row`` of these comes first, whatever they are called; it goes through all steps, so a digest
    is better kept than a text.

    A quarter of the training rows, at most MOST_FITTED of them by hash order, fits the calibration; the counts take all
    the others. Rows of one doc_id stay together.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = ["row", "doc_id"] if keep_columns else ["doc_id"]
    every = docs.select(*[F.struct(*(F.col(f"`{c}`") for c in keep_columns)).alias("row")] * bool(keep_columns),
                        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
             .where(~_held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label")))
    known = known.withColumn("fit", F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3) % 4 == 0)
    train = durable(own.where(~_held_out("doc_id")).join(known, "doc_id").select("doc_id", "label", "fit", "text"), "toxic-train")
    # the sample ends at a hash: no join is needed to tell its rows from those that are counted
    order = F.md5(F.col("doc_id").cast("string"))
    first = train.where("fit").groupBy(order.alias("key")).agg(F.count("*").alias("n")).orderBy("key").limit(MOST_FITTED)
    last = first.withColumn("rows", F.sum("n").over(Window.orderBy("key"))).where(F.col("rows") <= MOST_FITTED).agg(F.max("key")).first()[0] or ""
    fits = F.col("fit") & (order <= last)
    have = {r["label"] for r in train.where(~fits).select("label").distinct().collect()}
    if have == {0, 1}:
        models = fit_models(train.where(~fits).select("label", "text"))
        scored = durable(document_features(every, models), "toxic-features", "zstd")
        # only the sample's few numbers meet in one place
        sample = train.where(fits).select("doc_id", "label").distinct().join(scored.select("doc_id", *FEATURE_NAMES), "doc_id")
        sample = sample.orderBy(order, "doc_id", *FEATURE_NAMES).select("label", *FEATURE_NAMES).toArrow()
        x, y = np.stack([sample[f].to_numpy() for f in FEATURE_NAMES], 1), sample["label"].to_numpy()
        w = _logistic(x, y) if len(np.unique(y)) == 2 else np.r_[0.3, 0.3, 0.3, np.zeros(FEATURES - 3), -4.0]
        discard(train, models)
        z = sum((F.col(f) * float(v) for f, v in zip(FEATURE_NAMES, w[:-1], strict=True)), F.lit(float(w[-1])))
        score = 1 / (1 + F.exp(-z))
    else:
        scored, score = every, F.lit(0.0)
    return (scored.select(*kept, F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), score.cast("double").alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))


def op10_toxicity_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
