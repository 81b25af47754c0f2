"""Repeated passages by a logarithmic family of suffix arrays.

A byte is removed if some window of ``length`` bytes covers it that also starts anywhere else. Windows of equal bytes
have equal least 48-byte hashes inside, so a run of windows with the same least hash is one *segment* and all that can
match it has the same hash: segments are dealt by it, and those whose hash occurs once in the table (also inside the
segment) are never cut out or moved. In a partition, each arriving batch of segments gets a suffix array; it is merge-scanned against the arrays of
the existing levels for matches of the full length and becomes a level itself, and levels of about equal size merge, so
a partition keeps a logarithmic number of them.

Suffixes are sorted and compared by their bytes, to a depth of ``length``; a match is a common prefix of that length.
Of equal suffixes one stays in the family, so levels have none in common and the scan of a new array against a level also
gives the places where the two merge. Hashes only deal segments; they decide nothing.

Equal texts are one from the start (all their windows repeat), and a segment that a task has seen before is not sent
again: both are covered. A passage that a third of all texts share so reaches a partition once a task, not once a text. Where it ends, segments hold bytes of each text's own and differ: a hash of more
than ``hot`` different segments is not kept together, but each of their windows is dealt by its own hash.
Texts are told apart by 128 bits of their SHA-256.

Edge cases: null texts are empty; texts shorter than ``length`` lose nothing; repeated rows are copies of one another
and lose everything; a null id is kept; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.text import STEP, TABLE, chunks, mix, utf8
from caselink.session import durable, ship

LENGTH, GRAM, BATCH = 200, 48, 4000
#: Different segments of one hash that are kept together; of more, every window is dealt by its own hash.
HOT = 50_000
#: Places of one hash that are held at once while they are counted.
LONG_RUN = 1_000_000


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` bytes, by doubling."""
    total: np.ndarray | None = None
    done = 0
    power, part, bit = np.array([STEP | np.uint64(1)]), TABLE[data], 1
    while bit <= size:
        if size & bit:
            n = len(data) - size + 1
            # the new piece stands before what has been hashed, and is shifted over it
            piece = part[size - done - bit : size - done - bit + n]
            total = piece.copy() if total is None else piece * shift + total
            shift = power if done == 0 else shift * power
            done += bit
        if bit * 2 <= size:
            part = part[:-bit] * power + part[bit:]
            power = power * power
        bit *= 2
    return mix(total)


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours, by doubling."""
    bit, out = 1, values
    while bit * 2 <= size:
        out = np.minimum(out[:-bit], out[bit:])
        bit *= 2
    return np.minimum(out[: len(values) - size + 1], out[size - bit : size - bit + len(values) - size + 1])


def _anchors(length: int):
    schema = pa.schema([("least", pa.int64()), ("k", pa.binary()), ("w0", pa.int32()), ("w1", pa.int32()), ("twice", pa.bool_()), ("print", pa.int64())])
    wide = length - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column(0)
            names = keys.to_pylist()
            data, offsets = utf8(batch.column(1))
            for i, j, part, off in chunks(data, offsets):
                if len(part) < length:
                    continue
                fresh = np.array([not (k in seen or seen.add(k)) for k in names[i:j]])
                if len(seen) > 500_000:
                    seen.clear()
                grams = window_hashes(part, GRAM)
                least = window_minima(grams, wide)
                doc = np.repeat(np.arange(j - i), np.diff(off))[: len(least)]
                at = np.flatnonzero((np.arange(len(least)) + length <= off[doc + 1]) & fresh[doc])
                if not len(at):
                    continue
                value = least[at]
                cut = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)])
                end = np.r_[cut[1:], len(at)] - 1
                d = doc[at[cut]]
                # which segments hold their least gram twice: they may match inside themselves
                none = np.zeros(wide - 1, np.uint64)
                picked = np.flatnonzero(~window_minima(~np.concatenate([none, least, none]), wide) == grams)
                lo, hi = np.searchsorted(picked, at[cut]), np.searchsorted(picked, at[end] + wide)
                times, open_runs, step = np.zeros(len(cut), np.int64), np.arange(len(cut)), 0
                while len(open_runs):
                    open_runs = open_runs[(lo[open_runs] + step < hi[open_runs]) & (times[open_runs] < 2)]
                    times[open_runs] += grams[picked[lo[open_runs] + step]] == value[cut[open_runs]]
                    step += 1
                total = np.r_[np.uint64(0), np.cumsum(grams)]
                prints = (total[at[end] + wide] - total[at[cut]]).view(np.int64)
                places = [pa.array((x - off[d]).astype(np.int32)) for x in (at[cut], at[end])]
                owner = keys.take(pa.array(i + d)).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(value[cut].view(np.int64)), owner, *places, pa.array(times > 1), pa.array(prints)], schema=schema)

    return run


def halves(keys: pa.Array) -> np.ndarray:
    """16-byte keys as rows of two numbers."""
    data, offsets = utf8(keys)
    return data[offsets[0] : offsets[-1]].view(np.int64).reshape(-1, 2)


def _shared(hot: int):
    """Of rows sorted by (least, k, w0): those whose hash is at two places at least, or twice in its segment; each once.

    ``hot`` marks hashes of more than so many different segments (told apart by the sum of their grams' hashes).
    """

    def told(table: pa.RecordBatch, many_parts: bool) -> pa.RecordBatch:
        least, k, w0, prints = table.column(0).to_numpy(), halves(table.column(1)), table.column(2).to_numpy(), table.column(5).to_numpy()
        new = np.r_[True, (least[1:] != least[:-1]) | (k[1:] != k[:-1]).any(axis=1) | (w0[1:] != w0[:-1])]
        rows = np.flatnonzero(new)
        h = least[rows]
        same = np.r_[False, h[1:] == h[:-1]]
        many = same | np.r_[same[1:], False]
        if many_parts:
            many |= h == h[0]
        rows = rows[many | table.column(4).to_numpy(zero_copy_only=False)[rows]]
        h, sums = least[rows], prints[rows]
        run = np.cumsum(np.r_[True, h[1:] != h[:-1]])[: len(h)] - 1
        order = np.lexsort((sums, run))
        fresh = np.r_[True, (run[order][1:] != run[order][:-1]) | (sums[order][1:] != sums[order][:-1])][: len(h)]
        is_hot = (np.bincount(run[order][fresh]) > hot)[run] if len(h) else np.zeros(0, bool)
        if many_parts and len(h):
            is_hot[h == h[0]] = True
        kept = table.take(pa.array(rows)).select(["least", "k", "w0", "w1"])
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(is_hot)], names=["least", "k", "w0", "w1", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many_parts, most = None, False, max(LONG_RUN, hot)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            h = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[-1])
            if cut == 0 and len(h) > most:  # a longer run is told in parts, all of them hot; two rows carry it on
                many_parts = True
                yield told(batch.slice(0, len(h) - 2), True)
                held = batch.slice(len(h) - 2)
                continue
            if cut:
                yield told(batch.slice(0, cut), many_parts)
                many_parts = False
            held = batch.slice(cut)
        if held is not None:
            yield told(held, many_parts)

    return run


PARTS = pa.schema([("least", pa.int64()), ("k", pa.binary()), ("w0", pa.int32()), ("w1", pa.int32()), ("part", pa.binary())])


def _segments(length: int):
    """From (k, places, text): segments to compare; those a task has seen before come without bytes, as covered.

    A segment of a hot hash comes as its windows, each under its own hash, so that its equals still meet it.
    """

    def dealt(places, text):
        for p in places:
            if not p["hot"]:
                yield p["least"], p["w0"], p["w1"]
                continue
            prints = window_hashes(np.frombuffer(text[p["w0"] : p["w1"] + length], np.uint8), length).view(np.int64).tolist()
            for i, value in enumerate(prints):
                yield value, p["w0"] + i, p["w0"] + i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple | None] = {}
        out: list[tuple] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PARTS, strict=True)], schema=PARTS)

        for batch in batches:
            for row in range(batch.num_rows):
                k, places, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].as_buffer().to_pybytes()
                for least, w0, w1 in dealt(places, text):
                    part = text[w0 : w1 + length]
                    key = hashlib.blake2b(part, digest_size=16).digest()
                    place = (least, k, w0, w1)
                    if key not in seen:
                        seen[key] = place
                        out.append((*place, part))
                    else:
                        if seen[key] is not None:
                            out.append((*seen[key], None))
                            seen[key] = None
                        out.append((*place, None))
                if len(out) > 4000:
                    yield batch_of(out)
                    out = []
            if len(seen) > 300_000:
                seen.clear()
        if out:
            yield batch_of(out)

    return run


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one big-endian number, without a copy."""
    return np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))


def equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes of two unequal numbers are equal."""
    differ, out = a ^ b, np.zeros(len(a), np.int32)
    for bits in (32, 16, 8):
        high = differ < (np.uint64(1) << np.uint64(64 - bits))
        out[high] += bits // 8
        differ = np.where(high, differ << np.uint64(bits), differ)
    return out


def suffix_array(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``at`` in the order of their first ``length`` bytes, and what each has in common with the one before.

    Suffixes are sorted by eight bytes, then those still tied by the next eight; a tied run is only sorted where it splits.
    Common prefixes are exact up to ``length``.
    """
    words = words_of(text)
    first = words[at].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    at, first = at[order], first[order]
    common = np.full(len(at), length, np.int32)
    common[:1] = 0
    split = np.flatnonzero(first[1:] != first[:-1]) + 1
    common[split] = equal_bytes(first[split], first[split - 1])
    tied = np.flatnonzero(common == length)
    for depth in [*range(8, length - 8, 8), length - 8]:
        if not len(tied):
            break
        heads = tied[np.r_[True, tied[1:] != tied[:-1] + 1]] - 1
        run = np.sort(np.concatenate([tied, heads]))
        is_head = np.r_[True, run[1:] != run[:-1] + 1]
        is_head[np.searchsorted(run, heads)] = True
        value, number = words[at[run] + depth].astype(np.uint64), np.cumsum(is_head)
        changed = np.flatnonzero(~is_head & np.r_[False, value[1:] != value[:-1]])
        if not len(changed):
            continue
        mixed = np.zeros(number[-1] + 1, bool)
        mixed[number[changed]] = True
        some = np.flatnonzero(mixed[number])
        order = some[np.lexsort((value[some], number[some]))]
        at[run[some]], value[some] = at[run[order]], value[order]
        split = np.flatnonzero(~is_head & np.r_[False, value[1:] != value[:-1]])
        common[run[split]] = depth + equal_bytes(value[split], value[split - 1])
        tied = tied[common[tied] == length]
    return at, common


class Level:
    """A suffix array over its own bytes: places in order, the first eight bytes of each, and the suffixes' numbers."""

    def __init__(self, text: np.ndarray, at: np.ndarray, names: np.ndarray) -> None:
        self.text, self.at, self.names = text, at, names
        self.first = words_of(text)[at].astype(np.uint64)

    def scan(self, other: Level, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of another level's suffixes, in order: its place among these, and whether the one there matches it."""
        mine, theirs = words_of(self.text), words_of(other.text)
        low, high = np.searchsorted(self.first, other.first), np.searchsorted(self.first, other.first, "right")
        open_ = np.flatnonzero(high > low)
        for depth in [*range(8, length - 8, 8), length - 8]:
            if not len(open_):
                break
            value = theirs[other.at[open_] + depth].astype(np.uint64)
            a, b = low[open_], high[open_]
            found = mine[self.at[a] + depth].astype(np.uint64)
            # a range of one is compared, a wider one is searched from both sides
            a, b = a + (found < value), np.where(found > value, a, b)
            for side in ("left", "right"):
                wide = np.flatnonzero((found < value) & (b > a)) if side == "left" else np.flatnonzero(b - a > 1)
                lo, hi = a[wide], b[wide].copy()
                while True:
                    going = np.flatnonzero(lo < hi)
                    if not len(going):
                        break
                    middle = (lo[going] + hi[going]) // 2
                    got = mine[self.at[middle] + depth].astype(np.uint64)
                    up = got < value[wide[going]] if side == "left" else got <= value[wide[going]]
                    lo[going] = np.where(up, middle + 1, lo[going])
                    hi[going] = np.where(up, hi[going], middle)
                if side == "left":
                    a[wide] = lo
                else:
                    b[wide] = lo
            rest = np.flatnonzero(b > a)
            same = mine[self.at[a[rest]] + depth].astype(np.uint64) == value[rest]
            b[rest[~same]] = a[rest[~same]]
            low[open_], high[open_] = a, b
            open_ = open_[b > a]
        return low, high > low

    def merged(self, other: Level, length: int) -> Level:
        """Both as one; they have no suffix in common."""
        place, _ = self.scan(other, length)
        out = Level.__new__(Level)
        out.text = np.concatenate([self.text, other.text])
        out.at = np.insert(self.at, place, other.at + len(self.text))
        out.names, out.first = np.insert(self.names, place, other.names), np.insert(self.first, place, other.first)
        return out


class SuffixFamily:
    """Suffix arrays in levels of growing size, over different suffixes: of equal ones the first stands for all."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length, self.levels, self.size = length, [], 0
        self.matched: list[np.ndarray] = []

    def add(self, text: np.ndarray, at: np.ndarray) -> None:
        """Index the suffixes ``at`` (ascending) of a batch and note each that matches another, in it or in a level."""
        text = np.concatenate([text, np.zeros(8, np.uint8)])
        places, common = suffix_array(text, at, self.length)
        names = np.searchsorted(at, places) + self.size
        self.size += len(at)
        same = common == self.length
        self.matched += [names[same], names[:-1][same[1:]]]
        new = Level(text, places[~same], names[~same])
        for level in self.levels:
            place, hit = level.scan(new, self.length)
            self.matched += [new.names[hit], level.names[place[hit]]]
            if hit.any():
                new.at, new.names, new.first = new.at[~hit], new.names[~hit], new.first[~hit]
        if not len(new.at):
            return
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2].at) <= 2 * len(self.levels[-1].at):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last, self.length)

    def marks(self) -> np.ndarray:
        out = np.zeros(self.size, bool)
        for m in self.matched:
            out[m] = True
        return out


def _family(length: int):
    schema = pa.schema([("k", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, owners, rows, starts, held = SuffixFamily(length), [], [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                w0 = part.column(1).to_numpy()
                data, off = utf8(part.column(2))
                data, off = data[off[0] : off[-1]], off - off[0]
                row = np.repeat(np.arange(len(w0)), np.diff(off))
                at = np.flatnonzero(np.arange(len(data)) + length <= off[row + 1])
                family.add(data, at)
                owners.append(part.column(0))
                rows.append((row[at] + held).astype(np.int32))
                starts.append((w0[row[at]] + at - off[row[at]]).astype(np.int32))
                held += len(w0)
        if not owners:
            return
        marks = family.marks()
        r, s = np.concatenate(rows)[marks], np.concatenate(starts)[marks]
        if not len(r):
            return
        cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])
        end = np.r_[cut[1:], len(r)] - 1
        keys = pa.chunked_array(owners)
        for i in range(0, len(cut), 50_000):
            c, e = cut[i : i + 50_000], end[i : i + 50_000]
            k = keys.take(pa.array(r[c])).combine_chunks().cast(pa.binary())
            yield pa.RecordBatch.from_arrays([k, pa.array(s[c]), pa.array(s[e] + np.int32(length))], schema=schema)

    return run


def _cutter(keep_text: bool):
    names = ["k", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for start, stop in sorted((s["start"], s["stop"]) for s in batch.column(1)[row].as_py()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], stop)
                    else:
                        merged.append([start, stop])
                edges = [0, *[x for m in merged for x in m], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((batch.column(0)[row].as_py(), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "replace")] * keep_text))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the kept text."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("k", F.unhex(F.substring(F.sha2("text", 256), 1, 32))).withColumn("row", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    every = durable(own.select("doc_id", "k", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "repeats-texts", "zstd")
    classes = every.groupBy("k").agg(F.count("*").alias("copies"), F.min("row").alias("row"))
    places = own.select("k", "text").mapInArrow(_anchors(length), "least long, k binary, w0 int, w1 int, twice boolean, print long")
    shared = places.repartition("least").sortWithinPartitions("least", "k", "w0").mapInArrow(_shared(hot), "least long, k binary, w0 int, w1 int, hot boolean")
    by_text = shared.groupBy("k").agg(F.collect_set(F.struct("least", "w0", "w1", "hot")).alias("places")).join(classes.hint("merge"), "k")
    cut = own.select("k", "row", "text").join(by_text.select("k", "row", "places").hint("merge"), ["k", "row"]).select("k", "places", F.col("text").cast("binary").alias("text"))
    parts = durable(cut.mapInArrow(_segments(length), "least long, k binary, w0 int, w1 int, part binary"), "repeats-parts", "zstd")
    spans = (parts.where("part is not null").repartition("least").select("k", "w0", "part").mapInArrow(_family(length), "k binary, start int, stop int")
             .union(parts.where("part is null").select("k", "w0", (F.col("w1") + length).alias("stop"))))
    single = classes.where("copies = 1").select("k", "row")
    lists = spans.groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).join(single.hint("merge"), "k")
    texts = own.select("k", "row", "text").join(lists.hint("merge"), ["k", "row"]).select("k", "spans", F.col("text").cast("binary").alias("text"))
    found = durable(texts.mapInArrow(_cutter(keep_text), "k binary, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text), "repeats-found")
    out = every.join(classes.select("k", "copies").hint("merge"), "k").join(found.hint("merge"), "k", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.sha2(F.lit(""), 256)
    done = out.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(gone, none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *[F.when(gone, "").otherwise(F.col("kept")).alias("kept_if_cut")] * keep_text, *["row", "k"] * keep_text)
    if not keep_text:
        return done
    return done.join(own.select("k", "row", "text").dropDuplicates(["k", "row"]), ["k", "row"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("kept_if_cut", "text").alias("text"))


def op8_suffix_array_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
