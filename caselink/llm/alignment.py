"""Alignment of two tokenizers' ids by the byte offsets where tokens of both end.

Of a stretch of text, each tokenizer's cumulative ends become a dictionary from end to index. The intersection of the
two key sets, sorted, slices both id lists into groups, and each slice is expanded into its links: all pairs of one id of
A and one id of B. Texts are handled as the stretches they consist of: white space and what follows it, which no token of
either tokenizer reaches beyond, so a stretch is encoded and sliced once per worker however often it occurs.

How many documents hold a link is a corpus-wide count. Workers number the different links of a chunk of documents and
write documents as (number, times) lists beside the chunk's table of links; only these tables are exchanged, so a link that
every document holds travels once a chunk. The counts come back to the chunk and are looked up by number.

Edge cases: null and empty texts, and texts that the joined bytes of either side don't spell (as where a text holds the
space mark itself), have no tokens: zeros and an empty digest; special strings inside texts are plain text; a null id is
kept; repeated rows are documents of their own, counted as such; an empty table gives an empty result. Other columns of
the input don't take part, whatever they are called.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.pieces import BYTE, MARK, model_of, piece_model
from caselink.llm.token_counts import BLANK, byte_letters, byte_vocabulary
from caselink.session import durable, ship

LOW = 2**32 - 1


class ByteEncoder:
    """Ids of a byte-level vocabulary, special strings being plain text, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre = file["pre_tokenizer"]
        assert pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and file["normalizer"] is None
        letters = byte_letters()
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in file["model"]["vocab"].items() if all(c in letters for c in t)}
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.sizes = np.zeros(max(self.size) + 1, np.int64)
        self.sizes[list(self.size)] = list(self.size.values())

    def encode(self, parts: list[str], joined: int) -> list[int]:
        """Ids of all parts, one after the other. Of the first ``joined``, hundreds go through the library as one text."""
        texts = ["".join(parts[i : min(i + 256, joined)]) for i in range(0, joined, 256)] + parts[joined:]
        return list(chain.from_iterable(e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)))


def _spans(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one after the other."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(first - starts, sizes)


def slices(a: list[int], b: list[int], a_size: dict[int, int], b_size: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the groups of two id lists that spell the same bytes end, in A, in B and in bytes: both are cut where an end
    is in both dictionaries."""
    a_at = dict(zip(accumulate(map(a_size.__getitem__, a)), range(1, len(a) + 1), strict=True))
    b_at = dict(zip(accumulate(map(b_size.__getitem__, b)), range(1, len(b) + 1), strict=True))
    ends = sorted(a_at.keys() & b_at.keys())
    array = lambda x: np.fromiter(x, np.int64, len(ends))
    return array(map(a_at.__getitem__, ends)), array(map(b_at.__getitem__, ends)), array(ends)


WIDE = 4096


def links(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, link, times) of all groups, by group: every pair of one id of A and one of B. A link is both ids in one
    number. In groups of more than ``WIDE`` pairs equal links are counted at once, in others they stand for themselves."""
    m, n = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
    many = np.flatnonzero(m * n > WIDE)
    sizes = m * n
    sizes[many] = 0
    group = np.repeat(np.arange(len(m)), sizes)
    place = _spans(sizes, np.zeros(len(m), np.int64))
    link = a[(a_end - m)[group] + place // n[group]] << 32 | b[(b_end - n)[group] + place % n[group]]
    times = np.ones(len(link), np.int64)
    for g in many.tolist():
        x, i = np.unique(a[a_end[g] - m[g] : a_end[g]], return_counts=True)
        y, j = np.unique(b[b_end[g] - n[g] : b_end[g]], return_counts=True)
        group = np.r_[group, np.full(len(x) * len(y), g)]
        link, times = np.r_[link, (x[:, None] << 32 | y).ravel()], np.r_[times, np.outer(i, j).ravel()]
    if len(many):
        order = np.argsort(group, kind="stable")
        group, link, times = group[order], link[order], times[order]
    return group, link, times


class Stretches(dict):
    """stretch of text: its number. What stretches align to is kept by number."""

    def __init__(self, a_path: str, b_path: str, most: int = 400_000) -> None:
        self.a, self.b, self.most = ByteEncoder(a_path), model_of(b_path), most
        self.b_size = [1 if t == BYTE else len(p.replace(MARK, " ").encode()) for p, t in zip(self.b.pieces, self.b.types, strict=True)]
        free = set(" " + self.b.cuts)  # B ends a token before each of these
        self.blank = {c for c in map(chr, range(0x3001)) if re.match(f"[{BLANK}]", c)}
        self.unsure = self.blank - free
        self.rare = re.compile(f"[{re.escape(''.join(sorted(self.unsure)))}]") if self.unsure else None
        # A starts a word where a letter is followed by one of these marks, and no piece of B holds the two
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        joined = {p[i + 1] for p in self.b.ids for i in range(len(p) - 1) if re.match(f"[{letters}]", p[i])}
        marks = re.escape("".join(c for c in ",.!?;:%$&#*|" if c not in joined))
        cut = f"[{BLANK}]*[^{BLANK}{marks}]++(?<=[{letters}])(?=[{marks}])|" if marks else ""
        self.stretch = re.compile(f"{cut}[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.counts = np.zeros((4, 0), np.int64)  # of A's ids, B's ids, groups and links
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.link, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text: list[str] = []
        self.spelt: list[bool] = []

    def cut(self, text: str | None) -> list[str]:
        """The stretches of a space and ``text``; none where it can't be spelt."""
        if not text or MARK in text:
            return []
        text = " " + text
        parts = self.stretch.findall(text)
        if self.rare is not None and self.rare.search(text):
            out = [parts[0]]
            for p in parts[1:]:
                if p[0] in self.unsure:
                    out[-1] += p
                else:
                    out.append(p)
            return out
        return parts

    def encode_b(self, parts: list[str]) -> tuple[list[int], np.ndarray]:
        """Ids of all parts one after the other, and how many each has."""
        words = [self.b.word.findall(p.replace(" ", MARK)) for p in parts]
        flat = list(chain.from_iterable(words))
        own = list(dict.fromkeys(flat))
        ids = dict(zip(own, self.b.segment(own), strict=True))
        found = list(map(ids.__getitem__, flat))
        sizes = np.add.reduceat(np.fromiter(map(len, found), np.int64, len(found)), np.cumsum([0, *map(len, words)])[:-1])
        return list(chain.from_iterable(found)), sizes

    def learn(self, wanted: set[str]) -> None:
        new = [s for s in wanted if s not in self]
        if len(self) + len(new) > self.most:
            self._reset()
            new = list(wanted)
        for k in range(0, len(new), 50_000):
            self._add(new[k : k + 50_000])

    def _add(self, part: list[str]) -> None:
        """Encode stretches that aren't known yet, and align all of them at once: each one's end is an end of both sides."""
        # a word of A ends where white space follows another character: such stretches can stand one after the other
        whole = [p[0] in self.blank and p[-1] not in self.blank for p in part]
        part = [p for p, w in zip(part, whole, strict=True) if w] + [p for p, w in zip(part, whole, strict=True) if not w]
        a = self.a.encode(part, sum(whole))
        b, n_b = self.encode_b(part)
        raw = [s.encode("utf-8", "surrogatepass") for s in part]
        until = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        ends = np.cumsum(self.a.sizes[a])
        n_a = np.diff(np.searchsorted(ends, until, "right"), prepend=0)
        whole = b"".join(raw)
        if b"".join(map(self.a.bytes.__getitem__, a)) == whole == self.b.surface(b):
            spelt = [True] * len(part)
        else:  # some are spelt otherwise: they don't count, and take part with no ids
            to_a, to_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
            spelt = [b"".join(map(self.a.bytes.__getitem__, a[i:j])) == r == self.b.surface(b[p:q]) for r, i, j, p, q in zip(raw, [0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
            a = [x for ok, i, j in zip(spelt, [0, *to_a], to_a, strict=False) if ok for x in a[i:j]]
            b = [x for ok, i, j in zip(spelt, [0, *to_b], to_b, strict=False) if ok for x in b[i:j]]
            n_a, n_b = n_a * spelt, n_b * spelt
            raw = [r if ok else b"" for r, ok in zip(raw, spelt, strict=True)]
        a_end, b_end, ends = slices(a, b, self.a.size, self.b_size)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        group, link, times = links(a, b, a_end, b_end)
        last = np.searchsorted(ends, np.cumsum([len(r) for r in raw]), "right")  # groups up to each stretch's end
        until = np.searchsorted(group, last)
        size = np.diff(until, prepend=0)
        held = np.diff(np.r_[0, np.cumsum(times)][until], prepend=0)
        names = self._names(a, b, a_end, b_end)
        to = last.tolist()
        self.text += [";".join(names[i:j]) for i, j in zip([0, *to], to, strict=False)]
        self.spelt += spelt
        self.counts = np.concatenate([self.counts, [n_a, n_b, np.diff(last, prepend=0), held]], axis=1)
        self.start, self.size = np.r_[self.start, until - size + len(self.link)], np.r_[self.size, size]
        self.link, self.times = np.r_[self.link, link], np.r_[self.times, times]
        self.update(zip(part, range(len(self), len(self) + len(part)), strict=True))

    @staticmethod
    def _names(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> list[str]:
        """The text of each group."""
        m, n = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        out = np.empty(len(m), object)
        plain = (m == 1) & (n == 1)
        pair, back = np.unique(a[a_end[plain] - 1] << 32 | b[b_end[plain] - 1], return_inverse=True)
        names = np.empty(len(pair), object)
        names[:] = [f"{x >> 32}|{x & LOW}" for x in pair.tolist()]
        out[plain] = names[back]
        left, right = list(map(str, a.tolist())), list(map(str, b.tolist()))
        rest = np.flatnonzero(~plain)
        p, i, q, j = (x[rest].tolist() for x in (a_end - m, a_end, b_end - n, b_end))
        out[rest] = [f"{','.join(left[w:x])}|{','.join(right[y:z])}" for w, x, y, z in zip(p, i, q, j, strict=True)]
        return out.tolist()


def _chunks(column: pa.Array, known: Stretches, size: int) -> Iterator[tuple[int, list[list[str]]]]:
    """(first row, stretches of its rows) in chunks of about ``size`` stretches; a longer text is alone."""
    lo, split, total = 0, [], 0
    for i in range(len(column)):
        parts = known.cut(column[i].as_py())
        if split and total + len(parts) > size:
            yield lo, split
            lo, split, total = i, [], 0
        split.append(parts)
        total += len(parts)
    if split:
        yield lo, split


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
HELD = f"chunk long, {DOCUMENT}, at binary, times binary, links binary, docs binary"
FIELDS = [("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
          *((c, pa.binary()) for c in ("at", "times", "links", "docs"))]


def _held(a_path: str, b_path: str, size: int):
    """Documents as (number of a link, times) lists, and a row for each chunk with its links by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, turn = Stretches(a_path, b_path), 0
        task = TaskContext.get().partitionId() << 32
        gc.disable()  # nothing here is circular, and there are millions of objects to look through
        for batch in batches:
            for lo, split in _chunks(batch.column(1), known, size):
                known.learn(set().union(*split))
                n = len(split)
                rows = [list(map(known.__getitem__, parts)) for parts in split]
                if not all(known.spelt):
                    rows = [r if all(map(known.spelt.__getitem__, r)) else [] for r in rows]
                sha = [hashlib.sha256(";".join(map(known.text.__getitem__, r)).encode()).hexdigest() if r else "" for r in rows]
                sizes = np.array([len(r) for r in rows])
                flat = np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum()))
                of = np.repeat(np.arange(n), sizes)
                used, which = np.unique(flat, return_inverse=True)
                counts = [np.bincount(of, known.counts[i][flat], n).astype(np.int64) for i in range(4)]
                at, times, ends, table, docs = _tally(known, used, which, of, n)
                cut = lambda x: [x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]  # noqa: E731, B023
                here = task | turn
                turn += 1
                cols = [[here] * (n + 1), [*batch.column(0).slice(lo, n).to_pylist(), None], *([*c.tolist(), 0] for c in counts), [*sha, ""],
                        [*cut(at), None], [*cut(times), None], [None] * n + [table.tobytes()], [None] * n + [docs.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)], names=[c for c, _ in FIELDS])
        gc.enable()

    return run


def _tally(known: Stretches, used: np.ndarray, which: np.ndarray, of: np.ndarray, n: int):
    """Numbers and times of the links of ``n`` documents, where each one's end, the links by number, and their documents."""
    if not len(of):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, often = np.unique(of * len(used) + which, return_counts=True)
    doc, unit = own // len(used), own % len(used)
    sizes, starts = known.size[used], known.start[used]
    table, number = np.unique(known.link[_spans(sizes, starts)], return_inverse=True)
    number, each = number.astype(np.int64), known.times[_spans(sizes, starts)]
    place = _spans(sizes[unit], (np.cumsum(sizes) - sizes)[unit])
    key = np.repeat(doc, sizes[unit]) * len(table) + number[place]
    weight = np.repeat(often, sizes[unit]) * each[place]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, times = key[first], np.add.reduceat(weight, first)
    at = (key % len(table)).astype(np.int32)
    ends = np.searchsorted(key, np.arange(n + 1) * len(table))
    return at, times, ends, table, np.bincount(at, minlength=len(table)).astype(np.int64)


def _links_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, table, docs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            table, docs = np.frombuffer(table, np.int64), np.frombuffer(docs, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(table), chunk)), pa.array(np.arange(len(table), dtype=np.int32)), pa.array(table), pa.array(docs)], names=["chunk", "at", "link", "docs"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted so that a chunk's counts come, by number, before its documents: the documents, summed up."""
    chunk, counts, best = None, [], []
    for batch in batches:
        of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]), True])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if of[lo] != chunk:
                chunk, counts, best = of[lo], [], []
            part = batch.slice(lo, hi - lo)
            if kind[lo] == 0:
                counts.append(part.column(3).to_numpy())
                best.append(part.column(4).to_numpy(zero_copy_only=False))
                continue
            counts, best = ([np.concatenate(x)] if x else [np.zeros(0, np.int64)] for x in (counts, best))
            held, times = part.column(11).to_pylist(), np.frombuffer(b"".join(part.column(12).to_pylist()), np.int64)
            at = np.frombuffer(b"".join(held), np.int32)
            ends = np.cumsum([0, *(len(h) // 4 for h in held)])
            sums = [np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (times * best[0][at], times * counts[0][at])]
            yield pa.RecordBatch.from_arrays([*part.columns[5:11], *(pa.array(s, pa.int64()) for s in sums)], names=[*part.schema.names[5:11], "n_best", "count_sum"])


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 400_000) -> DataFrame:
    """Per document its tokens, groups and links, the digest of its groups, and its links weighed by how many documents
    hold them: n_best (those that no link of their A id beats) and count_sum. Chunks are of ``size`` stretches."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = durable(own.mapInArrow(_held(a_path, b_path, size), HELD), "align-held")
    tables = held.where("links is not null").select("chunk", "links", "docs")
    seen = tables.mapInArrow(_links_of_chunks, "chunk long, at int, link long, docs long")
    count = seen.groupBy("link").agg(F.sum("docs").alias("count"))
    high = F.shiftrightunsigned("link", 32).alias("a")
    count = durable(count.select("link", "count", high), "align-counts")
    top = count.groupBy("a").agg(F.max("count").alias("top"))
    weights = count.join(top, "a").select("link", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times"]
    answers = seen.join(weights, "link").select("chunk", F.lit(0).alias("kind"), F.col("at").alias("place"), "count", "best", *(F.lit(None).cast(held.schema[c].dataType).alias(c) for c in columns))
    papers = held.where("links is null").select("chunk", F.lit(1).alias("kind"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("best"), *columns)
    both = answers.unionByName(papers).repartition("chunk").sortWithinPartitions("chunk", "kind", "place")
    return both.mapInArrow(_weighed, f"{DOCUMENT}, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``groups``, an array of (a, b): the ids of either side that share a group, in order."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches):
        known = Stretches(a_path, b_path)
        for batch in batches:
            for lo, split in _chunks(batch.column(1), known, 50_000):
                known.learn(set().union(*split))
                out = []
                for parts in split:
                    rows = [known[p] for p in parts]
                    spelt = all(map(known.spelt.__getitem__, rows))
                    sides = (side.split("|") for r in rows if spelt for side in known.text[r].split(";"))
                    out.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in sides])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(split)), pa.array(out, kind)], names=["doc_id", "groups"])

    return own.mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_vocabulary(), piece_model())
