"""Exact token counts at every prefix by dynamic programming over a byte-level BPE vocabulary.

The tokens of a prefix end in exactly one token: the one that is a suffix of the prefix and may stand after the last
token of what is left before it. So the last token and the count at prefix p follow from those at p minus the token's
length, and one pass stores the count at every prefix; truncation and budget questions are then look-ups. Two tokens may
stand next to each other when encoding their bytes gives just these two; such answers are kept per worker.

The pass runs over all new distinct words of a batch at once, position by position, in numpy. Texts are first cut where
no word of the pre-splitting pattern can reach across, and counts of pieces that were seen before are looked up.

Edge cases: null and empty texts have 0 bytes and 0 tokens; special strings of the vocabulary file inside a text are one
token each, as its library has it; a null id is kept; repeated rows give repeated rows; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.session import ship

#: The pre-splitting pattern of byte-level BPE, and Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "\t-\r \x85\xa0  -     　"
BASE = np.uint64(0x100000001B3)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre = file["pre_tokenizer"]
        assert pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and file["normalizer"] is None
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in file["added_tokens"]]
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
        self.tokens = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y = number[raw(a)], number[raw(b)]
            new = self.tokens[x] + self.tokens[y]
            if new not in number:
                number[new] = len(self.tokens)
                self.tokens.append(new)
            self.merges[x, y] = (r, number[new])
        self.number = number
        by_length: dict[int, list[int]] = {}
        for t, i in number.items():
            by_length.setdefault(len(t), []).append(i)
        self.by_length = {}
        for n, ids in by_length.items():
            h = np.array([self.hash(self.tokens[i]) for i in ids], np.uint64)
            order = np.argsort(h)
            self.by_length[n] = (h[order], np.array(ids, np.int64)[order])
        self.longest = max(by_length)
        self.adjacent: dict[int, bool] = {}
        self.split = regex.compile(PATTERN)
        self.unit = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")

    @staticmethod
    def hash(b: bytes) -> int:
        h = 0
        for x in b:
            h = (h * int(BASE) + x + 1) & (2**64 - 1)
        return h

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of the two tokens encode to just these two."""
        key = a << 32 | b
        if key not in self.adjacent:
            part = list(self.tokens[a] + self.tokens[b])
            while len(part) > 1:
                found = [(self.merges[p][0], i) for i, p in enumerate(zip(part, part[1:], strict=False)) if p in self.merges]
                if not found:
                    break
                rank, i = min(found)
                part[i : i + 2] = [self.merges[part[i], part[i + 1]][1]]
            if len(self.adjacent) > 2_000_000:
                self.adjacent.clear()
            self.adjacent[key] = part == [a, b]
        return self.adjacent[key]

    def prefix_counts(self, words: list[bytes]) -> list[np.ndarray]:
        """For each word the token count of each of its prefixes, from one byte on."""
        out: list[np.ndarray | None] = [None] * len(words)
        size = np.array([len(w) for w in words])
        for lo, hi in ((1, 8), (9, 16), (17, 32), (33, 64)):
            at = np.flatnonzero((size >= lo) & (size <= hi))
            for i in range(0, len(at), 20_000):
                part = at[i : i + 20_000]
                grid = self._pass([words[k] for k in part], hi)
                for row, k in enumerate(part):
                    out[k] = grid[row, 1 : size[k] + 1]
        for k in np.flatnonzero(size > 64):
            out[k] = self._long(words[k])
        return out

    def _pass(self, words: list[bytes], width: int) -> np.ndarray:
        n = len(words)
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        h = np.zeros((n, width + 1), np.uint64)
        power = [np.uint64(1)]
        for p in range(width):
            h[:, p + 1] = h[:, p] * BASE + data[:, p] + np.uint64(1)
            power.append(np.uint64(int(power[-1]) * int(BASE) & (2**64 - 1)))
        last = np.full((n, width + 1), -1, np.int64)
        count = np.zeros((n, width + 1), np.uint16)
        for p in range(1, width + 1):
            open_rows = np.flatnonzero(size >= p)
            for length in range(min(p, self.longest), 0, -1):
                if length not in self.by_length or not len(open_rows):
                    continue
                keys, ids = self.by_length[length]
                want = h[open_rows, p] - h[open_rows, p - length] * power[length]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                if not hit.any():
                    continue
                rows, token = open_rows[hit], ids[at[hit]]
                before = last[rows, p - length]
                ok = np.ones(len(rows), bool)
                if length < p:
                    pair, back = np.unique(before << 32 | token, return_inverse=True)
                    ok = np.array([self.may_follow(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in pair], bool)[back]
                rows, token = rows[ok], token[ok]
                last[rows, p] = token
                count[rows, p] = count[rows, p - length] + 1
                open_rows = open_rows[last[open_rows, p] < 0]
        return count

    def _long(self, word: bytes) -> np.ndarray:
        last, count = [-1], np.zeros(len(word) + 1, np.int64)
        for p in range(1, len(word) + 1):
            for length in range(min(p, self.longest), 0, -1):
                token = self.number.get(word[p - length : p])
                if token is not None and (length == p or self.may_follow(last[p - length], token)):
                    last.append(token)
                    count[p] = count[p - length] + 1
                    break
        return count[1:]


_vocabularies: dict[str, ByteVocabulary] = {}


def vocabulary_of(path: str) -> ByteVocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = ByteVocabulary(path)
    return _vocabularies[path]


class Counts(dict):
    """unit of text: its number of tokens. A unit is white space and what follows it up to the next white space."""

    MOST = 500_000

    def __init__(self, vocabulary: ByteVocabulary) -> None:
        self.v = vocabulary
        self.words: dict[str, int] = {}

    def units(self, text: str) -> tuple[list[str], int]:
        if self.v.special_split and any(s in text for s in self.v.special):
            parts = self.v.special_split.split(text)
            return [u for p in parts for u in self.v.unit.findall(p)], len(parts) - 1
        return self.v.unit.findall(text), 0

    def learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self]
        if len(self) + len(new) > self.MOST:
            self.clear()
            self.words.clear()
            new = list(units)
        split = {u: self.v.split.findall(u) for u in new}
        fresh = list({w for ws in split.values() for w in ws if w not in self.words})
        for w, c in zip(fresh, self.v.prefix_counts([w.encode("utf-8", "surrogatepass") for w in fresh]), strict=True):
            self.words[w] = int(c[-1])
        for u, ws in split.items():
            self[u] = sum(map(self.words.__getitem__, ws))


def prefix_table(text: str, path: str) -> np.ndarray:
    """The token count of every prefix of a text, by its length in UTF-8 bytes from 0 on. A word that a prefix cuts counts
    as the part of it that is left. Where a prefix is split into other words than the text, as it ends in white space, in a
    contraction or in a special string, what follows the last white space before is counted anew.

    Inside a character the count is that of its first bytes.
    """
    v = vocabulary_of(path)
    out, at = [np.zeros(1, np.int64)], 0
    specials = v.special_split.findall(text) if v.special_split else []
    parts = v.special_split.split(text) if v.special_split else [text]
    for i, part in enumerate(parts):
        words = v.split.findall(part)
        for c in v.prefix_counts([w.encode() for w in words]):
            out.append(at + c.astype(np.int64))
            at = int(out[-1][-1])
        if i < len(specials):
            out.append(np.full(len(specials[i].encode()), at + 1))
            at += 1
    table = np.concatenate(out)
    anew = _resplit(text, v, parts, specials)
    if anew:
        offset = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in text)])
        tails = [v.split.findall(text[a:b]) for a, b in anew]
        counts = iter(v.prefix_counts([w.encode("utf-8", "surrogatepass") for ws in tails for w in ws]))
        for (a, b), ws in zip(anew, tails, strict=True):
            table[offset[b]] = table[offset[a]] + sum(int(next(counts)[-1]) for _ in ws)
    return table


def _resplit(text: str, v: ByteVocabulary, parts: list[str], specials: list[str]) -> list[tuple[int, int]]:
    """(from, to) in characters, by ``to``: prefixes that are split otherwise, and where their last unit starts."""
    out, start = [], 0
    for i, part in enumerate(parts):
        at, last = start, start
        for unit in v.unit.findall(part):
            blank = len(unit) - len(unit.lstrip())
            if blank > 1 and blank < len(unit):
                out.append((at, at + blank))
            inside = at
            for word in v.split.findall(unit):
                out += [(at, inside + k) for k in range(2, len(word)) if word[0] == "'" and word[1].isalpha()]
                inside += len(word)
            last, at = at, at + len(unit)
        if i < len(specials):
            out += [(last, at + k) for k in range(1, len(specials[i]))]
            at += len(specials[i])
        start = at
    return sorted(out, key=lambda x: x[1])


def _mapper(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(vocabulary_of(path))
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                split, sizes, total = [], [], 0
                while lo + len(split) < batch.num_rows and total < 200_000:
                    text = batch.column(1)[lo + len(split)].as_py() or ""
                    split.append(counts.units(text))
                    sizes.append(len(text.encode("utf-8", "surrogatepass")))
                    total += len(split[-1][0])
                counts.learn(set().union(*(u for u, _ in split)))
                totals = [sum(map(counts.__getitem__, u)) + s for u, s in split]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(split)), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
                lo += len(split)

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_mapper(path), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def fit_budget(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and kept_bytes, the longest prefix of whole characters with at most ``budget`` tokens, read off the prefix
    table."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            kept = []
            for t in batch.column(1).to_pylist():
                raw = np.frombuffer((t or "").encode(), np.uint8)
                whole = np.r_[(raw & 0xC0) != 0x80, True]
                kept.append(int(np.flatnonzero((prefix_table(t or "", path) <= budget) & whole)[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.int64())], names=["doc_id", "kept_bytes"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, kept_bytes long")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_prefix_token_counts(spark, sf_dir: str) -> DataFrame:
    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_vocabulary())
    return found.withColumn("over_limit", F.col("n_tokens") > 512)
