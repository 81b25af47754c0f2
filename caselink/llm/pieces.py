"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Every distinct word of a batch becomes a row of symbols in one flat numpy array. A round looks up the rank of each
adjacent pair, takes the minimum per word (a segmented reduction), merges the leftmost such pair of every word at once
(all of its occurrences where no better pair can arise from merging it), and compacts the array; words without a
mergeable pair leave it. What no piece covers falls back to its UTF-8 bytes. A word above 256 characters would need many
rounds of its own; such words are merged one pair at a time from a heap, to the same ids.

No piece of the vocabulary contains a space mark after another character or, in most vocabularies, a line feed, so words
are independent: this is checked on the vocabulary, and texts are only cut where no piece can reach across.

Edge cases: null and empty texts have no ids and decode to the empty text; long words cost rounds in the number of their
different merges; a null id is kept; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.session import ship

MARK = "▁"
NONE = np.int64(2**40)
LONG = 256
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        elif key & 7 == 5:
            value, i = b[i : i + 4], i + 4
        elif key & 7 == 1:
            value, i = b[i : i + 8], i + 8
        else:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """The vocabulary of a .model file of the BPE kind with the identity normaliser."""

    def __init__(self, path: str) -> None:
        pieces: list[tuple[str, float, int]] = []
        normal = {3: 1, 4: 1, 5: 1}
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    x = dict(_fields(value))
                    pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, b"\0" * 4))[0], x.get(3, NORMAL)))
                elif field == 3:
                    normal |= {k: v for k, v in _fields(value) if k in (2, 3, 4, 5)}
        assert not normal.get(2), "only the identity normaliser is supported"
        assert not normal[4] and normal[5], "white space must be kept and escaped"
        self.prefix = bool(normal[3])
        self.pieces = [p for p, _, _ in pieces]
        self.types = [t for _, _, t in pieces]
        self.unk = self.types.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        assert USER not in self.types and UNUSED not in self.types, "user-defined and unused pieces aren't supported"
        scores = sorted({-s for _, s, t in pieces if t == NORMAL})
        dense = {s: i for i, s in enumerate(scores)}
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.rank = {p: dense[-s] for p, s, t in pieces if t == NORMAL}
        self.cuts = "".join(c for c in "\n\t" if not any(c in p and len(p) > 1 for p in self.ids))
        assert not any(MARK in p.lstrip(MARK) for p in self.ids), "pieces reach across words"
        # Symbols are numbered: characters and pieces that occur in merges. pair (a, b) -> (rank, merged)
        self.symbol: dict[str, int] = {}
        for p in self.ids:
            self.symbol.setdefault(p, len(self.symbol))
        keys, ranks, merged = [], [], []
        least = np.full(len(self.symbol), NONE)
        for p, r in self.rank.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(r)
                    merged.append(self.symbol[p])
                    least[a] = min(least[a], r)
                    least[b] = min(least[b], r)
        order = np.argsort(np.array(keys))
        self.keys, self.ranks, self.merged = (np.array(x, np.int64)[order] for x in (keys, ranks, merged))
        own = np.array([self.rank[p] for p in self.symbol], np.int64)
        self.safe = (least > own)[self.merged]  # merging it can't give rise to a pair that goes first
        self.names = list(self.symbol)
        self.piece_of = np.array([self.ids[p] for p in self.symbol], np.int64)
        # a letter and a mark that no piece holds in this order can be cut apart too
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        joined = {p[i + 1] for p in self.ids for i in range(len(p) - 1) if re.match(f"[{letters}]", p[i])}
        marks = re.escape("".join(c for c in ",.!?;:%$&#*|" if c not in joined))
        whole = f"{MARK}*[^{MARK}{self.cuts}]+|{MARK}+" + (f"|[{self.cuts}]" if self.cuts else "")
        self.word = re.compile((f"{MARK}*[^{MARK}{self.cuts}{marks}]++(?<=[{letters}])(?=[{marks}])|" if marks else "") + whole)

    def words(self, text: str) -> list[str]:
        return self.word.findall((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else []

    def _ids(self, name: str) -> list[int]:
        i = self.ids.get(name)
        return [i] if i is not None else [self.byte[b] for b in name.encode("utf-8", "surrogatepass")] if self.byte else [self.unk]

    def segment_long(self, word: str) -> list[int]:
        """Ids of one word, its best leftmost pair merged again and again."""
        part: list[str | None] = list(word)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        rank = self.rank.get
        queue = [(r, i, 2) for i in range(len(part) - 1) if (r := rank(part[i] + part[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = right[i] if part[i] is not None else len(part)
            if j >= len(part) or len(part[i]) + len(part[j]) != size:
                continue
            part[i], part[j], right[i] = part[i] + part[j], None, right[j]
            if right[i] < len(part):
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < len(part) and (r := rank(part[a] + part[b])) is not None:
                    heapq.heappush(queue, (r, a, len(part[a]) + len(part[b])))
        return [i for x in part if x is not None for i in self._ids(x)]

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        if any(len(w) > LONG for w in words):
            short = iter(self.segment([w for w in words if len(w) <= LONG]))
            return [self.segment_long(w) if len(w) > LONG else next(short) for w in words]
        n = len(words)
        if not n:
            return []
        flat = [c for w in words for c in w]
        known, extra = self.symbol, {}
        base = len(self.names)
        sym = np.array([known[c] if c in known else base + extra.setdefault(c, len(extra)) for c in flat], np.int64)
        names = [*self.names, *extra]
        of = np.repeat(np.arange(n), [len(w) for w in words])
        done_sym, done_of = [], []

        def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(rank, merged symbol) of the pairs that start at these places."""
            pair = sym[at] << 32 | sym[at + 1]
            found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[found] == pair) & (of[at] == of[at + 1])
            return np.where(hit, self.ranks[found], NONE), found

        rank, found = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], found[:-1] = ranked(np.arange(len(sym) - 1))
        while len(sym):
            best = np.full(n, NONE)
            self._minima(best, of, rank)
            going = best[of] < NONE
            if not going.all():
                done_sym.append(sym[~going])
                done_of.append(of[~going])
                sym, of, rank, found = sym[going], of[going], rank[going], found[going]
            here = np.flatnonzero((rank == best[of]) & (rank < NONE))
            if not len(here):
                break
            word = of[here]
            first = np.r_[True, word[1:] != word[:-1]]
            take = first | self.safe[found[here]]
            here, first = here[take], first[take]
            # of overlapping occurrences (a run of neighbours) every second goes
            start = np.r_[True, (np.diff(here) > 1)] | first
            run = np.maximum.accumulate(np.where(start, np.arange(len(here)), 0))
            here = here[(np.arange(len(here)) - run) % 2 == 0]
            sym[here] = self.merged[found[here]]
            keep = np.ones(len(sym), bool)
            keep[here + 1] = False
            sym, of, rank, found = sym[keep], of[keep], rank[keep], found[keep]
            here = here - np.arange(len(here))  # each merge moved what follows by one
            rank[here] = NONE
            at = np.r_[here - 1, here]
            at = at[(at >= 0) & (at < len(sym) - 1)]
            rank[at], found[at] = ranked(at)
        all_sym, all_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_of))
        order = np.argsort(all_of, kind="stable")
        all_sym, all_of = all_sym[order], all_of[order]
        plain = all_sym < base
        ids = self.piece_of[np.where(plain, all_sym, 0)].tolist()
        ends = np.searchsorted(all_of, np.arange(n), "right").tolist()
        out, lo = [], 0
        for hi in ends:
            out.append(ids[lo:hi])
            lo = hi
        for w in np.unique(all_of[~plain]).tolist():
            lo = ends[w - 1] if w else 0
            out[w] = [i for s in all_sym[lo : ends[w]].tolist() for i in self._ids(names[s])]
        return out

    @staticmethod
    def _minima(best: np.ndarray, of: np.ndarray, rank: np.ndarray) -> None:
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        best[of[cut]] = np.minimum(best[of[cut]], np.minimum.reduceat(rank, cut))

    def surface(self, ids: list[int]) -> bytes:
        """The bytes of a run of ids, with marks as spaces."""
        return b"".join(bytes([int(self.pieces[i][3:5], 16)]) if self.types[i] == BYTE else self.pieces[i].replace(MARK, " ").encode() for i in ids)

    def decode(self, ids: list[int]) -> str:
        raw = self.surface([i for i in ids if self.types[i] != CONTROL])
        return self.trimmed(raw)

    def trimmed(self, raw: bytes) -> str:
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


class WordIds(dict):
    """word: its ids joined by commas. ``odd`` has the surface of words whose pieces don't spell them."""

    def __init__(self, model: PieceModel, most: int = 600_000) -> None:
        self.odd: dict[str, bytes] = {}
        self.model, self.most = model, most

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            self.odd.clear()
            new = list(words)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            for w, ids in zip(part, self.model.segment(part), strict=True):
                self[w] = ",".join(map(str, ids))
                if (surface := self.model.surface(ids)) != w.replace(MARK, " ").encode("utf-8", "surrogatepass"):
                    self.odd[w] = surface

    def surface(self, words: list[str]) -> bytes:
        """The bytes that the ids of these words decode to, the leading space included."""
        if self.odd and not self.odd.keys().isdisjoint(words):
            return b"".join(self.odd.get(w) or w.replace(MARK, " ").encode() for w in words)
        return "".join(words).replace(MARK, " ").encode("utf-8", "surrogatepass")


_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _mapper(path: str, column: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(model_of(path))
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                split, total = [], 0
                while lo + len(split) < batch.num_rows and total < 200_000:
                    split.append(known.model.words(batch.column(column)[lo + len(split)].as_py() or ""))
                    total += len(split[-1])
                known.learn(set().union(*split))
                part = batch.slice(lo, len(split))
                lo += len(split)
                rows = [",".join(map(known.__getitem__, words)) for words in split]
                if kind == "digest":
                    new = [pa.array([r.count(",") + 1 if r else 0 for r in rows], pa.int64()),
                           pa.array([hashlib.sha256(r.encode()).hexdigest() for r in rows], pa.string()),
                           pa.array([hashlib.sha256(known.model.trimmed(known.surface(w)).encode()).hexdigest() for w in split], pa.string())]
                    yield pa.RecordBatch.from_arrays([*part.columns[:column], *new], names=[*part.schema.names[:column], "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ids = pa.array([np.fromstring(r, np.int32, sep=",") if r else np.zeros(0, np.int32) for r in rows], pa.list_(pa.int32()))
                    new = {"ids": ids}
                    if kind == "both":
                        new["decoded"] = pa.array([known.model.trimmed(known.surface(w)) for w in split], pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], names=[*part.schema.names, *new])

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the piece ids of ``text_col`` without begin or end; it replaces a column of that name."""
    ship(docs.sparkSession)
    docs = docs.drop("ids")
    return docs.mapInArrow(_mapper(path, docs.columns.index(text_col), "ids"), f"{_ddl(docs)}, ids array<int>")


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, the text these decode to, in one pass; they replace columns of these names."""
    ship(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    return docs.mapInArrow(_mapper(path, docs.columns.index(text_col), "both"), f"{_ddl(docs)}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids_col``; it replaces a column of that name."""
    ship(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    at = encoded.columns.index(ids_col)

    def run(batches):
        model = model_of(path)
        for batch in batches:
            texts = pa.array([model.decode(x or []) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{_ddl(encoded)}, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the comma-joined ids and of the text decoded from them."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_mapper(path, 1, "digest"), f"{_ddl(own.select('doc_id'))}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece_merge_rounds(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), piece_model())
