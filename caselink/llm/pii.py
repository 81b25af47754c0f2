"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, a digit before a dot, digit pairs, a plus before a digit, schemes and
identifier cues. A deterministic parser of each kind then expands an anchor and validates what it got. Base kinds give
the leftmost non-overlapping matches of these patterns, failing matches dropped and not retried:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     four digit groups joined by dots, each at most 255
    card   14 to 19 digits, at most one space or hyphen between two, passing the Luhn check
    phone  a plus, then 10 to 15 digits with spaces, brackets, dots and hyphens between them

Added kinds: ``url`` (from a scheme or www. to the next white space, quote or angle bracket, closing punctuation
trimmed) and ``account``, what follows a cue: after IBAN, two letters and two check digits before 11 to 30 letters and
digits, whose remainder by 97 is 1; after others, such as account or passport, at most four letters and then at least
four digits, with single spaces and hyphens between, 6 to 34 characters in all. Schemes and cues may be in any case.

Edge cases: null and empty texts have no spans; a null doc_id is kept as it is; repeated rows give repeated rows; an
empty table gives an empty result; other columns pass ``redact`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.session import ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: What announces an address or an account.
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("iban", "account", "acct", "passport", "ssn", "customer id", "member id")
SPANS = "array<struct<start:int,end:int,kind:string>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"(?:https?://|ftp://|www\.)[^\s\"'<>]+", re.IGNORECASE)
LABEL = r"(?:\s+(?:no\.?|number|id))?[\s:=#]*"
ACCOUNT = re.compile(LABEL + r"([A-Za-z]{0,4}-?[0-9](?:[ -]?[0-9]){3,}[A-Za-z]{0,4})(?![A-Za-z0-9])", re.IGNORECASE)
IBAN = re.compile(LABEL + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.IGNORECASE)
LOWER = {c: c + 32 for c in range(65, 91)}
DIGITS = "0123456789"


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    out.add_word("@", ("email", 1))
    for d in DIGITS:
        out.add_word(d + ".", ("ip", 2))
        out.add_word("+" + d, ("phone", 2))
        for e in DIGITS:
            for gap in ("", " ", "-"):
                out.add_word(d + gap + e, ("card", 2 + len(gap)))
    for x in SCHEMES:
        out.add_word(x, ("url", len(x)))
    for x in CUES:
        out.add_word(x, ("account", len(x)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i & 1:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def iban(found: str) -> bool:
    """Whether the check digits are right: the first four characters go last, letters count from 10, and 97 leaves 1."""
    s = found.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def account_after(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """Where the identifier after a cue stands, if it is valid. An IBAN ends where its check digits are right."""
    m = (IBAN if cue == "iban" else ACCOUNT).match(text, at)
    if not m or m.start(1) == at:
        return None
    if cue != "iban":
        return m.span(1) if 6 <= m.end(1) - m.start(1) <= 34 else None
    # words may follow: shorter readings end at a space
    ends = [m.end(1), *(i for i in range(m.end(1) - 1, m.start(1) + 14, -1) if text[i] == " ")]
    return next(((m.start(1), e) for e in ends if iban(text[m.start(1) : e])), None)


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one text in code points, by start and then kind as listed."""
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)
    # only ASCII letters, so that places stay the same
    for last, (kind, length) in anchors.iter(text.lower() if text.isascii() else text.translate(LOWER)):
        start = last - length + 1
        if kind == "card":
            if start < done[kind]:
                continue
            m = CARD.match(text, start)
            done[kind] = m.end()
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((start, m.end(), kind))
        elif kind == "email":
            low = start
            while low > done[kind] and text[low - 1] in LOCAL:
                low -= 1
            if low < start and (m := DOMAIN.match(text, start + 1)):
                done[kind] = m.end()
                out.append((low, m.end(), kind))
        elif kind == "ip":
            if start < done[kind]:
                continue
            while start > done[kind] and text[start - 1] in DIGITS:
                start -= 1
            if m := IP.match(text, start):
                done[kind] = m.end()
                if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                    out.append((start, m.end(), kind))
        elif kind == "phone":
            if m := PHONE.match(text, start):
                if 10 <= sum(c in DIGITS for c in m.group()) <= 15:
                    out.append((start, m.end(), kind))
        elif start >= done[kind]:
            if kind == "url":
                m = URL.match(text, start)
                if m and len(found := m.group().rstrip(".,;:!?)]}*_")) > length:
                    done[kind] = start + len(found)
                    out.append((start, done[kind], kind))
            elif (start == 0 or not text[start - 1].isalnum()) and (found := account_after(text, last + 1, text[start : last + 1].lower())):
                done[kind] = found[1]
                out.append((*found, kind))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[0], rank[x[2]]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _mapper(column: int, hide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(column).to_pylist()
                found = [spans_of(t, anchors) if t else [] for t in texts]
                if hide:
                    new = pa.array([masked(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
                    yield part.set_column(column, part.schema.names[column], new)
                else:
                    new = pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in x] for x in found], kind)
                    yield pa.RecordBatch.from_arrays([*part.columns[:column], new], names=[*part.schema.names[:column], "spans"])

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all spans of its text, each {start, end, kind}."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_mapper(1, False), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_mapper(docs.columns.index(text_col), True), docs.schema)


def op2_pii_anchor_expansion(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = "('email', 'ip', 'card', 'phone')"
    written = "transform({}, s -> concat(s.kind, ':', s.start, ':', s.end))"
    return found.selectExpr(
        "doc_id", *[f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}" for k in BASE],
        f"sha2(array_join({written.format(f'filter(spans, s -> s.kind in {base})')}, ','), 256) as base_sha256",
        f"array_join({written.format('spans')}, ',') as spans")
