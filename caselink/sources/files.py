"""Sources and sinks: registers, case documents, labelled URL files, feeds, file fingerprints and split tables."""

from __future__ import annotations

import re

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The registers and their columns; every field is text on disk.
REGISTERS = {
    "cases": ("case_id", "created_at", "title", "notes", "evidence_count"),
    "evidence": ("evidence_id", "case_id", "original_file_name", "stored_file_name", "file_extension", "file_size_bytes", "sha256_before", "sha256_after", "hash_verified", "upload_time", "processing_time", "status", "investigator_notes"),
    "entities": ("case_id", "evidence_id", "entity_type", "value", "normalized", "extracted_at"),
    "keyword_statistics": ("case_id", "evidence_id", "keyword", "count", "category", "analyzed_at"),
    "processing_log": ("timestamp", "case_id", "evidence_id", "stage", "level", "message", "duration_ms"),
}
CASTS = {"evidence_count": "int", "file_size_bytes": "bigint", "hash_verified": "boolean", "count": "int", "duration_ms": "double", "created_at": "timestamp", "upload_time": "timestamp", "extracted_at": "timestamp", "analyzed_at": "timestamp", "timestamp": "timestamp"}


def read_registers(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The CSV registers of a folder, cast on reading; one that isn't there is an empty table."""
    out = {}
    for name, columns in REGISTERS.items():
        schema = StructType([StructField(c, StringType()) for c in columns])
        try:
            df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{name}.csv")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = spark.createDataFrame([], schema)
        out[name] = df.withColumns({c: F.col(c).try_cast(CASTS[c]) for c in columns if c in CASTS})
    return out


def read_case_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row an item of JSON case documents with an evidence array; a document a file, or a document a line."""
    schema = "case_id string, created_at string, evidence array<struct<evidence_id:string,raw_text:string,average_confidence:double>>"
    return spark.read.schema(schema).option("multiLine", one_per_file).json(path).select("case_id", F.explode("evidence").alias("e")).select("case_id", F.col("e.evidence_id").alias("item_id"), F.col("e.raw_text").alias("text"), F.col("e.average_confidence").alias("confidence"))


#: Names of URL and label columns, in the order they are tried.
URL_NAMES = ("url", "urls", "website", "link", "links", "uri", "address", "site", "web_url", "webpage", "page_url", "phish_url", "domain")
LABEL_NAMES = ("label", "labels", "is_phishing", "phishing", "class", "target", "result", "type", "status", "verdict", "category", "classification", "is_malicious", "malicious", "phish", "y")
#: Words of a label column.
LABELS = {
    "0": 0, "1": 1, "0.0": 0, "1.0": 1, "true": 1, "false": 0, "yes": 1, "no": 0, "phishing": 1, "phish": 1, "malicious": 1, "bad": 1, "fraud": 1, "suspicious": 1, "malware": 1,
    "defacement": 1, "spam": 1, "scam": 1, "attack": 1, "unsafe": 1, "legitimate": 0, "legit": 0, "benign": 0, "good": 0, "normal": 0, "clean": 0, "safe": 0, "genuine": 0, "trusted": 0,
}
SIGNED = {"-1": 0, "-1.0": 0, "1": 1, "1.0": 1}
#: Words in a file's name that say what all its URLs are.
SAFE_NAMES = ("legit", "benign", "tranco", "alexa", "top-sites", "topsites", "whitelist", "majestic", "umbrella")
BAD_NAMES = ("phish", "malicious", "fraud", "scam", "openphish", "blacklist")
#: What a URL or a domain looks like; a user name is only one after a scheme.
URL_LIKE = r"(?i)^(?:[a-z][a-z0-9+.-]*://(?:[^\s/@]+@)?)?[a-z0-9\x{00A1}-\x{FFFF}-]+(?:\.[a-z0-9\x{00A1}-\x{FFFF}-]+)+(?:[:/?#]\S*)?$"
SEPARATORS = (",", "\t", ";", "|")


def sniff_layout(spark: SparkSession, path: str, lines: int = 50) -> dict[str, str]:
    """{"kind": json, jsonl, csv or lines; "sep"} from the first lines of the files: a JSON value, an object a line, lines
    that all hold the same number of a separator (the one they hold most of), or a value a line."""
    head = [r.value for r in spark.read.text(path).where("trim(value) <> ''").limit(lines).collect()]
    if not head:
        return {"kind": "lines", "sep": ""}
    first = head[0].lstrip("\ufeff").strip()
    if first.startswith("{") and first.endswith("}"):
        return {"kind": "jsonl", "sep": ""}
    if first[:1] in "[{":
        return {"kind": "json", "sep": ""}
    # a quoted field may hold separators: it counts as one character
    bare = [re.sub(r'"[^"]*"', "q", x) for x in head]
    even = [(bare[0].count(s), -i, s) for i, s in enumerate(SEPARATORS) if bare[0].count(s) and sum(x.count(s) == bare[0].count(s) for x in bare) >= 0.9 * len(bare)]
    return {"kind": "csv", "sep": max(even)[2]} if even else {"kind": "lines", "sep": ""}


def profile_columns(raw: DataFrame) -> DataFrame:
    """A row for each column: rows with a value, shares of URL-like values and of label words, how many different values
    (up to a few per cent), and whether all are numbers or all are -1 and 1. One aggregation over all rows."""
    value = lambda c: F.lower(F.trim(F.col(f"`{c}`")))
    share = lambda t: F.coalesce(F.avg(t.cast("double")), F.lit(0.0))
    aggs = []
    for c in raw.columns:
        v = value(c)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("n"), F.round(share((F.length(v) < 4096) & v.rlike(URL_LIKE)), 6).alias("urls"), F.round(share(v.isin(*LABELS, "-1", "-1.0")), 6).alias("labels"),
                             F.approx_count_distinct(v).alias("different"), F.round(share(v.isin(*(w for w in LABELS if w.isalpha()))), 6).alias("words"), F.coalesce(F.bool_and(v.try_cast("double").isNotNull()), F.lit(False)).alias("numeric"),
                             F.coalesce(F.bool_and(v.isin(*SIGNED)), F.lit(False)).alias("signed")))
    return raw.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*") if raw.columns else raw.sparkSession.createDataFrame([], "column string, n long, urls double, labels double, different long, words double, numeric boolean, signed boolean")


def column_roles(profile: DataFrame, least_urls: float = 0.7, least_labels: float = 0.5, most_labels: int = 10) -> tuple[str | None, str | None, bool]:
    """(URL column, label column, whether labels are -1 and 1) from a profile, a row a column: known names come first,
    then what the values look like. A column of numbers without a label's name is never a label."""
    rows = {r.column: r for r in profile.collect()}  # as many as there are columns
    named = {c.strip().lower(): c for c in rows}
    url = next((named[n] for n in URL_NAMES if n in named and rows[named[n]].urls >= least_urls), None)
    if url is None:
        best = max((r for r in rows.values() if not r.numeric), key=lambda r: r.urls, default=None)
        url = best.column if best is not None and best.urls > least_urls else None
    fits = lambda r: r.n and r.labels >= least_labels and r.different <= most_labels
    label = next((named[n] for n in LABEL_NAMES if n in named and named[n] != url and fits(rows[named[n]])), None)
    if label is None:
        label = next((c for c, r in rows.items() if c != url and r.n and not r.numeric and r.words == 1.0), None)
    return url, label, bool(label) and rows[label].signed


def read_labelled_urls(spark: SparkSession, path: str, kind: str | None = None, sep: str | None = None) -> DataFrame:
    """(url, label) of files of unknown layout: csv with any common separator, a URL a line, JSON, or an object a line.

    Layout and columns are told from the files (``sniff_layout``, ``profile_columns``, ``column_roles``) unless given.
    Labels are mapped to 0 and 1, unknown ones dropped; without a label column the file's name decides, and where it
    doesn't, that is an error.
    """
    found = sniff_layout(spark, path) if kind is None else {"kind": kind, "sep": sep or ","}
    if found["kind"] == "csv":
        raw = spark.read.option("header", True).option("sep", found["sep"]).csv(path)
    elif found["kind"] == "lines":
        raw = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")
    else:
        raw = spark.read.option("multiLine", found["kind"] == "json").json(path)
        lists = [f for f in raw.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
        if lists:  # a wrapper around the rows
            raw = raw.select(F.explode(f"`{lists[0].name}`").alias("r")).select("r.*")
    raw = raw.select(*(F.col(f"`{f.name}`").cast("string").alias(f.name) for f in raw.schema if f.dataType.typeName() not in ("array", "struct", "map")))
    url, label, signed = column_roles(profile_columns(raw))
    if url is None:
        raise ValueError("no column looks like URLs")
    address = F.trim(F.col(f"`{url}`")).alias("url")
    if label is None:
        name = path.rstrip("/").rsplit("/", 1)[-1].lower()
        given = 0 if any(w in name for w in SAFE_NAMES) else 1 if any(w in name for w in BAD_NAMES) else None
        if given is None:
            raise ValueError("no label column, and the name doesn't say what the URLs are")
        return raw.select(address, F.lit(given).alias("label"))
    words = SIGNED if signed else LABELS
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.lower(F.trim(F.col(f"`{label}`"))))
    return raw.select(address, mapped.alias("label")).where("label is not null")


def read_feed(spark: SparkSession, kind: str, path: str, top: int = 300_000) -> DataFrame:
    """(url, label) of five feed shapes: labelled, typed, listed (csv), lines, and ranked (the ``top`` best domains)."""
    csv = lambda: spark.read.option("header", True).csv(path)
    if kind == "labelled":
        return csv().select("url", F.col("label").try_cast("int").alias("label"))
    if kind == "typed":
        return csv().select("url", F.when(F.lower("type") == "benign", 0).otherwise(1).alias("label"))
    if kind == "listed":
        return csv().select("url", F.lit(1).alias("label"))
    if kind == "lines":
        return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("url"), F.lit(1).alias("label"))
    if kind == "ranked":
        return spark.read.schema("rank int, domain string").csv(path).where(F.col("rank") <= top).select(F.concat(F.lit("https://"), "domain").alias("url"), F.lit(0).alias("label"))
    raise ValueError(f"no feed of kind {kind}")


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a public suffix list: a rule a line up to the first blank, comments after two slashes."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("//")).select(F.lower(F.regexp_extract(line, r"^(\S+)", 1)).alias("rule")).distinct()


def write_splits(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(folder)


#: Leading bytes of file formats, in hexadecimal.
MAGIC = {"89504e470d0a1a0a": "png", "25504446": "pdf", "504b0304": "zip", "ffd8ff": "jpg", "47494638": "gif", "1f8b": "gz", "50415231": "parquet"}


def fingerprint_files(spark: SparkSession, folder: str, acquired: DataFrame | None = None) -> DataFrame:
    """Hashes, size, byte entropy, format by leading bytes and its mismatch with the extension, per file; with
    (path, sha256) rows also whether the acquisition hash matches."""

    @F.pandas_udf("double")
    def entropy(content: pd.Series) -> pd.Series:
        def one(b: bytes) -> float:
            n = np.bincount(np.frombuffer(b or b"", np.uint8), minlength=256)
            p = n[n > 0] / max(n.sum(), 1)
            return float(-(p * np.log2(p)).sum())

        return content.map(one)

    c = F.col("content")
    files = spark.read.format("binaryFile").load(folder)
    head = F.lower(F.hex(F.substring(c, 1, 8)))
    magic = F.coalesce(*(F.when(head.startswith(k), v) for k, v in sorted(MAGIC.items(), key=lambda kv: -len(kv[0]))), F.lit("unknown"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    out = files.select("path", F.col("length").alias("size"), F.md5(c).alias("md5"), F.sha1(c).alias("sha1"), F.sha2(c, 256).alias("sha256"), F.sha2(c, 512).alias("sha512"), F.crc32(c).alias("crc32"), F.round(entropy(c), 6).alias("entropy"), magic.alias("format"), ext.alias("extension"))
    out = out.withColumns({"high_entropy": F.col("entropy") > 7.5, "mismatch": (F.col("format") != "unknown") & (F.col("format") != F.when(F.col("extension") == "jpeg", "jpg").otherwise(F.col("extension")))})
    if acquired is not None:
        out = out.join(acquired.select("path", F.col("sha256").alias("acquired")), "path", "left").withColumn("verified", F.col("acquired") == F.col("sha256"))
    return out


def clean_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``cleaned`` and the ``operations`` that changed it: normal form, hidden characters, spaces, URL schemes,
    border lines and wrapped lines; URLs, e-mail addresses and long numbers come through byte for byte."""
    import re
    import unicodedata

    hidden, border, broken = re.compile("[​-‏‪-‮⁠﻿­]"), re.compile(r"^[\s|_=*~.\-]{3,}$"), re.compile(r"\bh\s?t\s?t\s?p(s?)\s?:\s?/\s?/\s?", re.I)
    shield = re.compile(r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\d[\d.,\-]{5,}\d")

    def one(text: str | None) -> tuple[str, list[str]]:
        ops: list[str] = []

        def step(name: str, old: str, new: str) -> str:
            if new != old:
                ops.append(name)
            return new

        t = text or ""
        t = step("normal_form", t, unicodedata.normalize("NFC", t))
        t = step("hidden", t, hidden.sub("", t))
        t = step("schemes", t, broken.sub(r"http\1://", t))
        kept: list[str] = []

        def hide(m: re.Match) -> str:
            kept.append(m.group())
            return f"\x00{len(kept) - 1}\x01"

        t = shield.sub(hide, t.replace("\x00", "").replace("\x01", ""))
        t = step("borders", t, "\n".join(x for x in t.split("\n") if not border.match(x)))
        t = step("spaces", t, "\n".join(re.sub(r"[ \t  ]+", " ", x).strip() for x in t.split("\n")))
        t = step("wrapped", t, re.sub(r"(?<=[a-z,])\n(?=[a-z])", " ", t))
        return re.sub("\x00(\\d+)\x01", lambda m: kept[int(m.group(1))], t), ops

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [one(t) for t in b[text_col]]
            yield b.assign(cleaned=[t for t, _ in done], operations=[o for _, o in done])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, cleaned string, operations array<string>")
