"""Brand impersonation in URLs: who owns the domain, which brands the URL speaks of, and what imitates them.

Every different URL is looked at once, every different label and every different foreign host once: look-alikes are found on
the distinct labels and joined back by equality, so the dear comparisons grow with the vocabulary of labels and not with
the URLs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.functions import brands as B
from caselink.operators.urls import cloud_provider, url_parts

FINDING = "array<struct<finding:string,brand:string,label:string,severity:string,score:double>>"


def skeleton(host: str) -> tuple[str, str]:
    """(normal form, what it is read as) of a host: Punycode labels decoded, compatibility forms, look-alikes folded."""
    labels = []
    for label in host.split("."):
        if label.startswith("xn--"):
            try:
                label = label[4:].encode("ascii").decode("punycode")
            except UnicodeError:
                pass
        labels.append(label)
    plain = unicodedata.normalize("NFKC", ".".join(labels)).lower()
    return plain, "".join(B.LOOK_ALIKES.get(c, c) for c in plain)


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, changes and swaps of neighbours (what lies between may change too) from a to b; ``most`` + 1
    where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    x, y = Counter(a), Counter(b)
    if max((x - y).total(), (y - x).total()) > most:
        return most + 1
    far = len(a) + len(b)
    last: dict[str, int] = {}
    table = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, c in enumerate(a, 1):
        row, here = [far, i], 0
        for j, d in enumerate(b, 1):
            up, left = last.get(d, 0), here
            cost = table[i][j] if c == d else table[i][j] + 1
            if c == d:
                here = j
            row.append(min(cost, row[j] + 1, table[i][j + 1] + 1, table[up][left] + (i - up - 1) + 1 + (j - left - 1)))
        last[c] = i
        table.append(row)
    return min(table[-1][-1], most + 1)


def read_as(label: str) -> str:
    """The label with pairs and digits read as the letters they look like."""
    out = label.lower()
    for pair, letter in B.READ_PAIRS:
        out = out.replace(pair, letter)
    return out.translate(str.maketrans(B.READ_SINGLE[0] + B.READ_SINGLE[2], B.READ_SINGLE[1] + B.READ_SINGLE[3]))


def near_brands(label: str, tokens: dict[str, tuple[str, ...]], most: int = 2, least: int = 5) -> list[tuple[str, int]]:
    """(brand, distance) of the brands that the label imitates: as it is, as it is read, or with repeats taken out."""
    read = read_as(label)
    forms = {read, re.sub(r"(.)\1+", r"\1", read)} - {label}
    out = []
    for brand, words in tokens.items():
        if label in words:
            continue
        for word in words:
            if len(word) >= least:
                raw, turned = edits(label, word, most), min((edits(f, word, most) for f in forms), default=most + 1)
                if 1 <= raw <= most or turned <= most:
                    out.append((brand, min(raw, turned)))
                    break
    return out


def _labels(domain: Column, subdomain: Column) -> Column:
    parts = F.filter(F.split(subdomain, r"\."), lambda x: (x != "") & (x != "www"))
    every = F.concat(F.array(domain), parts)
    # each label is followed by its own parts; a label without a hyphen is its only part
    return F.filter(F.array_distinct(F.flatten(F.transform(every, lambda x: F.concat(F.array(x), F.split(x, "-"))))), lambda x: F.length(x) >= 3)


def _lookalikes(labels: DataFrame, tokens: dict) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(x, b, n) for x in part["label"] for b, n in near_brands(x, tokens)]
            yield pd.DataFrame(rows, columns=["label", "brand", "distance"])

    return labels.select("label").distinct().mapInPandas(run, "label string, brand string, distance int")


def _glyphs(hosts: DataFrame, tokens: dict) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for host in part["host"]:
                plain, read = skeleton(host)
                for brand, words in tokens.items() if read != plain else ():
                    word = next((w for w in words if len(w) >= 4 and w not in plain and w in read), None)
                    if word:
                        rows.append((host, brand, word))
            yield pd.DataFrame(rows, columns=["host", "brand", "label"])

    return hosts.select("host").distinct().mapInPandas(run, "host string, brand string, label string")


def _finding(kind: str, brand: Column, label: Column, severity: Column | str, score: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("finding"), brand.alias("brand"), label.alias("label"), lit(severity).alias("severity"), lit(score).cast("double").alias("score"))


def brands_of_urls(df: DataFrame, tokens: dict | None = None, domains: dict | None = None, endings: dict | None = None) -> DataFrame:
    """url, registered_domain, official_brand, brands (those the URL speaks of or imitates) and ``findings`` of each
    different URL.

    On a brand's own domain only other brands are findings (conflicts), also on a cloud host that belongs to no brand, if
    the URL names one. Elsewhere every brand named or imitated is one, with affixes around its name and cloud hosts that
    ask for credentials. Punycode is decoded before hosts are read.
    """
    tokens, domains, endings = tokens or B.BRAND_TOKENS, domains or B.BRAND_DOMAINS, endings or B.BRAND_ENDINGS
    spark = df.sparkSession
    W = B.BRAND_WEIGHTS  # noqa: N806
    words = F.array(*(F.struct(F.lit(b).alias("brand"), F.lit(w).alias("word")) for b, ws in tokens.items() for w in ws))
    p = url_parts(df.where("url is not null").select("url").distinct()).select("url", "host", F.lower("path").alias("path"), F.lower("query").alias("query"), "subdomain", "domain", "registered_domain")
    home = spark.createDataFrame([(d, b) for b, ds in domains.items() for d in ds], "registered_domain string, owner string")
    p = p.join(home, "registered_domain", "left")
    below = F.coalesce(*(F.when((F.col("registered_domain") == e) | F.col("registered_domain").endswith("." + e), b) for e, b in endings.items()), F.lit(None))
    p = p.withColumns({"owner": F.coalesce("owner", below), "labels": _labels(F.col("domain"), F.col("subdomain")), "cloud": cloud_provider(F.regexp_extract(F.lower(F.trim("url")), r"^(?:https?://)?([^/:?#]+)", 1))})
    everywhere = F.concat_ws("\n", "host", "path", "query")
    p = p.withColumn("named", F.filter(words, lambda t: (F.length(t.word) >= 4) & F.contains(everywhere, t.word)))
    near = p.select("url", F.posexplode("labels").alias("place", "label")).join(_lookalikes(p.select(F.explode("labels").alias("label")), tokens), "label")
    order = {b: i for i, b in enumerate(tokens)}
    place = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    typo = near.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("place", place[F.col("brand")].alias("turn"), "brand", "label", "distance"))).alias("typos"))
    foreign = p.where(~F.col("host").rlike(r"^[\x00-\x7f]*$") | F.col("host").contains("xn--"))
    glyph = foreign.select("url", "host").join(_glyphs(foreign, tokens), "host").groupBy("url").agg(F.sort_array(F.collect_list(F.struct(place[F.col("brand")].alias("turn"), "brand", "label"))).alias("glyphs"))
    p = p.join(typo, "url", "left").join(glyph, "url", "left")

    none = F.array().cast(FINDING)
    spoken = F.array_distinct(F.transform("named", lambda t: t.brand))
    at_home = lambda b: F.exists("named", lambda t: (t.brand == b) & F.contains(F.col("host"), t.word))
    kin = [f"{a}|{b}" for a in tokens for b in tokens if a != b and set(tokens[a]) & set(tokens[b])]
    other = F.filter(spoken, lambda b: F.col("owner").isNull() | ((b != F.col("owner")) & (~F.concat(F.col("owner"), F.lit("|"), b).isin(kin) if kin else F.lit(True))))
    conflicts = F.transform(other, lambda b: _finding("brand_conflict", b, F.lit(None).cast("string"), F.when(at_home(b), "high").otherwise("medium"), F.when(at_home(b), W["brand_conflict"] + W["brand_token"]).otherwise(W["brand_conflict"])))
    typos = F.coalesce(F.transform("typos", lambda t: _finding("typosquatting", t.brand, t.label, F.when(t.distance == 1, "critical").otherwise("high"), W["typosquatting"])), none)
    glyphs = F.coalesce(F.transform("glyphs", lambda t: _finding("homoglyph", t.brand, t.label, "critical", W["homoglyph"])), none)
    p = p.withColumns({"conflicts": conflicts.cast(FINDING), "spoken": spoken, "imitated": F.concat(typos.cast(FINDING), glyphs.cast(FINDING))})
    p = p.withColumn("mode", F.when(F.col("owner").isNotNull(), "home").when(F.col("cloud").isNotNull() & (F.size("conflicts") > 0), "cloud").otherwise("plain"))
    p = p.withColumn("brands", F.when(F.col("mode") == "home", F.concat(F.array("owner"), F.transform("conflicts", lambda f: f.brand)))
                     .otherwise(F.array_distinct(F.concat("spoken", F.transform("imitated", lambda f: f.brand)))))
    deep = lambda b: (F.size("imitated") > 0) | at_home(b)
    mismatches = F.transform("brands", lambda b: F.when(deep(b), _finding("official_domain_mismatch", b, F.lit(None).cast("string"), "high", W["official_domain_mismatch"]))
                             .otherwise(_finding("brand_token_reference", b, F.lit(None).cast("string"), "info", W["brand_token"])))
    joined = F.array_join("labels", "-")
    affixes = F.array(*map(F.lit, B.AFFIXES))
    affixed = F.filter(words, lambda t: F.contains(joined, t.word) & F.exists(affixes, lambda a: (a != t.word) & F.contains(joined, a)))
    p = p.withColumn("affixed", affixed)
    misleading = F.transform(F.filter("brands", lambda b: F.exists("affixed", lambda t: t.brand == b)),
                             lambda b: _finding("misleading_affix", b, F.get(F.filter("affixed", lambda t: t.brand == b), F.lit(0)).word, "high", W["misleading_affix"]))
    first = F.when(F.col("mode") == "home", F.col("conflicts")).when(F.col("mode") == "cloud", F.concat("conflicts", "imitated")).otherwise(F.concat("imitated", mismatches.cast(FINDING), misleading.cast(FINDING)))
    p = p.withColumn("first", first)
    asks = F.concat_ws(" ", "subdomain", "path", "query")
    abused = (F.col("mode") != "home") & F.col("cloud").isNotNull() & F.exists(F.array(*map(F.lit, B.CREDENTIAL_WORDS)), lambda w: F.contains(asks, w)) & F.exists(
        "first", lambda f: f.finding.isin("official_domain_mismatch", "typosquatting", "homoglyph", "brand_conflict"))
    cloud = F.when(abused, F.array(_finding("cloud_hosted_impersonation", F.get("brands", F.lit(0)), F.col("cloud"), "high", W["cloud_hosted_impersonation"])).cast(FINDING)).otherwise(none)
    return p.select("url", "registered_domain", F.col("owner").alias("official_brand"), "brands", F.concat("first", cloud).alias("findings"))


def brand_findings(df: DataFrame, **tables) -> DataFrame:
    """``df`` with a row for each finding of its URL: finding, brand, label (what matched, where it isn't the brand's own
    word), severity, score."""
    found = brands_of_urls(df, **tables).select("url", F.explode("findings").alias("f")).select("url", "f.*")
    return df.join(found, "url").select(*df.columns, "finding", "brand", "label", "severity", "score")


def brand_risk(df: DataFrame, **tables) -> DataFrame:
    """``df`` with official_brand, brands, brand_score (0 to 1) and brand_level. Where a finding is severe, the columns
    domain_age_days, ssl_valid, whois_private and suspicious_keyword_count, as far as ``df`` has them, add to the score."""
    W, has = B.BRAND_WEIGHTS, set(df.columns)  # noqa: N806
    out = df.join(brands_of_urls(df, **tables).drop("registered_domain"), "url", "left")
    tests = {"domain_age_days": (F.col("domain_age_days").between(0, 179), "young_domain"), "ssl_valid": (~F.col("ssl_valid"), "no_ssl"),
             "whois_private": (F.col("whois_private"), "whois_hidden"), "suspicious_keyword_count": (F.col("suspicious_keyword_count") >= 2, "suspicious_keywords")}
    more = [F.when(t, W[k]).otherwise(0.0) for c, (t, k) in tests.items() if c in has]
    severe = F.exists("findings", lambda f: f.severity.isin("high", "critical"))
    score = F.aggregate("findings", F.lit(0.0), lambda a, f: a + f.score)
    if more:
        score = score + F.when(severe, sum(more[1:], more[0])).otherwise(0.0)
    score = F.when(score.isNotNull(), F.round(F.least(F.lit(1.0), score), 4))
    level = F.when(score >= B.BRAND_LEVELS["high"], "high").when(score >= B.BRAND_LEVELS["medium"], "medium").when(score > 0, "low").when(score.isNotNull(), "none")
    return out.select(*df.columns, "official_brand", "brands", score.alias("brand_score"), level.alias("brand_level"))
