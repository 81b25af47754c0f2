"""Labelled-URL curation: cleaning, conflicts, merging, balancing, exact seeded splits and quality reports.

Rows are chosen by the md5 of (url, seed), so results don't depend on partitions and SQL can repeat them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselink.functions import web as W
from caselink.operators.urls import canonical_url, url_parts


def order_key(seed: int) -> Column:
    return F.md5(F.concat("url", F.lit(f":{seed}")))


def md5_mod_100(text: Column) -> Column:
    """The 128-bit md5 of a text modulo 100: 2**64 is 16 modulo 100."""
    half = lambda i: F.conv(F.substring(F.md5(text), i, 16), 16, 10).cast("decimal(20,0)") % 100
    return ((16 * half(1) + half(17)) % 100).cast("int")


def clean_labelled(df: DataFrame, least: int = 5, most: int = 2048) -> DataFrame:
    """Blank rows go, control characters, quotes and backslashes too; a missing scheme is chosen by md5 (70/20/5/5); the
    URL is canonical, the label 0 or 1, the length within bounds."""
    staged = df.withColumn("_raw", F.trim(F.regexp_replace("url", r"[\x00-\x1f\x7f\"'\\]", ""))).where("coalesce(_raw, '') <> ''").withColumn("_r", md5_mod_100(F.col("_raw")))
    raw, r = F.col("_raw"), F.col("_r")
    bare = F.when(F.lower(raw).startswith("www."), F.substr(raw, F.lit(5))).otherwise(raw)
    staged = staged.withColumn("_full", F.when(raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), raw).otherwise(F.concat(F.when(r < 70, "https://www.").when(r < 90, "https://").when(r < 95, "http://www.").otherwise("http://"), bare)))
    cleaned = staged.withColumn("url", canonical_url(F.col("_full"))).withColumn("label", F.col("label").try_cast("int"))
    return cleaned.where(F.col("label").isin(0, 1) & F.length("url").between(least, most)).select(*df.columns)


def correct_official_labels(df: DataFrame) -> DataFrame:
    """Label 1 on an official registered domain becomes 0."""
    official = F.col("registered_domain").isin(*(x for v in W.OFFICIAL_DOMAINS.values() for x in v))
    return url_parts(df).select(*df.columns, ((F.col("label") == 1) & official).alias("corrected")).withColumn("label", F.when(F.col("corrected"), 0).otherwise(F.col("label")))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid, invalid, failures per rule)."""
    rules = {"scheme": F.col("url").rlike(r"^(https?|ftp)://"), "dot": F.col("url").contains("."), "label": F.col("label").isin(0, 1), "not_numeric": ~F.col("url").rlike(r"^[a-z]+://[0-9./]*$")}
    marked = df.select(*df.columns, *(F.coalesce(c, F.lit(False)).alias(f"_{k}") for k, c in rules.items()))
    ok = reduce(lambda a, b: a & b, (F.col(f"_{k}") for k in rules))
    counts = marked.agg(*(F.count_if(~F.col(f"_{k}")).alias(k) for k in rules), F.count_if(ok).alias("valid"))
    return marked.where(ok).select(*df.columns), marked.where(~ok).select(*df.columns), counts


def drop_conflicts(df: DataFrame) -> DataFrame:
    """Without every URL that carries more than one label."""
    bad = df.groupBy("url").agg(F.count_distinct("label").alias("n")).where("n > 1")
    return df.join(bad, "url", "left_anti")


def merge_sources(dfs: list[DataFrame]) -> DataFrame:
    """Union in source order; the first row of each URL stays."""
    both = reduce(lambda a, b: a.unionByName(b), (d.select("url", "label").withColumn("source_no", F.lit(i)) for i, d in enumerate(dfs)))
    return both.groupBy("url").agg(F.min(F.struct("source_no", "label")).alias("m")).select("url", "m.label", "m.source_no")


def _ranked(df: DataFrame, seed: int) -> DataFrame:
    """Rank of every row in its label's md5 order, in two steps: counts of 4,096 key ranges, then inside each range."""
    keyed = df.withColumn("_key", order_key(seed)).withColumn("_range", F.substring("_key", 1, 3))
    counts = keyed.groupBy("label", "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    totals = counts.groupBy("label").agg(F.sum("_n").alias("_total"))
    inside = F.row_number().over(Window.partitionBy("label", "_range").orderBy("_key", "url"))
    return keyed.withColumn("_in", inside).join(before, ["label", "_range"]).join(totals, "label").withColumn("_rank", F.col("_before") + F.col("_in")).drop("_key", "_range", "_in", "_before")


def balance(df: DataFrame, max_ratio: float = 1.5, seed: int = 42) -> DataFrame:
    """The larger class cut to floor(smaller * ratio) where it exceeds that."""
    ranked = _ranked(df, seed)
    least = df.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    return ranked.join(least).where(F.col("_rank") <= F.floor(F.col("_least") * max_ratio)).select(*df.columns)


def cap_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most about n rows, each class by its share."""
    total = df.agg(F.count("*").alias("_all"))
    return _ranked(df, seed).join(total).where((F.col("_all") <= n) | (F.col("_rank") <= F.floor(n * F.col("_total") / F.col("_all")))).select(*df.columns)


def stratified_split(df: DataFrame, train: float = 0.70, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with its split; exact counts per class."""
    r, n = F.col("_rank"), F.col("_total")
    split = F.when(r <= F.floor(n * train), "train").when(r <= F.floor(n * train) + F.floor(n * validation), "validation").otherwise("test")
    return _ranked(df, seed).withColumn("split", split).select(*df.columns, "split")


def stratified_kfold(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return _ranked(df, seed).withColumn("fold", (F.col("_rank") % k).cast("int")).select(*df.columns, "fold")


def balanced_benchmark(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows of each class; fails when one is short."""
    short = df.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") < n)
    if not short.isEmpty():
        raise ValueError(f"a class has fewer than {n} rows")
    return _ranked(df, seed).where(F.col("_rank") <= n).select(*df.columns)


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, labels, URL lengths and duplicates of a set."""
    size = F.length("url")
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"), F.min(size).alias("min_len"), F.max(size).alias("max_len"), F.round(F.avg(size), 6).alias("mean_len"), F.median(size).alias("median_len"),
                  F.round(F.stddev_samp(size), 6).alias("std_len"), (F.count("*") - F.count_distinct("url")).alias("duplicates"))


def top_suffixes(df: DataFrame, n: int = 20) -> DataFrame:
    return url_parts(df).groupBy("suffix").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "suffix").limit(n)


def compare_splits(df: DataFrame) -> DataFrame:
    """Counts and share of each label within each split."""
    counts = df.groupBy("split", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("split")), 4))


def quality_report(df: DataFrame) -> DataFrame:
    """Duplicates, conflicts, hosts with both labels, class ratio, and shares of https and paths."""
    p = url_parts(df)
    urls = df.groupBy("url").agg(F.count("*").alias("c"), F.count_distinct("label").alias("l")).agg(F.sum(F.col("c") - 1).alias("duplicates"), F.count_if(F.col("l") > 1).alias("conflicts"))
    hosts = p.groupBy("host").agg(F.count_distinct("label").alias("l")).agg(F.count_if(F.col("l") > 1).alias("mixed_hosts"))
    shares = p.agg(F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_share"), F.round(F.avg((F.col("scheme") == "https").cast("double")), 6).alias("https_share"), F.round(F.avg(F.when(F.col("label") == 1, (F.length("path") > 1).cast("double"))), 6).alias("path_share_positive"))
    return urls.join(hosts).join(shares)


def feature_health(df: DataFrame, cols: list[str], limit: float = 0.95) -> DataFrame:
    """Column pairs with an absolute correlation of at least ``limit``, and columns that don't vary (paired with themselves)."""
    still = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.when(F.stddev_pop(c) == 0, 1.0).otherwise(0.0).alias("r")) for c in cols]
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.round(F.abs(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))), 6), F.lit(0.0)).alias("r")) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return df.agg(F.array(*still, *pairs).alias("x")).select(F.explode("x").alias("x")).select("x.*").where(F.col("r") >= limit)


def feedback_corrections(log: DataFrame) -> DataFrame:
    """(url, label) of rows marked incorrect with a usable true label; the first by url and time."""
    label = F.when(F.lower("true_label").isin("phishing", "1"), 1).when(F.lower("true_label").isin("benign", "legitimate", "0"), 0)
    return log.where("verdict = 'incorrect'").withColumn("label", label).where("label is not null").groupBy("url").agg(F.min_by("label", "ts").alias("label"), F.count("*").alias("reports"))
