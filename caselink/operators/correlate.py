"""Links between items and between cases through shared values, over all cases at once.

An *occurrence* is (case_id, item_id, entity_type, value). Values are compared in lower case inside a case, and trimmed
too across cases. Pairs only ever come from an equality join on the shared value, never from all pairs of items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselink.functions import constants as K
from caselink.functions.scores import band, lookup
from caselink.session import discard, durable, ship


def normalised(occ: DataFrame, trim: bool = True) -> DataFrame:
    """Distinct linkable occurrences with the value in comparison form; empty values go."""
    value = F.lower("value")
    out = occ.withColumn("value", F.trim(value) if trim else value).where(F.trim("value") != "")
    return out.where(F.col("entity_type").isin(*K.LINK_WEIGHTS)).select("case_id", "item_id", "entity_type", "value").distinct()


def document_frequency(occ: DataFrame) -> DataFrame:
    """(entity_type, value, df, corpus): distinct items per value, and distinct items overall."""
    corpus = occ.agg(F.count_distinct("item_id").alias("corpus"))
    return occ.groupBy("entity_type", "value").agg(F.count_distinct("item_id").alias("df")).join(corpus)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _payload(value: Column, bare: Column) -> Column:
    digits = F.regexp_replace(bare, "[^a-z0-9]", "")
    return F.when(digits.rlike("^[0-9]+$"), digits).otherwise(F.regexp_replace(value, "[^a-z0-9]", ""))


def _letters(payload: Column, round_: Column) -> Column:
    alphabet = F.when(payload.rlike("[0-9]") & payload.rlike("[a-z]"), 36).when(payload.rlike("[a-z]"), 26).otherwise(10)
    score = F.least(F.lit(1.0), F.length(payload) * F.log2(alphabet.cast("double")) / K.FULL_BITS)
    return F.when(payload == "", 0.05).otherwise(F.greatest(F.lit(0.01), F.least(F.lit(1.0), score * round_)))


def _roundness(bare: Column) -> Column:
    number = _once(F.regexp_replace(bare, "[, ]", ""), lambda x: F.when(x.rlike(r"^[0-9]+(\.[0-9]+)?$"), x.try_cast("double")))
    return _once(number, lambda x: (F.when(x.isNull() | (x != F.floor(x)), 1.0).when(x <= 0, 0.4).when(x % 100000 == 0, 0.10).when(x % 10000 == 0, 0.15)
                                    .when(x % 1000 == 0, 0.20).when(x % 100 == 0, 0.40).when(x % 10 == 0, 0.70).otherwise(1.0)))


def intrinsic(value: Column) -> Column:
    """Information that the value's own letters carry, 0.01 to 1."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(value, r"^(npr|rs\.?|inr|usd|eur|gbp)\s*", ""), r"\s*(npr|rs\.?|inr|usd|eur|gbp)$", ""))
    return _once(bare, lambda b: _once(_payload(value, b), lambda p: _letters(p, _roundness(b))))


def value_specificity(freq: DataFrame) -> DataFrame:
    """From document_frequency: how identifying each value is, rounded to 4 digits."""
    n, df = F.col("corpus").cast("double"), F.least("df", "corpus").cast("double")
    rarity = F.when(F.col("corpus") < 3, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p(n / df) / F.log1p(n / 2))))
    trust = n / (n + K.CORPUS_PRIOR)
    blended = F.exp(trust * F.log(F.greatest(rarity, F.lit(1e-6))) + (1 - trust) * F.log(F.greatest(intrinsic(F.col("value")), F.lit(1e-6))))
    return freq.select("entity_type", "value", "df", "corpus", F.round(F.greatest(F.lit(K.SPECIFICITY_FLOOR), F.least(F.lit(1.0), blended)), 4).alias("specificity"))


def shared_values(occ: DataFrame, spec: DataFrame, scope: list[str], item: str) -> DataFrame:
    """(scope, a, b, entity_type, value, specificity) for each value two items of a scope share, a < b."""
    rows = occ.select(*scope, item, "entity_type", "value").distinct()
    keys = [*scope, "entity_type", "value"]
    # only what is shared meets the specificities
    pairs = rows.withColumnRenamed(item, "a").join(rows.withColumnRenamed(item, "b"), keys).where("a < b")
    return pairs.join(spec.select("entity_type", "value", "specificity"), ["entity_type", "value"]).select(*scope, "a", "b", "entity_type", "value", "specificity")


def capped_factors(shared: DataFrame, scope: list[str]) -> DataFrame:
    """Per pair and type: the (at most 3) most specific values and their contribution."""
    w = Window.partitionBy(*scope, "a", "b", "entity_type").orderBy(F.col("specificity").desc(), "value")
    top = shared.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K.FACTOR_CAP)
    return (top.groupBy(*scope, "a", "b", "entity_type").agg(F.count("*").alias("matches"), F.sum("specificity").alias("total"))
            .withColumn("contribution", F.round(lookup("entity_type", K.LINK_WEIGHTS) * F.col("total"), 4)))


def shared_value_pairs(occ: DataFrame, spec: DataFrame) -> DataFrame:
    """Inside a case: every item pair's factors by entity type."""
    return capped_factors(shared_values(occ, spec, ["case_id"], "item_id"), ["case_id"]).select("case_id", "a", "b", "entity_type", "matches", "contribution")


def equal_attribute_factors(items: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """Item pairs of a case with equal attributes; ``attributes``: column to factor. Null and empty never match."""
    stacked = None
    for column, factor in attributes.items():
        part = items.where(F.trim(F.col(column)) != "").select("case_id", "item_id", F.lit(factor).alias("factor"), F.col(column).alias("value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    left, right = stacked.withColumnRenamed("item_id", "a"), stacked.withColumnRenamed("item_id", "b")
    return (left.join(right, ["case_id", "factor", "value"]).where("a < b").select("case_id", "a", "b", "factor", "value")
            .withColumn("contribution", lookup("factor", K.FACTOR_WEIGHTS)))


def proximity_pairs(items: DataFrame, seconds: Column, scope: list[str], item: str, hours: float = 48.0) -> DataFrame:
    """Item pairs of a scope within ``hours``, by a band join on buckets of that width."""
    wide = int(hours * 3600)
    rows = items.select(*scope, F.col(item).alias("i"), seconds.alias("s")).where("s is not null").withColumn("bucket", F.floor(F.col("s") / wide))
    near = rows.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    left = rows.withColumnsRenamed({"i": "a", "s": "sa"})
    return (left.join(near.withColumnsRenamed({"i": "b", "s": "sb"}), [*scope, "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("sa") - F.col("sb")) <= wide))
            .select(*scope, "a", "b", F.round(F.abs(F.col("sa") - F.col("sb")) / 3600.0, 4).alias("hours_apart"), F.abs(F.col("sa") - F.col("sb")).alias("seconds")))


def shared_flagged_indicators(occ: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Item pairs of a case that share a value with a bad verdict: matches, at most 3, by weight 0.80."""
    bad = verdicts.where(F.lower("verdict").isin("malicious", "phishing", "scam", "fraud")).select(F.lower("value").alias("value")).distinct()
    rows = occ.where(F.col("entity_type").isin("urls", "domains")).join(bad, "value", "left_semi").select("case_id", "item_id", "value").distinct()
    pairs = rows.withColumnRenamed("item_id", "a").join(rows.withColumnRenamed("item_id", "b"), ["case_id", "value"]).where("a < b")
    return (pairs.groupBy("case_id", "a", "b").agg(F.least(F.count("*"), F.lit(K.FACTOR_CAP)).alias("matches"))
            .withColumn("contribution", F.round(F.col("matches") * K.FACTOR_WEIGHTS["threat_intelligence"], 4)))


def confidence(weight: Column) -> Column:
    return F.round(1 - F.exp(-weight / K.CONFIDENCE_SCALE), 4)


def correlate_pairs(factors: DataFrame) -> DataFrame:
    """From factors (case_id, a, b, entity_type or factor, contribution): weight, confidence and strength of each pair."""
    pairs = factors.groupBy("case_id", "a", "b").agg(F.round(F.sum("contribution"), 4).alias("weight"), F.count("*").alias("factors"))
    return pairs.withColumn("confidence", confidence(F.col("weight"))).withColumn("strength", band(F.col("confidence"), K.STRENGTH_BANDS))


def correlation_summary(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Per case: number of pairs, related ones, how many of each strength, and the strongest pair."""
    n = items.groupBy("case_id").agg(F.count_distinct("item_id").alias("items"))
    by = pairs.groupBy("case_id").agg(
        F.count_if(F.col("strength") != "NO_RELATIONSHIP").alias("related"),
        *(F.count_if(F.col("strength") == s).alias(s.lower()) for s in ("WEAK", "MEDIUM", "STRONG", "VERY_STRONG")),
        F.min(F.struct((-F.col("confidence")).alias("c"), "a", "b")).alias("top"))
    return n.join(by, "case_id", "left").select(
        "case_id", "items", F.expr("items * (items - 1) div 2").alias("pair_count"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("related", "weak", "medium", "strong", "very_strong")),
        F.col("top.a").alias("top_a"), F.col("top.b").alias("top_b"), (-F.col("top.c")).alias("top_confidence"))


SLICE = 200_000
#: Rows of a block of cases: a cell of two blocks holds about twice as many.
BLOCK_ROWS = 2_000_000


def _linked(counts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (low, high, side, n, v, what) sorted by cell: the links of the cell's pairs of cases, or with ``counts``
    for each of its cases how many others it is linked with and the least of them. ``what`` is the value's type and, from
    the highest down, its specificity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done():
            if held:
                links = _cell(*(np.concatenate(x) for x in zip(*held, strict=True)), key[0] == key[1])
                yield from _counted(links) if counts else map(_named, links)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cuts = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]), True]) if batch.num_rows else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (cols[0][lo], cols[1][lo]) != key:
                    yield from done()
                    key, held = (cols[0][lo], cols[1][lo]), []
                held.append([c[lo:hi] for c in cols[2:]])
        yield from done()

    return run


def _named(link: tuple) -> pa.RecordBatch:
    a, b, a_at, b_at, matches, sure = link
    x, y = a[a_at], b[b_at]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(x, y), np.maximum(x, y), matches, sure)], names=["a", "b", "matches", "confidence"])


def _counted(links: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Per case of a cell its number of links and the least case at their other ends. A pair is in one slice of one cell."""
    names, much, least = None, None, None
    for a, b, a_at, b_at, _, _ in links:  # by a, then b, in rising order
        if names is None:
            names, much, least = b, np.zeros(len(b), np.int64), np.full(len(b), np.iinfo(np.int64).max)
        much += np.bincount(b_at, minlength=len(b))
        first = np.full(len(b), np.iinfo(np.int64).max)
        first[b_at[::-1]] = a[a_at[::-1]]  # the earliest of a repeated place is written last
        np.minimum(least, first, out=least)
        starts = np.flatnonzero(np.r_[True, a_at[1:] != a_at[:-1]])
        yield _tally(a[a_at[starts]], np.diff(np.r_[starts, len(a_at)]), b[b_at[starts]])
    if names is not None:
        yield _tally(names[much > 0], much[much > 0], least[much > 0])


def _tally(n, links, least) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(n), pa.array(links), pa.array(least)], names=["n", "links", "least"])


def _cell(side, case, v, what, inside: bool) -> Iterator[tuple]:
    """(cases a, cases b, places in a, places in b, matches, confidence) of the linked pairs of a cell, some cases of its
    first block at a time: the weighed sum of the (at most ``FACTOR_CAP``) most specific values of each type, all pairs of
    the two blocks being whole in the cell. About ``SLICE`` rows are held beside it."""
    left, right = side == 0, (side == 0) if inside else side == 1
    if not left.any() or not right.any():
        return
    heavy = np.array([round(w * 100) for w in K.LINK_WEIGHTS.values()], np.int64)
    order = np.lexsort((case[right], v[right]))
    r_case, r_v = case[right][order], v[right][order]
    names, local = np.unique(r_case, return_inverse=True)
    a, av, aw = (x[left] for x in (case, v, what))
    start, stop = np.searchsorted(r_v, av, "left"), np.searchsorted(r_v, av, "right")
    if inside:  # of a block with itself only the later cases: those behind the row's own place
        start = np.empty(len(order), np.int64)
        start[order] = np.arange(1, len(order) + 1)
    order = np.argsort(a, kind="stable")
    a, aw, start, stop = (x[order] for x in (a, aw, start, stop))
    much = stop - start
    ends = np.cumsum(much)
    last = np.flatnonzero(np.r_[a[1:] != a[:-1], True]) + 1  # where a case's rows end
    lo = 0
    while lo < len(a):
        before = ends[lo - 1] if lo else 0
        hi = int(last[min(max(np.searchsorted(ends[last - 1], before + SLICE, "right"), np.searchsorted(last, lo, "right") + 1), len(last)) - 1])
        n = much[lo:hi]
        mine, own = np.unique(a[lo:hi], return_inverse=True)
        place = np.arange(int(n.sum())) + np.repeat(start[lo:hi] - (np.cumsum(n) - n), n)
        code = np.repeat((own.astype(np.int64) * len(names) << 20) + aw[lo:hi], n) + (local[place] << 20)
        code.sort()  # by pair and type, the most specific value first
        lo = hi
        if not len(code):
            continue
        group = code >> 14
        if len(code) > K.FACTOR_CAP:
            kept = np.ones(len(code), bool)
            kept[K.FACTOR_CAP:] = group[K.FACTOR_CAP:] != group[: -K.FACTOR_CAP]
            code = code[kept]
        of = code >> 20
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        raw = np.add.reduceat((16383 - (code & 16383)) * heavy[code >> 14 & 63], first)
        sure = np.floor((1 - np.exp(-(raw / 1e6) / K.CONFIDENCE_SCALE)) * 1e4 + 0.5) / 1e4
        tied = sure >= K.STRENGTH_BANDS["NO_RELATIONSHIP"]
        a_at, b_at = np.divmod(of[first][tied], len(names))
        if len(a_at):
            yield mine, names, a_at, b_at, np.diff(np.r_[first, len(code)])[tied], sure[tied]


def case_cells(rows: DataFrame, blocks: int) -> DataFrame:
    """(low, high, side, n, v, what): each row (n, v, what) once for every block of cases that holds its value too.

    Blocks are ranges of case numbers of about equally many rows. Cases that were opened together share most, so a value
    is in few blocks, and neighbours meet in one cell. With values spread over all cases a row goes to as many blocks as
    its value has, which is never more than the pairs that it makes."""
    rows = durable(rows.repartitionByRange(blocks, "n").withColumn("own", F.spark_partition_id()), "cross-blocks") if blocks > 1 else rows.withColumn("own", F.lit(0))
    held = rows.select("v", F.col("own").alias("other")).distinct()
    return rows.join(held, "v").select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "n", "v", "what")


def _paired(occ: DataFrame, spec: DataFrame, block: int, counts: bool) -> tuple[DataFrame, DataFrame | None]:
    """What ``_linked`` gives for all cells, and the numbers of the cases unless the cases are numbers."""
    ship(occ.sparkSession)
    kinds = F.lit(None).cast("int")
    for i, kind in enumerate(K.LINK_WEIGHTS):
        kinds = F.when(F.col("entity_type") == kind, i).otherwise(kinds)
    what = F.shiftleft(kinds, 14) + 16383 - F.round(F.col("specificity") * 10000).cast("int")
    numbered = spec.where("df > 1").select("entity_type", "value", what.alias("what"))
    number = occ.schema["case_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    cases = None if number else durable(occ.select("case_id").distinct().orderBy("case_id").withColumn("n", F.monotonically_increasing_id()), "cross-cases")
    rows = occ.select("case_id", "entity_type", "value").distinct()
    rows = rows.withColumn("n", F.col("case_id").cast("long")) if number else rows.join(cases, "case_id")
    # values are told by 64 bits and their type
    rows = durable(rows.join(numbered, ["entity_type", "value"]).select("n", F.xxhash64("entity_type", "value").alias("v"), "what"), "cross-rows")
    held, found = rows.agg(F.count("*"), F.approx_count_distinct("n")).first()
    blocks = max(1, -(-held // BLOCK_ROWS), min(8, -(-found // block)))
    cells = case_cells(rows, blocks).repartition(4 * blocks, "low", "high").sortWithinPartitions("low", "high")
    if blocks > 1:  # they were written again by block
        discard(rows)
    return cells.mapInArrow(_linked(counts), "n long, links long, least long" if counts else "a long, b long, matches long, confidence double"), cases


def _as_cases(df: DataFrame, cases: DataFrame | None, occ: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the case ids that stand behind its numbers."""
    for n, c in columns.items():
        if cases is None:
            df = df.withColumn(n, F.col(n).cast(occ.schema["case_id"].dataType)).withColumnRenamed(n, c)
        else:
            df = df.join(cases.select(F.col("n").alias(n), F.col("case_id").alias(f"_{c}")), n).drop(n).withColumnRenamed(f"_{c}", c)
    return df


def cross_case_links(occ: DataFrame, spec: DataFrame, block: int = 2048) -> DataFrame:
    """Case pairs that share values: confidence from the unrounded sum of, for each type, the (at most 3) most specific
    shared values; links without a relationship go.

    Cases are dealt into blocks (at most 8 of about ``block`` cases, more only where they would pass ``BLOCK_ROWS``), and a
    value's row goes once to each pair of its case's block with a block that holds the value too. So a pair of cases is
    whole in the cell of its two blocks: no pair is shuffled, none is aggregated twice. Values of one item are left out.
    """
    pairs, cases = _paired(occ, spec, block, False)
    links = _as_cases(pairs, cases, occ, {"a": "a", "b": "b"})
    return links.select("a", "b", "matches", "confidence", band(F.col("confidence"), K.STRENGTH_BANDS).alias("strength"))


def cross_case_counts(occ: DataFrame, spec: DataFrame, block: int = 2048) -> DataFrame:
    """What ``propagate_links`` gives for ``cross_case_links``, counted inside the cells: a cell puts out its cases, not
    its pairs."""
    found, cases = _paired(occ, spec, block, True)
    each = found.groupBy("n").agg(F.sum("links").alias("linked_cases"), F.min("least").alias("first"))
    return _as_cases(each, cases, occ, {"n": "case_id", "first": "first_case"}).select("case_id", "linked_cases", "first_case")


def propagate_links(links: DataFrame) -> DataFrame:
    """Every case and the cases it is linked with, from either side."""
    both = links.select(F.col("a").alias("case_id"), F.col("b").alias("other")).union(links.select("b", "a"))
    return both.groupBy("case_id").agg(F.count_distinct("other").alias("linked_cases"), F.min("other").alias("first_case"))


def baseline_exact_pairs(occ: DataFrame) -> DataFrame:
    """Item pairs of a case that share a raw value."""
    rows = occ.select("case_id", "item_id", "value").distinct()
    return rows.withColumnRenamed("item_id", "a").join(rows.withColumnRenamed("item_id", "b"), ["case_id", "value"]).where("a < b").select("case_id", "a", "b").distinct()


def baseline_unweighted_pairs(occ: DataFrame) -> DataFrame:
    """Item pairs of a case that share a normalised linkable (type, value)."""
    rows = normalised(occ)
    keys = ["case_id", "entity_type", "value"]
    return rows.withColumnRenamed("item_id", "a").join(rows.withColumnRenamed("item_id", "b"), keys).where("a < b").select("case_id", "a", "b").distinct()
