"""Timelines: resolved times, stages, milestones and statistics of every case at once.

An *event* is (case_id, item_id, ts, source, text); ts is null where no time was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselink.functions import constants as K

#: The source of a time, in order of trust, with its confidence; the last is no event time.
SOURCES = {"labelled": 0.95, "entity": 0.85, "chat": 0.75, "metadata": 0.65, "upload": 0.30}
FALLBACK = "upload"
STAGES = list(K.STAGE_KEYWORDS)


def stated_time(text: Column, upload: Column) -> Column:
    """The first labelled or plain date of a text (year-month-day, or day/month/year), with a clock time behind it if
    there is one. Years outside 1970 to one after the upload's are no times."""
    ymd = F.regexp_extract(text, r"\b(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\b", 1)
    dmy = F.regexp_extract(text, r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})\b", 1)
    clock = F.regexp_extract(text, r"\b((?:[01]?\d|2[0-3]):[0-5]\d)\b", 1)
    part = lambda c, i: F.split(c, "[-/.]")[i].try_cast("int")
    hour, minute = (F.coalesce(F.split(clock, ":")[i].try_cast("int"), F.lit(0)) if i == 0 else F.coalesce(F.when(clock != "", F.split(clock, ":")[1].try_cast("int")), F.lit(0)) for i in (0, 1))
    hour = F.when(clock != "", hour).otherwise(0)
    made = lambda y, m, d: F.try_make_timestamp(y, m, d, hour, minute, F.lit(0))
    found = F.coalesce(F.when(ymd != "", made(part(ymd, 0), part(ymd, 1), part(ymd, 2))), F.when(dmy != "", made(part(dmy, 2), part(dmy, 1), part(dmy, 0))))
    return F.when((F.year(found) >= 1970) & (F.year(found) <= F.year(upload) + 1), found)


def resolve_timestamps(items: DataFrame) -> DataFrame:
    """First hit of the time sources of an item: its text, extracted entity time, chat, metadata and upload time.

    items: (case_id, item_id, text, entity_time, chat_time, metadata_time, upload_time).
    """
    times = {"labelled": stated_time(F.col("text"), F.col("upload_time")), "entity": F.col("entity_time"), "chat": F.col("chat_time"), "metadata": F.col("metadata_time"), "upload": F.col("upload_time")}
    hits = F.array_compact(F.array(*(F.when(t.isNotNull(), F.struct(t.alias("ts"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))) for (s, t), c in zip(times.items(), SOURCES.values(), strict=True))))
    first = F.get(hits, F.lit(0))
    return items.select("case_id", "item_id", first["ts"].alias("ts"), first["source"].alias("source"), first["confidence"].alias("confidence"), F.coalesce(first["source"] != "labelled", F.lit(False)).alias("inferred"))


def build_timeline(events: DataFrame) -> DataFrame:
    """One event per (case, item), the earliest; numbered by time in the case, unresolved ones last."""
    one = events.withColumn("_r", F.row_number().over(Window.partitionBy("case_id", "item_id").orderBy(F.col("ts").asc_nulls_last(), "source"))).where("_r = 1").drop("_r")
    return one.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("ts").asc_nulls_last(), "item_id")))


def classify_stages(texts: DataFrame) -> DataFrame:
    """The stages whose keywords a text contains, in stage order, and the keywords."""
    low = F.lower("text")
    found = {s: F.array_compact(F.array(*(F.when(low.contains(w), w) for w in words))) for s, words in K.STAGE_KEYWORDS.items()}
    return texts.select("case_id", "item_id", F.array_compact(F.array(*(F.when(F.size(f) > 0, s) for s, f in found.items()))).alias("stages"), F.array_join(F.concat(*found.values()), ",").alias("keywords"))


def critical_events(events: DataFrame, occ: DataFrame) -> DataFrame:
    """Whether an event's item holds a critical entity type, with up to three values a type as reasons."""
    types = occ.where(F.col("entity_type").isin(*K.CRITICAL_TYPES)).groupBy("case_id", "item_id", "entity_type").agg(F.slice(F.array_sort(F.collect_set("value")), 1, 3).alias("v"))
    reasons = types.groupBy("case_id", "item_id").agg(F.array_sort(F.collect_list(F.concat("entity_type", F.lit("="), F.array_join("v", "|")))).alias("reasons"))
    return events.join(reasons, ["case_id", "item_id"], "left").select("case_id", "item_id", F.col("reasons").isNotNull().alias("critical"), F.array_join("reasons", ";").alias("reasons"))


def attack_stages(events: DataFrame) -> DataFrame:
    """Per stage of a case: events, first and last time (fallback times left out), items in time order.

    events: (case_id, item_id, ts, source, stage).
    """
    real = F.when(F.col("source") != FALLBACK, F.col("ts"))
    listed = F.array_sort(F.collect_list(F.struct("ts", "item_id")))
    return events.groupBy("case_id", "stage").agg(F.count("*").alias("n"), F.min(real).alias("first_seen"), F.max(real).alias("last_seen"), F.element_at(listed, 1)["item_id"].alias("first_item"))


def milestones(events: DataFrame) -> DataFrame:
    """The first event of a case and the first of each of its stages."""
    w = Window.partitionBy("case_id", "stage").orderBy(F.col("ts").asc_nulls_last(), "item_id")
    firsts = events.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("case_id", "stage", "item_id", "ts")
    start = F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("ts").asc_nulls_last(), "item_id"))
    return firsts.withColumn("opens_case", start == 1)


def stage_progression(events: DataFrame, order: dict[str, int]) -> DataFrame:
    """Stages of a case in the order of their first time; consistent where that is the stage order; assessable where
    every staged event has an event time."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("stage"))
    first = events.groupBy("case_id", "stage").agg(F.min("ts").alias("first"), F.bool_and(F.col("source") != FALLBACK).alias("real")).withColumn("rank", rank)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "rank", "stage"))), lambda x: x["rank"])
    names = F.transform(F.array_sort(F.collect_list(F.struct("first", "rank", "stage"))), lambda x: x["stage"])
    return first.groupBy("case_id").agg(F.array_join(names, ">").alias("progression"), (listed == F.array_sort(listed)).alias("consistent"), F.bool_and("real").alias("assessable"))


def timeline_statistics(events: DataFrame) -> DataFrame:
    """Counts of resolved, unresolved, fallback and critical events, and the span with and without fallback times."""
    real = F.when(F.col("source") != FALLBACK, F.unix_micros("ts"))
    every = F.unix_micros("ts")
    hours = lambda a, b: F.round((b - a) / 3.6e9, 4)
    return events.groupBy("case_id").agg(
        F.count("ts").alias("resolved"), F.count_if(F.col("ts").isNull()).alias("unresolved"), F.count_if(F.col("source") == FALLBACK).alias("fallback"), F.count_if("critical").alias("critical"),
        hours(F.min(every), F.max(every)).alias("span_hours"), hours(F.min(real), F.max(real)).alias("event_span_hours"))


def correlated_with(pairs: DataFrame) -> DataFrame:
    """Per item how many items it is linked with, and the strongest of them."""
    both = pairs.select("case_id", F.col("a").alias("item_id"), F.col("b").alias("other"), "confidence").union(pairs.select("case_id", "b", "a", "confidence"))
    return both.groupBy("case_id", "item_id").agg(F.count("*").alias("links"), F.min(F.struct((-F.col("confidence")).alias("c"), "other")).alias("m")).select("case_id", "item_id", "links", F.col("m.other").alias("strongest"), (-F.col("m.c")).alias("confidence"))


def narrative(events: DataFrame) -> DataFrame:
    """One line of text an event."""
    return events.select("case_id", "item_id", F.concat_ws(" ", F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("undated")), F.lit("item"), F.col("item_id").cast("string"), F.concat(F.lit("("), "stage", F.lit(")"))).alias("line"))
