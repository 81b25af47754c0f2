"""Registers, reconciliation, audit and case analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselink.functions import constants as K
from caselink.functions.scores import band, weighted_mean


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the newest version of each key; equal versions go by the other columns."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc(), *(c for c in df.columns if c not in (*keys, version)))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def append_if_changed(new: DataFrame, history: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Rows of ``new`` whose payload differs from the latest stored one, as the next version."""
    digest = F.sha2(F.to_json(F.struct(*payload)), 256)
    last = latest_version(history, keys, "version").select(*keys, F.col("version").alias("last_version"), digest.alias("last_digest"))
    return (new.withColumn("_digest", digest).join(last, keys, "left").where(~F.col("_digest").eqNullSafe(F.col("last_digest")))
            .withColumn("version", F.coalesce(F.col("last_version"), F.lit(0)) + 1).drop("_digest", "last_digest", "last_version"))


def replace_by_key(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every stored row of a key that ``fresh`` has, then add the fresh rows."""
    return existing.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def collapse_by_rank(df: DataFrame, key: str, rank: Column, order: list[str]) -> DataFrame:
    """Of duplicate rows the most advanced; the first in order wins ties."""
    w = Window.partitionBy(key).orderBy(rank.desc(), *order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def reconcile_occurrences(entities: DataFrame, register: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows with a known item, under the register's case, values lowered and trimmed; what was dropped."""
    value = F.lower(F.trim(F.coalesce(F.when(F.trim("normalized") != "", F.col("normalized")), F.col("value"))))
    filled = entities.withColumn("value", value).withColumn("complete", (F.coalesce("value", F.lit("")) != "") & (F.coalesce(F.trim("entity_type"), F.lit("")) != "") & F.col("case_id").isNotNull() & F.col("item_id").isNotNull())
    joined = filled.join(register.select("item_id", F.col("case_id").alias("owner")).distinct(), "item_id", "left")
    kept = joined.where("complete and owner is not null").select(F.col("owner").alias("case_id"), "item_id", "entity_type", "value")
    counts = joined.agg(F.count_if(~F.col("complete")).alias("incomplete"), F.count_if(F.col("complete") & F.col("owner").isNull()).alias("orphans"),
                        F.count_if(F.col("complete") & F.col("owner").isNotNull() & (F.col("owner") != F.col("case_id"))).alias("reattributed"))
    return kept, counts


def assemble_evidence(evidence: DataFrame, first: DataFrame, second: DataFrame, occ: DataFrame) -> DataFrame:
    """One row an item: confidence from the first source that has it, null if none, and its distinct values in order."""
    values = occ.groupBy("item_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "entity_type", "value"))).alias("entities"))
    return (evidence.join(first.select("item_id", F.col("confidence").alias("c1")), "item_id", "left").join(second.select("item_id", F.col("confidence").alias("c2")), "item_id", "left")
            .join(values, "item_id", "left").select("case_id", "item_id", "upload_time", F.coalesce("c1", "c2").alias("confidence"), F.coalesce(F.size("entities"), F.lit(0)).alias("n_entities"), F.element_at("entities", 1).alias("first_entity")))


def audit_feed(logs: list[DataFrame], contains: str | None = None, since: Column | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Logs of different shape as one (ts, actor, action, target), filtered, newest first, one page."""
    feed = logs[0]
    for log in logs[1:]:
        feed = feed.unionByName(log)
    if contains:
        feed = feed.where(F.lower("action").contains(contains.lower()))
    if since is not None:
        feed = feed.where(F.col("ts") >= since)
    return feed.orderBy(F.col("ts").desc(), "target", "actor").offset(offset).limit(limit)


def search_cases(cases: DataFrame, meta: DataFrame, q: str, status: str | None = None, archived: bool = False) -> DataFrame:
    """Cases with their workflow row (status OPEN without one), archived ones hidden, searched in id, title and tags."""
    out = cases.join(meta, "case_id", "left").withColumns({"status": F.coalesce("status", F.lit("OPEN")), "archived": F.coalesce("archived", F.lit(False)), "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    found = F.lower(F.col("case_id").cast("string")).contains(q.lower()) | F.lower("title").contains(q.lower()) | F.exists("tags", lambda t: F.lower(t).contains(q.lower()))
    out = out.where(found)
    if status:
        out = out.where(F.col("status") == status)
    return out if archived else out.where(~F.col("archived"))


def evidence_state(register: DataFrame, occ: DataFrame, text: DataFrame, forensics: DataFrame) -> DataFrame:
    """Per item what has been derived of it."""
    n = occ.groupBy("item_id").agg(F.count("*").alias("n"))
    return (register.select("item_id").join(n, "item_id", "left").join(text.select("item_id").distinct().withColumn("t", F.lit(True)), "item_id", "left").join(forensics.select("item_id").distinct().withColumn("f", F.lit(True)), "item_id", "left")
            .select("item_id", F.coalesce("n", F.lit(0)).alias("entity_count"), F.coalesce("t", F.lit(False)).alias("has_text"), F.coalesce("f", F.lit(False)).alias("has_forensics"))
            .withColumn("processed", (F.col("entity_count") > 0) | F.col("has_text") | F.col("has_forensics")))


def linked_cases(links: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """Every case and the cases that store a reference to it, from either table and side."""
    both = links.select("a", "b").union(links.select("b", "a")).union(graph_edges.select("a", "b")).union(graph_edges.select("b", "a"))
    return both.where("a <> b").distinct().groupBy(F.col("a").alias("case_id")).agg(F.count("*").alias("linked"), F.min("b").alias("first_linked"))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given keys."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def first_seen_duplicates(df: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """Per row the first id with its hash, whether it is a later copy, and how many share the hash."""
    w = df.groupBy(hash_col).agg(F.min(id_col).alias("original"), F.count("*").alias("copies"))
    return df.join(w, hash_col).select(id_col, "original", (F.col(id_col) != F.col("original")).alias("duplicate"), "copies")


def entity_statistics(occ: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent values of each type of a case, with the type's total."""
    counts = occ.groupBy("case_id", "entity_type", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("case_id", "entity_type").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("case_id", "entity_type").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).join(total, ["case_id", "entity_type"])


def threat_statistics(occ: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per case: indicators checked, flagged ones, items touched, ratio."""
    rows = occ.join(verdicts, "value").select("case_id", "item_id", "value", "bad")
    return (rows.groupBy("case_id").agg(F.count_distinct("value").alias("checked"), F.count_distinct(F.when(F.col("bad"), F.col("value"))).alias("flagged"), F.count_distinct(F.when(F.col("bad"), F.col("item_id"))).alias("items_touched"))
            .withColumn("ratio", F.round(F.col("flagged") / F.col("checked"), 4)))


def brand_statistics(texts: DataFrame, brands: DataFrame) -> DataFrame:
    """Items per brand token; an item counts once. ``brands`` (brand, token) is a short fixed list."""
    words = texts.select("case_id", "item_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("token"))
    return words.join(brands, "token").groupBy("brand").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("case_id").alias("cases"))


def payment_statistics(payments: DataFrame, n: int = 10) -> DataFrame:
    """The n most used payment ids, by rail and over all rails (rail 'all')."""
    by = payments.groupBy("rail", "payment_id").agg(F.count("*").alias("n"))
    both = by.unionByName(by.groupBy("payment_id").agg(F.sum("n").alias("n")).withColumn("rail", F.lit("all")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("rail").orderBy(F.col("n").desc(), "payment_id"))).where(F.col("rank") <= n)


def device_metadata_statistics(items: DataFrame) -> DataFrame:
    """Counts of EXIF, GPS, editing software and distinct devices by case."""
    return items.groupBy("case_id").agg(F.count_if("has_exif").alias("with_exif"), F.count_if("has_gps").alias("with_gps"), F.count_if(F.coalesce(F.col("software"), F.lit("")) != "").alias("edited"), F.count_distinct("device").alias("devices"))


def quality_statistics(items: DataFrame) -> DataFrame:
    """Means over present values, coverage, worst forgery score and verified items by case."""
    return items.groupBy("case_id").agg(F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count("confidence").alias("covered"), F.max("forgery").alias("max_forgery"), F.count_if("verified").alias("verified"), F.count("*").alias("items"))


def correlation_statistics(pairs: DataFrame) -> DataFrame:
    return pairs.where("strength <> 'NO_RELATIONSHIP'").groupBy("case_id").agg(F.count("*").alias("related"), (F.sum(F.round(F.col("confidence") * 10000).cast("long")) / F.count("*") / 10000).alias("mean_confidence"), F.max("confidence").alias("max_confidence"))


def case_priority(facts: DataFrame) -> DataFrame:
    """Priority of a case from up to six 0-100 components; absent ones leave the mean."""
    score = weighted_mean({k: (F.col(k), w) for k, w in K.PRIORITY_WEIGHTS.items()})
    return facts.withColumn("score", F.round(score, 2)).withColumn("priority", F.when(F.col("score").isNotNull(), band(F.col("score"), K.PRIORITY_BANDS)))


def portfolio(cases: DataFrame) -> DataFrame:
    """Cases by status and band, with mean score and coverage."""
    return cases.groupBy("status", "priority").agg(F.count("*").alias("cases"), F.round(F.avg("score"), 6).alias("mean_score"), F.count("score").alias("scored"))


def processing_time(logs: DataFrame, umbrella: str) -> DataFrame:
    """Per case: the umbrella stage's time where logged, else the sum of the others; bad durations are 0."""
    ms = F.coalesce(F.try_to_number(F.col("duration").cast("string"), F.lit("999999999.999")).cast("double"), F.lit(0.0)) if dict(logs.dtypes)["duration"] == "string" else F.coalesce(F.col("duration"), F.lit(0.0))
    rows = logs.withColumn("ms", ms)
    return (rows.groupBy("case_id").agg(F.sum(F.when(F.col("stage") == umbrella, F.col("ms"))).alias("whole"), F.sum(F.when(F.col("stage") != umbrella, F.col("ms"))).alias("parts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .select("case_id", F.round(F.coalesce("whole", "parts"), 4).alias("total_ms"), F.col("whole").isNull().alias("from_parts"), "first_ts", "last_ts"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Each step ends when the next of its job starts; the last stays open."""
    w = Window.partitionBy("job").orderBy("ts", "event_id")
    ends = F.lead(F.unix_micros("ts")).over(w)
    return events.select("job", "event_id", "stage", F.when(ends.isNotNull(), F.greatest(F.lit(0), F.floor((ends - F.unix_micros("ts")) / 1000))).alias("elapsed_ms"))


#: What evidences payments and credentials, and how losing access is told.
PAYMENT_TYPES = ("wallets", "esewa_ids", "khalti_ids", "imepay_ids", "bank_accounts", "card_numbers", "transaction_ids", "eth_wallets", "btc_wallets")
CREDENTIAL_TYPES = ("otp",)
CREDENTIAL_TEXT = ("otp", "password", "pin", "cvv", "login", "security code")
LOCKOUT_TEXT = ("blocked me", "locked out", "cannot login", "can't login", "cannot access", "account deleted", "deleted my", "lost access")


def case_rules(occ: DataFrame, texts: DataFrame, flagged: DataFrame, members: DataFrame, links: DataFrame, brands: DataFrame) -> DataFrame:
    """(case_id, rule, items, first_item) of the ten case rules that fire; items are those a rule rests on, none where it
    rests on other cases or other rules.

    occ: case_id, item_id, entity_type. texts: case_id, item_id, text. flagged: case_id, n (bad indicators). members:
    case_id, campaign, item_id. links: case_id, other_case. brands: case_id, item_id, brand, method. A payment identifier
    and an amount, or a bad indicator and a web address, need only be in the same case. The last rule fires if any did.
    """
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("text"), w))
    of = lambda kinds: occ.where(F.col("entity_type").isin(*kinds)).select("case_id", "item_id")
    only = lambda rows, cases: rows.join(cases.select("case_id").distinct(), "case_id", "left_semi")
    sizes = members.groupBy("case_id", "campaign").agg(F.count_distinct("item_id").alias("size"))
    largest = sizes.groupBy("case_id").agg(F.min(F.struct((-F.col("size")).alias("less"), "campaign")).alias("m")).where("m.less <= -2").select("case_id", F.col("m.campaign").alias("campaign"))
    together = members.join(largest, ["case_id", "campaign"], "left_semi").select("case_id", "item_id")
    named = brands.where(F.trim("brand") != "")
    rules = {
        "payment": only(of(PAYMENT_TYPES), of(("money",))), "publication": only(of(("urls", "domains")), flagged.where("n > 0")), "access": of(CREDENTIAL_TYPES).unionByName(texts.where(says(CREDENTIAL_TEXT)).select("case_id", "item_id")),
        "damage": texts.where(says(LOCKOUT_TEXT)).select("case_id", "item_id"), "abetment": together, "accomplice": together, "cross_case": links.select("case_id", F.lit(None).cast(occ.schema["item_id"].dataType).alias("item_id")),
        "trademark": named.select("case_id", "item_id"), "copyright": named.where(F.lower("method").contains("template")).select("case_id", "item_id")}
    every = None
    for rule, rows in rules.items():
        part = rows.groupBy("case_id").agg(F.count_distinct("item_id").alias("items"), F.min("item_id").alias("first_item")).select("case_id", F.lit(rule).alias("rule"), "items", "first_item")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("case_id").agg(F.collect_list(F.struct("rule", "items", "first_item")).alias("r")).select(
        "case_id", F.explode(F.concat("r", F.array(F.struct(F.lit("confiscation").alias("rule"), F.lit(0).cast("long").alias("items"), F.lit(None).cast(occ.schema["item_id"].dataType).alias("first_item"))))).alias("x")).select("case_id", "x.*")


def rule_matches(facts: DataFrame) -> DataFrame:
    """Case-level rules over an item table with flags: one row a rule and case it fires in, with its items.

    facts: (case_id, item_id, payment, money, flagged, address, credential, lockout, brand). The consequential rule
    fires when any other did.
    """
    rules = {
        "payment_fraud": F.col("payment") & F.col("money"), "flagged_address": F.col("flagged") & F.col("address"), "credential_harvest": F.col("credential"),
        "lockout_pressure": F.col("lockout"), "brand_misuse": F.col("brand"), "money_request": F.col("money") & F.col("lockout")}
    hits = facts.select("case_id", "item_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule"))
    out = hits.groupBy("case_id", "rule").agg(F.count_distinct("item_id").alias("items"), F.min("item_id").alias("first_item"))
    follow = hits.groupBy("case_id").agg(F.count_distinct("item_id").alias("items"), F.min("item_id").alias("first_item")).withColumn("rule", F.lit("follow_up"))
    return out.unionByName(follow)
