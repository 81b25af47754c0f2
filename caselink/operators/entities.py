"""Typed entities, keyword signals and language of texts: one pass of column expressions per text, no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.functions import constants as K
from caselink.functions.patterns import CLOSING, ENDINGS, PATTERNS


def normalize_money(value: Column) -> Column:
    """``<CODE> <amount>``: one form for an amount however it is written."""
    number = F.regexp_extract(value, r"[0-9][0-9,]*(?:\.[0-9]{1,2})?", 0)
    amount = F.regexp_replace(number, ",", "").cast("decimal(38,2)")
    shown = F.regexp_replace(F.regexp_replace(amount.cast("string"), "0+$", ""), r"\.$", "")
    token = F.lower(F.regexp_replace(F.regexp_replace(value, r"[0-9][0-9,]*(?:\.[0-9]{1,2})?", ""), r"^[ .]+|[ .]+$", ""))
    code = F.when(token.isin("npr", "rs", "rupees", "rupaiya"), "NPR").when(token.isin("inr", "₹"), "INR").when(token.isin("usd", "$", "dollar", "dollars"), "USD").when(token.isin("eur", "€"), "EUR").when(token.isin("gbp", "£"), "GBP").when(token == "paisa", "NPR-PAISA").otherwise(F.upper(token))
    return F.when(number == "", F.trim(value)).otherwise(F.trim(F.concat_ws(" ", code, shown)))


def normalize_phone(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(digits.rlike("^9[678][0-9]{8}$"), F.concat(F.lit("+977"), digits)).when(digits.rlike("^977[0-9]{10}$"), F.concat(F.lit("+"), digits)).when(F.trim(value).startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)


def valid_card(value: Column) -> Column:
    """Issuer prefix and length, more than one digit, and the Luhn check."""
    d = F.regexp_replace(value, "[^0-9]", "")
    n, p2, p4 = F.length(d), F.substring(d, 1, 2).try_cast("int"), F.substring(d, 1, 4).try_cast("int")
    issuer = ((F.substring(d, 1, 1) == "4") & n.isin(13, 16, 19) | p2.between(51, 55) & (n == 16) | p4.between(2221, 2720) & (n == 16) | p2.isin(34, 37) & (n == 15) | (p4 == 6011) & (n == 16) | (p2 == 65) & (n == 16)
              | (p2 == 62) & n.between(16, 19) | (p2 == 35) & (n == 16) | p2.isin(36, 38) & (n == 14))
    return issuer & ~d.rlike(r"^([0-9])\1*$") & F.call_function("luhn_check", d)


def valid_ipv6(value: Column) -> Column:
    """Eight groups of up to four hexadecimal digits, or at most seven where one ``::`` stands for the others."""
    groups = F.filter(F.split(value, ":"), lambda g: g != "")
    short = value.contains("::")
    whole = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & ~value.rlike(":::|::.*::|^:[^:]|[^:]:$")
    return whole & F.when(short, F.size(groups) <= 7).otherwise((F.size(groups) == 8) & (F.size(F.split(value, ":")) == 8))


def trimmed(value: Column) -> Column:
    """Without white space around it and punctuation after it."""
    closing = "[" + CLOSING.replace("]", "\\]") + "]+$"
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), closing, ""))


def _normal(kind: str, v: Column) -> Column:
    if kind in ("emails", "hashes_sha512", "hashes_sha256", "hashes_sha1", "hashes_md5", "eth_wallets", "telegram_usernames", "facebook_usernames", "instagram_usernames", "domains"):
        return F.lower(v)
    if kind in ("urls", "social_media_urls"):
        cut = F.regexp_replace(v, r"[.,;:!?)\]]+$", "")
        head = F.regexp_extract(cut, r"^((?:[Hh][Tt][Tt][Pp][Ss]?://)?[^/]+)", 1)
        return F.concat(F.lower(head), F.substr(cut, F.length(head) + 1))
    if kind == "mac_addresses":
        return F.lower(F.replace(v, F.lit("-"), F.lit(":")))
    if kind in ("cve_ids", "transaction_ids"):
        return F.upper(v)
    if kind in ("phones", "whatsapp_numbers"):
        return normalize_phone(v)
    if kind in ("esewa_ids", "khalti_ids", "imepay_ids"):
        return F.when(v.contains("@"), F.lower(v)).otherwise(normalize_phone(v))
    if kind == "money":
        return normalize_money(v)
    if kind in ("bank_accounts", "card_numbers"):
        return F.regexp_replace(v, r"[\s-]", "")
    return v


def _valid(kind: str, v: Column) -> Column | None:
    if kind == "phones":
        return F.size(F.array_distinct(F.split(F.regexp_replace(v, "[^0-9]", ""), ""))) >= 3
    if kind == "card_numbers":
        return valid_card(v)
    if kind == "domains":
        return v.contains(".") & ~v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & (F.length(F.substring_index(v, ".", -1)) >= 2)
    if kind == "ipv6":
        return valid_ipv6(v)
    if kind == "ports":
        return v.cast("int").between(1, 65535)
    if kind == "transaction_ids":
        return (F.length(v) >= 5) & v.rlike("[0-9]") & ~v.rlike(r"^[0-9]{1,3}(,[0-9]{3})*(\.[0-9]{1,2})?$") & ~v.rlike(r"^[0-9]+\.[0-9]+$") & ~v.rlike(r"(?i)^CVE-[0-9]{4}-[0-9]{4,7}$")
    return None


def extract_entities(df: DataFrame, groups: tuple[str, ...] = tuple(PATTERNS), id_cols: tuple[str, ...] = ("case_id", "item_id"), text: str = "text") -> DataFrame:
    """(ids, entity_type, value, normalized), once per normalised value of an item. A shorter hash inside a longer one of
    the same text goes; hosts of URLs and e-mail addresses are domains too."""
    arrays = {}
    for group in groups:
        for kind, (pattern, parts) in PATTERNS[group].items():
            found = [F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(i)) for i in parts]
            arrays[kind] = F.filter(F.concat(*found), lambda v: v != "")
    out = df.select(*id_cols, F.col(text).alias("_text"), *(a.alias(k) for k, a in arrays.items()))
    longer = [h for h in ("hashes_sha512", "hashes_sha256", "hashes_sha1") if h in arrays]
    for i, h in enumerate(("hashes_sha256", "hashes_sha1", "hashes_md5")):
        if h in arrays:
            above = F.concat(*longer[: i + 1])
            out = out.withColumn(h, F.filter(h, lambda v: ~F.exists(above, lambda x: F.contains(F.lower(x), F.lower(v)))))
    if "domains" in arrays:
        # a bare name needs a known ending; hosts of URLs and mail addresses are domains by where they stand
        bare = F.filter("domains", lambda v: F.lower(F.substring_index(v, ".", -1)).isin(*ENDINGS))
        hosts = F.transform("urls", lambda u: F.regexp_extract(F.lower(u), r"^(?:https?://)?([^/:?#]+)", 1)) if "urls" in arrays else F.array().cast("array<string>")
        mail = F.transform(F.regexp_extract_all(F.coalesce(F.col("_text"), F.lit("")), F.lit(PATTERNS["contact"]["emails"][0]), F.lit(0)), lambda v: F.substring_index(v, "@", -1))
        out = out.withColumn("domains", F.concat(bare, hosts, mail))
    rows = None
    for kind in arrays:
        v = F.col("value")
        part = out.select(*id_cols, F.lit(kind).alias("entity_type"), F.explode(kind).alias("value")).withColumn("value", trimmed(F.col("value"))).where("value <> ''")
        part = part.where(_valid(kind, v)) if _valid(kind, v) is not None else part
        part = part.withColumn("normalized", _normal(kind, v))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*id_cols, "entity_type", "normalized").agg(F.min("value").alias("value"))


def _keyword_n(low: Column, variants: tuple[str, ...]) -> Column:
    """Whole-word counts of a group's spellings; a spelling is only counted in texts that hold its letters at all."""
    return reduce(lambda a, b: a + b, (F.when(low.contains(v), F.regexp_count(low, F.lit(rf"\b{v}\b" if v.isascii() else v))).otherwise(0) for v in variants))


def _low(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))


def keyword_counts(df: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(id, keyword, category, n): whole-word counts of each keyword group that a text has."""
    found = [F.struct(F.lit(k).alias("keyword"), F.lit(c).alias("category"), _keyword_n(F.col("low"), variants).alias("n")) for k, (c, variants) in K.KEYWORD_GROUPS.items()]
    return _low(df, id_col, text).select(F.col(id_col), F.explode(F.array(*found)).alias("s")).select(id_col, "s.*").where("n > 0")


def keyword_signals(df: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """Counts by category of every text."""
    kinds = ("urgency", "financial", "credential", "threat")
    each = _low(df, id_col, text).select(id_col, *(reduce(lambda a, b: a + b, (_keyword_n(F.col("low"), v) for c, v in K.KEYWORD_GROUPS.values() if c == kind)).alias(kind) for kind in kinds))
    counts = each.groupBy(id_col).agg(*(F.sum(kind).alias(kind) for kind in kinds))
    return df.select(id_col).join(counts, id_col, "left").na.fill(0)


#: Words that mark romanised Nepali.
ROMAN_MARKERS = ("ho", "cha", "chha", "ko", "ma", "le", "lai", "haru", "garnu", "pathaunus", "paisa", "timro", "mero", "hamro", "kasari", "kati", "dai", "didi", "bhai")


def detect_language(df: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """Label of each text: that of all its lines with letters if they agree, else mixed; unknown without letters."""
    line = F.col("line")
    words = F.filter(F.split(F.lower(line), "[^a-z]+"), lambda w: w != "")
    marked = F.size(F.filter(words, lambda w: w.isin(*ROMAN_MARKERS)))
    nepali, latin = F.regexp_count(line, F.lit("[ऀ-ॿ]")), F.regexp_count(line, F.lit(r"[A-Za-z]"))
    label = (F.when((nepali == 0) & (latin == 0), "unknown").when((nepali > 0) & (latin > 0), "mixed").when(nepali > 0, "nepali_unicode")
             .when((marked >= 2) & (marked / F.size(words) >= 0.30) | (marked >= 1) & (F.size(words) <= 3), "roman_nepali").otherwise("english"))
    lines = df.select(id_col, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).withColumn("label", label)
    known = lines.groupBy(id_col).agg(F.collect_set(F.when(F.col("label") != "unknown", F.col("label"))).alias("labels"), F.count("*").alias("lines"))
    return known.select(id_col, "lines", F.when(F.size("labels") == 0, "unknown").when(F.size("labels") == 1, F.get("labels", F.lit(0))).otherwise("mixed").alias("language"))


def line_confidence(lines: DataFrame, id_col: str = "item_id", discard: bool = False) -> DataFrame:
    """Per item: lines, mean, least, largest and median confidence, and lines by tier."""
    c = F.col("confidence")
    tier = F.when(c >= 0.90, "high").when(c >= 0.60, "medium").when((c < 0.30) & F.lit(discard), "discarded").otherwise("low")
    return lines.withColumn("tier", tier).groupBy(id_col).agg(F.count("*").alias("lines"), F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.median(c), 6).alias("median"),
                                                             *(F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low", "discarded")))


def evidence_confidence(df: DataFrame) -> DataFrame:
    """Weighted mean of the components that are there (0-100), and its band. Forgery counts inversely, each metadata note
    costs 20, a failed hash check is 0."""
    from caselink.functions.scores import band, weighted_mean

    parts = {"text": (F.col("text_confidence"), 0.25), "forgery": (100 - F.col("forgery"), 0.25), "metadata": (F.greatest(F.lit(0.0), 100.0 - 20 * F.col("notes")), 0.2), "hash": (F.when(F.col("hash_ok"), 100.0).when(~F.col("hash_ok"), 0.0), 0.3)}
    return df.withColumn("score", F.round(weighted_mean(parts), 2)).withColumn("band", F.when(F.col("score").isNotNull(), band(F.col("score"), {"LOW": 40.0, "MEDIUM": 70.0, "HIGH": 101.0})))


def chat_messages(blocks: DataFrame) -> DataFrame:
    """From positioned blocks (page, block, x, y, text): messages in reading order with their side and clock time; a page
    is a chat with at least three blocks on both sides."""
    from pyspark.sql import Window

    w = Window.partitionBy("page").orderBy("y", "block")
    clock = F.col("text").rlike(r"^\s*(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\s?(?:AM|PM|am|pm)?\s*$")
    rows = blocks.withColumn("time_only", clock).withColumn("side", F.when(F.col("x") > 0.55, "right").when(F.col("x") < 0.45, "left").otherwise("middle"))
    rows = rows.withColumn("sent_at", F.when(F.lead("time_only").over(w), F.trim(F.lead("text").over(w)))).where("not time_only")
    sides = rows.groupBy("page").agg(F.count("*").alias("n"), F.bool_or(F.col("side") == "left").alias("l"), F.bool_or(F.col("side") == "right").alias("r")).where("n >= 3 and l and r").select("page")
    return rows.join(sides, "page", "left_semi").withColumn("position", F.row_number().over(w)).select("page", "position", "side", "text", "sent_at")
