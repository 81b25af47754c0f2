"""URL and domain jobs: one chain of column expressions per URL, and equality joins against indicator tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselink.functions import web as W
from caselink.functions.scores import band, weighted_mean

AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_url(url: Column, reputation: bool = False) -> Column:
    """The comparison form: decoded, scheme http by default, host in lower case, no default port, fragment or closing
    slash; as reputation form also single slashes and sorted distinct query pairs."""

    def form(full: Column) -> Column:
        scheme = F.lower(F.regexp_extract(full, r"^([^:]+)://", 1))
        host = F.regexp_replace(F.concat(scheme, F.lit("://"), F.lower(F.regexp_extract(full, AUTHORITY + r"([^/?#]*)", 1))), "^(http://.*):80$|^(https://.*):443$", "$1$2")
        path = F.regexp_extract(full, r"://[^/?#]*([^?#]*)", 1)
        query = F.regexp_extract(full, r"\?([^#]*)", 1)
        if reputation:
            path = F.regexp_replace(path, "/{2,}", "/")
            query = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(query, "&"), lambda p: p != ""))), "&")
        return F.concat(host, F.regexp_replace(path, "/$", ""), let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))

    def decoded(raw: Column) -> Column:
        return let(F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw), lambda p: F.when(p.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), p).otherwise(F.concat(F.lit("http://"), p)))

    return let(F.trim(url), lambda raw: F.when(raw == "", "").otherwise(let(decoded(raw), form)))


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with scheme, host, port, path, query, fragment, suffix, domain, registered_domain, subdomain and counts."""
    u = F.col(url)
    host = F.lower(F.regexp_extract(u, AUTHORITY + r"([^/?#:]+)", 1))
    out = df.withColumns({
        "scheme": F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)), "host": host, "port": F.regexp_extract(u, AUTHORITY + r"[^/?#:]+:(\d+)", 1),
        "path": F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1), "query": F.regexp_extract(u, r"\?([^#]*)", 1), "fragment": F.regexp_extract(u, "#(.*)$", 1)})
    labels = F.split("host", r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    out = out.withColumn("is_ip", F.col("host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$"))
    out = out.withColumn("suffix", F.when(F.col("is_ip") | (F.size(labels) < 2), "").when(two.isin(*W.TWO_LABEL_SUFFIXES) & (F.size(labels) > 2), two).otherwise(F.element_at(labels, -1)))
    n = F.size(labels) - F.size(F.split("suffix", r"\."))
    out = out.withColumns({"domain": F.when(F.col("suffix") == "", F.col("host")).otherwise(F.get(labels, n - 1)), "subdomain": F.when(F.col("suffix") == "", "").otherwise(F.array_join(F.slice(labels, F.lit(1), F.greatest(n - 1, F.lit(0))), "."))})
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    last = F.coalesce(F.element_at(segments, F.when(F.size(segments) > 0, -1)), F.lit(""))
    return out.withColumns({
        "registered_domain": F.when(F.col("suffix") == "", F.col("host")).otherwise(F.concat_ws(".", "domain", "suffix")), "segments": segments, "filename": F.when(last.contains("."), last).otherwise(""),
        "extension": F.regexp_extract(last, r"\.([A-Za-z0-9]+)$", 1), "params": F.filter(F.split("query", "&"), lambda s: s != ""), "tokens": F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda s: s != "")})


def public_suffixes(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, suffix) of each different host with a dot: the longest ending that a rule names. Rules are those of a public
    suffix list, as ``read_suffix_rules`` gives them: ``co.uk``, ``*.ck`` for any label below, ``!www.ck`` for a name that
    such a rule doesn't mean. An ending that no rule names is a suffix by its last label.

    The endings of every host are exploded and meet the rules by equality.
    """
    h = hosts.select(F.lower(F.rtrim(F.col(host), F.lit("."))).alias("name"), F.col(host).alias("host")).where("name like '%.%'").distinct().withColumn("labels", F.split("name", r"\."))
    n = F.col("n")
    ends = h.select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"))
    below = F.when(n > 1, F.concat(F.lit("*."), F.array_join(F.slice("labels", F.size("labels") - n + 2, n - 1), "."))).otherwise("*")
    ending = F.array_join(F.slice("labels", F.size("labels") - n + 1, n), ".")
    keys = ends.select("host", "n", F.explode(F.array(ending, below, F.concat(F.lit("!"), ending))).alias("rule"))
    hit = keys.join(rules.select("rule").distinct(), "rule").groupBy("host").agg(F.max(F.when(F.col("rule").startswith("!"), F.col("n") - 1)).alias("except"), F.max("n").alias("most"))
    out = h.join(hit, "host", "left").withColumn("n", F.coalesce("except", "most", F.lit(1)))
    return out.select("host", F.array_join(F.slice("labels", F.size("labels") - F.col("n") + 1, F.col("n")), ".").alias("suffix"))


def with_public_suffix(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """What ``url_parts`` gives, its suffix, domain, registered_domain and subdomain by the rules. A host that is a suffix
    itself, an IP address or a single label has no suffix and is its own domain."""
    found = public_suffixes(parts.where("not is_ip"), rules).withColumnRenamed("suffix", "_suffix")
    out = parts.drop("suffix", "domain", "registered_domain", "subdomain").join(found, "host", "left")
    labels = F.split("host", r"\.")
    n = F.size(labels) - F.size(F.split("_suffix", r"\."))
    named = F.col("_suffix").isNotNull() & (n > 0)
    return out.withColumns({
        "suffix": F.when(named, F.col("_suffix")).otherwise(""), "domain": F.when(named, F.get(labels, n - 1)).otherwise(F.col("host")),
        "registered_domain": F.when(named, F.concat_ws(".", F.get(labels, n - 1), "_suffix")).otherwise(F.col("host")),
        "subdomain": F.when(named, F.array_join(F.slice(labels, F.lit(1), F.greatest(n - 1, F.lit(0))), ".")).otherwise("")}).drop("_suffix")


def validate_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Names of what is wrong or notable with each URL."""
    u, host = F.col(url), F.lower(F.regexp_extract(F.col(url), AUTHORITY + r"([^/?#:]+)", 1))
    private = host.rlike(r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)") | (host == "localhost")
    tests = {"empty": F.coalesce(F.trim(u), F.lit("")) == "", "data_uri": F.lower(u).startswith("data:"), "bad_scheme": ~F.lower(u).rlike("^(https?|ftp)://"), "ip_host": host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "private": private,
             "punycode": host.contains("xn--"), "unicode": ~u.rlike(r"^[\x00-\x7f]*$"), "shortener": host.isin(*W.SHORTENERS), "malformed_host": host.rlike(r"(\.\.|^-|-$|^\.|\.$)"), "null_byte": u.contains("\0"), "blank": u.rlike(r"\s")}
    return df.withColumn("findings", F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), k) for k, t in tests.items()))))


def count(col: str, pattern: str) -> Column:
    return F.regexp_count(F.col(col), F.lit(pattern))


def features_length() -> dict[str, Column]:
    sizes = F.transform("segments", lambda s: F.length(s))
    total = F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    out = {f"{k}_length": F.length(c) for k, c in (("url", "url"), ("hostname", "host"), ("domain", "domain"), ("path", "path"), ("query", "query"), ("subdomain", "subdomain"), ("filename", "filename"), ("fragment", "fragment"), ("tld", "suffix"), ("scheme", "scheme"))}
    return out | {"max_path_segment_length": F.coalesce(F.array_max(sizes), F.lit(0)), "avg_path_segment_length": F.round(F.when(F.size("segments") > 0, total / F.size("segments")).otherwise(0.0), 4)}


def features_character() -> dict[str, Column]:
    marks = {"dot": r"\.", "slash": "/", "hyphen": "-", "underscore": "_", "at_symbol": "@", "tilde": "~", "question_mark": r"\?", "ampersand": "&", "equals_sign": "=", "percent": "%"}
    out = {"digit_count": count("url", "[0-9]"), "letter_count": count("url", "[A-Za-z]"), "uppercase_count": count("url", "[A-Z]"), "lowercase_count": count("url", "[a-z]"), "special_char_count": count("url", r"[^A-Za-z0-9\s]")}
    return out | {f"{k}_count": count("url", p) for k, p in marks.items()}


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters in bits; 0 for the empty string."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    one = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.round(F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a - one(c) * F.log2(one(c))), 6)


def features_entropy() -> dict[str, Column]:
    out = {f"{k}_entropy": entropy(F.col(c)) for k, c in (("url", "url"), ("hostname", "host"), ("domain", "domain"), ("path", "path"), ("subdomain", "subdomain"), ("query", "query"))}
    vowels, rest = count("host", "[aeiou]"), count("host", "[b-df-hj-np-tv-z]")
    return out | {"digit_ratio": F.round(count("url", "[0-9]") / F.greatest(F.length("url"), F.lit(1)), 4), "vowel_consonant_ratio": F.round(F.when(rest > 0, vowels / rest).otherwise(0.0), 4)}


def features_structural() -> dict[str, Column]:
    return {"subdomain_count": F.when(F.col("subdomain") == "", 0).otherwise(F.size(F.split("subdomain", r"\."))), "directory_depth": F.greatest(F.size("segments") - F.when(F.col("filename") != "", 1).otherwise(0), F.lit(0)),
            "has_port": (F.col("port") != "").cast("int"), "has_query": (F.col("query") != "").cast("int"), "has_fragment": (F.col("fragment") != "").cast("int"), "has_at_symbol": F.col("url").contains("@").cast("int"),
            "has_double_slash": F.col("path").contains("//").cast("int"), "query_param_count": F.size("params"), "has_file_extension": (F.col("extension") != "").cast("int"), "path_segment_count": F.size("segments"), "has_www": F.col("host").startswith("www.").cast("int")}


def hits(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in words))


def features_lexical() -> dict[str, Column]:
    sizes = F.transform("tokens", lambda s: F.length(s))
    total = F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    bad, letters = hits(F.lower("url"), W.LURE_WORDS), count("url", "[A-Za-z]")
    longest = F.coalesce(F.array_max(sizes), F.lit(0))
    return {"url_token_count": F.size("tokens"), "avg_token_length": F.round(F.when(F.size("tokens") > 0, total / F.size("tokens")).otherwise(0.0), 4), "max_token_length": longest, "suspicious_keyword_count": bad,
            "contains_suspicious_keyword": (bad > 0).cast("int"), "longest_word_length": longest, "digit_to_letter_ratio": F.round(F.when(letters > 0, count("url", "[0-9]") / letters).otherwise(0.0), 4)}


def brand_hit(brand: str, text: Column) -> Column:
    """Whether a text holds a brand; brands of up to four letters need neighbours that aren't letters."""
    return text.contains(brand) if len(brand) > 4 else text.rlike(rf"(^|[^\p{{L}}]){brand}([^\p{{L}}]|$)")


BRANDS = [b for b in W.OFFICIAL_DOMAINS if b not in W.NOT_IMPERSONATED]


def features_brand(metadata: bool = False) -> dict[str, Column]:
    """The first brand (in fixed order) whose official domain this is or that the URL holds, and where; distance to the
    nearest brand. All flags are off on an official domain. ``metadata`` adds the names."""
    places = {"domain": F.lower("registered_domain"), "subdomain": F.lower("subdomain"), "path": F.lower("path"), "filename": F.lower("filename"), "query": F.lower("query")}
    found = lambda b, official, held: F.struct(F.lit(b).alias("brand"), F.lit(official).alias("official"), held.alias("held"))
    none = F.array().cast("array<string>")
    chain = F
    for b, own in ((b, W.OFFICIAL_DOMAINS[b]) for b in BRANDS):
        held = F.array_compact(F.array(*(F.when(brand_hit(b, text), place) for place, text in places.items())))
        chain = chain.when(F.col("registered_domain").isin(*own), found(b, True, none)).when(F.size(held) > 0, found(b, False, held))
    first = chain.otherwise(found(None, False, none))
    flag = lambda place: let(first, lambda x: F.array_contains(x["held"], place).cast("int"))
    near = F.array_min(F.array(*(F.struct(F.levenshtein(F.lower("domain"), F.lit(b)).alias("d"), F.lit(i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(BRANDS))))
    score = lambda x: F.when(x["official"], 0.0).otherwise(F.round(1 - near["d"] / F.greatest(F.length("domain"), F.length(near["b"]), F.lit(1)), 4))
    squat = lambda x: (near["d"].between(1, 2) & ~F.array_contains(x["held"], "domain") & ~x["official"]).cast("int")
    out = {f"brand_in_{k}": flag(k) for k in ("domain", "subdomain", "path")}
    out |= {"min_brand_distance": near["d"], "brand_similarity_score": let(first, score), "is_typosquat": let(first, squat)}
    names = {"brand_detected": let(first, lambda x: x["brand"]), "official_domain_match": let(first, lambda x: x["official"]), "closest_brand": near["b"],
             "brand_location": let(first, lambda x: F.when(x["official"], "domain").otherwise(F.coalesce(F.get(x["held"], 0), F.lit("none")))),
             "brand_similarity": let(first, lambda x: F.when(x["brand"].isNotNull(), score(x)).otherwise(0.0))}
    return out | names if metadata else out


def features_security() -> dict[str, Column]:
    strange = F.regexp_count(F.col("url"), F.lit(r"[^\x00-\x7f]"))
    return {"is_https": (F.col("scheme") == "https").cast("int"), "is_ip_address": F.col("is_ip").cast("int"), "is_punycode": F.col("host").contains("xn--").cast("int"), "has_homograph_chars": (strange > 0).cast("int"), "homograph_char_count": strange,
            "is_url_shortener": F.col("registered_domain").isin(*W.SHORTENERS).cast("int"), "is_data_uri": F.lower("url").startswith("data:").cast("int"), "has_javascript": F.lower("url").contains("javascript:").cast("int")}


def features_tld() -> dict[str, Column]:
    risky = F.col("suffix").isin(*W.RISKY_TLDS)
    country = F.length(F.element_at(F.split("suffix", r"\."), -1)) == 2
    return {"is_suspicious_tld": risky.cast("int"), "tld_risk_score": F.when(risky, 0.8).when(country, 0.3).when(F.col("suffix").isin("com", "org", "net", "edu", "gov"), 0.1).otherwise(0.4), "is_cctld": country.cast("int"),
            "is_new_gtld": (~country & ~F.col("suffix").isin("com", "org", "net", "edu", "gov", "mil", "int", "")).cast("int")}


FAMILIES = {"length": features_length, "character": features_character, "entropy": features_entropy, "structural": features_structural, "lexical": features_lexical, "brand": features_brand, "security": features_security, "tld": features_tld}


def url_features(df: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """The URL's numeric features in a fixed order; a null URL has null features and stays."""
    cols = {k: v for f in families for k, v in FAMILIES[f]().items()}
    return url_parts(df).select(*df.columns, *(c.alias(k) for k, c in cols.items()))


def rule_findings(features: DataFrame) -> DataFrame:
    """Rules that fire on a URL's features with their severities, their capped sum, and whether one of them is critical."""
    c = F.col
    on = lambda name: c(name) == 1
    host, words = F.lower(F.regexp_extract("url", AUTHORITY + r"([^/?#:]+)", 1)), c("suspicious_keyword_count")
    local = host.isin("localhost", "127.0.0.1", "") | host.startswith("192.168.")
    scheme = F.lower(F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    fires = {"is_ip_based": on("is_ip_address"), "is_url_shortener": on("is_url_shortener") | reduce(lambda a, b: a | b, (host.contains(x) for x in W.SHORTENERS)),
             "is_punycode": on("is_punycode"), "has_homograph_chars": on("has_homograph_chars"), "suspicious_tld": on("is_suspicious_tld") | (c("tld_risk_score") >= 0.7),
             "brand_in_subdomain": on("brand_in_subdomain"), "brand_in_domain": on("brand_in_domain"), "typosquatting": on("is_typosquat"),
             "excessive_subdomains": c("subdomain_count") >= 3, "suspicious_keywords": words >= 2, "suspicious_keyword_single": words == 1, "long_url": c("url_length") >= 75,
             "no_https": (c("is_https") == 0) & ~local, "double_slash_in_path": on("has_double_slash"), "at_symbol_in_url": on("has_at_symbol"),
             "data_or_js_uri": on("is_data_uri") | on("has_javascript") | scheme.isin("data", "javascript")}

    def finding(rule: str) -> Column:
        severity, share = W.RULES[rule]
        many = rule == "suspicious_keywords"
        return F.struct(F.lit(rule).alias("rule"), (F.when(words < 4, severity).otherwise("high") if many else F.lit(severity)).alias("severity"),
                        (F.least(F.lit(0.55), share * words) if many else F.lit(share)).alias("share"))

    found = features.select("url", F.array_compact(F.array(*(F.when(t, finding(k)) for k, t in fires.items()))).alias("found"))
    total = F.aggregate("found", F.lit(0.0), lambda n, x: n + x["share"])
    return found.select("url", F.array_join(F.transform("found", lambda x: x["rule"]), ",").alias("rules"),
                        F.array_join(F.transform("found", lambda x: x["severity"]), ",").alias("severities"),
                        F.round(F.least(F.lit(1.0), total), 4).alias("rule_score"), F.exists("found", lambda x: x["severity"] == "critical").alias("definite"))


def score_host(df: DataFrame) -> DataFrame:
    """Deterministic 0-100 score of a URL's host and its verdict; null where there is no host."""
    p = url_parts(df)
    words = F.regexp_replace("host", "[^a-z0-9]+", "")
    every = F.concat(words, F.regexp_replace(F.lower(F.concat("path", F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise(""))), "[^a-z0-9]+", ""))
    brands = [b for b in W.OFFICIAL_DOMAINS if b not in W.NOT_IMPERSONATED]
    official_names = [x for v in W.OFFICIAL_DOMAINS.values() for x in v]
    official = F.col("host").isin(*official_names) | F.col("registered_domain").isin(*official_names)
    pts = lambda t, n: F.when(t, n).otherwise(0)
    wording = lambda ws: F.when(hits(words, ws) > 0, 20).when(hits(every, ws) > 0, 10).otherwise(0)
    labels = F.split("host", r"\.")
    score = (pts(hits(words, brands) > 0, 55) + F.when(F.col("is_ip"), 40).when(F.element_at(labels, -1).isin(*W.RISKY_TLDS), 25).otherwise(0) + pts(F.col("registered_domain").isin(*W.SHORTENERS), 35)
             + pts(F.col("host").startswith("xn--") | F.col("host").contains(".xn--"), 30) + pts(F.size(labels) >= 5, 15) + pts(count("host", "-") >= 3, 15) + pts(F.length("host") > 40, 10) + pts(F.get(labels, F.lit(0)).rlike("^[0-9a-f]{8,}$"), 10)
             + wording(W.LURE_WORDS) + wording(W.REWARD_WORDS) + pts((hits(every, W.LURE_WORDS) > 0) & (hits(every, W.REWARD_WORDS) > 0), 10))
    scored = p.withColumn("risk_score", F.when(F.col("host").contains("."), F.when(official, 0).otherwise(F.least(score, F.lit(100)))))
    return scored.select(*df.columns, "host", "risk_score", F.when(F.col("risk_score") >= 70, "malicious").when(F.col("risk_score") >= 35, "suspicious").when(F.col("risk_score").isNotNull(), "benign").alias("verdict"))


def lookup_indicators(df: DataFrame, value: str, domain: str, *providers: DataFrame) -> DataFrame:
    """The first provider's verdict on the full value, else on its domain. Providers are (indicator, verdict), one row each."""
    out, names = df, []
    for i, p in enumerate(providers):
        for how in (value, domain):
            name = f"_v{i}_{how}"
            out = out.join(p.select(F.col("indicator").alias(how), F.col("verdict").alias(name)).dropDuplicates([how]), how, "left")
            names.append(name)
    verdict = F.coalesce(*names)
    return out.withColumns({"verdict": verdict, "malicious": F.coalesce(F.lower(verdict).isin("malicious", "phishing", "scam", "fraud"), F.lit(False))}).drop(*names)


def match_blocklist(df: DataFrame, feed: DataFrame) -> DataFrame:
    """Per URL how many feed rows have the same canonical URL, or else the same host."""
    own = url_parts(df).select(*df.columns, "host", canonical_url(F.col("url"), True).alias("form"))
    listed = url_parts(feed.select("url")).select("host", canonical_url(F.col("url"), True).alias("form"))
    by_form = listed.groupBy("form").agg(F.count("*").alias("exact"))
    by_host = listed.groupBy("host").agg(F.count("*").alias("same_host"))
    return (own.join(by_form, "form", "left").join(by_host, "host", "left").select(*df.columns, F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("same_host", F.lit(0)).alias("same_host"))
            .withColumn("match", F.when(F.col("exact") > 0, "url").when(F.col("same_host") > 0, "host").otherwise("none")))


def domain_risk(df: DataFrame) -> DataFrame:
    """Depth, entropy, randomness, embedded or near brand, and risk points of a URL's host."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    p = url_parts(df).select(*df.columns, "host").withColumns({
        "core": F.when(n >= 2, F.get(labels, n - 2)).otherwise(F.get(labels, F.lit(0))), "ending": F.when(n >= 2, F.get(labels, n - 1)).otherwise(""),
        "depth": F.greatest(n - 2, F.lit(0))})
    p = p.withColumn("flat", F.replace("core", F.lit("-"), F.lit(""))).withColumn("core_entropy", F.round(entropy(F.col("core")), 2))
    p = p.withColumn("randomness", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("core_entropy") - 2.6) / 1.6)), 2))
    chain = F
    named = lambda inside, near: F.struct(F.lit(inside).alias("inside"), F.lit(near).alias("near"))
    for b in W.PROTECTED_BRANDS:
        own, held, close = (F.col("flat") == b) | (F.col("core") == b), F.contains("flat", F.lit(b)), F.levenshtein("flat", F.lit(b), 1) >= 0
        chain = chain.when(own, named("", "")).when(held, named(b, "")).when(close, named("", b))
    p = p.withColumn("brand", chain.otherwise(named("", "")))
    tests = [(F.col("depth") >= 3, 10), ((F.col("randomness") >= 0.6) & (F.length("core") >= 8), 15), (F.col("ending").isin(*W.DOMAIN_RISKY_TLDS), 15),
             (~F.col("host").rlike(r"^[\x00-\x7f]*$"), 20), ((F.col("brand.inside") != "") | (F.col("brand.near") != ""), 30)]
    risk = reduce(lambda a, b: a + b, (F.when(t, k).otherwise(0) for t, k in tests))
    return p.select(*df.columns, "host", "depth", "core_entropy", "randomness", F.col("brand.inside").alias("impersonated_brand"), F.col("brand.near").alias("typosquat_of"), risk.alias("risk_points"))


def cloud_provider(host: Column) -> Column:
    """The cloud provider whose suffix the host ends with; null for others."""
    chain = F
    for name, suffixes in W.CLOUD_PROVIDERS.items():
        chain = chain.when(reduce(lambda a, b: a | b, (host.endswith(x) for x in suffixes)), name)
    return chain.otherwise(None)


def cloud_context(df: DataFrame) -> DataFrame:
    """Cloud provider of the host and how suspicious its use is, by wording, brands and what domain_risk finds."""
    p, url = domain_risk(df), F.lower("url")
    provider = cloud_provider(F.col("host"))
    signals = [hits(url, W.CLOUD_LOGIN_WORDS) > 0, hits(url, W.CLOUD_MONEY_WORDS) > 0, hits(url, W.CLOUD_BRAND_WORDS) > 0, F.col("impersonated_brand") != "",
               F.col("typosquat_of") != "", F.col("depth") >= 3]
    n = reduce(lambda a, b: a + b, (s.cast("int") for s in signals))
    seen = p.select(*df.columns, provider.alias("provider"), n.alias("n"))
    none = F.col("provider").isNull()
    return seen.select(*df.columns, "provider", F.when(none, 0).otherwise(F.col("n")).alias("signals"),
                       F.when(none | (F.col("n") == 0), 0).otherwise(F.least(F.lit(35), 12 + 8 * (F.col("n") - 1))).alias("points"))


def threat_score(df: DataFrame) -> DataFrame:
    """From (url, ml, rule, age_days, detections, official): intelligence, trust and composite scores, and a level."""
    age = F.when(F.col("age_days") < 30, 1.0).when(F.col("age_days") < 180, 0.6).when(F.col("age_days") < 365, 0.3).when(F.col("age_days").isNotNull(), 0.0)
    seen = F.when(F.col("detections") >= 5, 1.0).when(F.col("detections") >= 1, 0.5).when(F.col("detections").isNotNull(), 0.0)
    intel = F.coalesce(weighted_mean({"age": (age, 0.4), "seen": (seen, 0.6)}), F.lit(0.0))
    trust = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50.0 + F.when(F.col("official"), 40.0).otherwise(0.0) + F.when(F.col("age_days") > 365, 20.0).otherwise(0.0) - 40.0 * F.coalesce(seen, F.lit(0.0)))) / 100
    whole = 100 * (0.35 * F.col("ml") + 0.30 * F.col("rule") + 0.20 * intel + 0.15 * (1 - trust))
    score = F.round(F.when(F.col("official"), F.least(whole, F.lit(20.0))).otherwise(whole), 4)
    return df.select("url", F.round(intel, 4).alias("intel"), F.round(trust, 4).alias("trust"), score.alias("score")).withColumn("level", band(F.col("score"), {"safe": 20.0, "low": 40.0, "medium": 60.0, "high": 80.0, "critical": 101.0}))


#: Weights of the intelligence signals and of the parts of the hybrid score; names that add trust or doubt.
INTEL_WEIGHTS = {"domain_age": 0.10, "whois": 0.10, "virustotal": 0.15, "ssl": 0.08, "dns": 0.07, "tld_risk": 0.05, "brand_similarity": 0.10}
HYBRID_WEIGHTS = {"ml": 0.35, "rule": 0.30, "intel": 0.20, "distrust": 0.15}
TRUSTED_NETWORKS = ("google", "amazon", "microsoft", "cloudflare", "facebook", "fastly", "akamai")
TRUSTED_REGISTRARS = ("godaddy", "namecheap", "gandi", "markmonitor", "network solutions", "google")
PRIVATE_REGISTRARS = ("privacy", "redacted", "proxy", "whoisguard", "protected")
PLAIN_TLDS = ("com", "org", "net", "edu", "gov", "mil", "int")
HYBRID_LEVELS = {"Critical": 80, "High": 60, "Medium": 40, "Low": 20}
#: What ``hybrid_threat_score`` looks at beside url, ml and rule, with the type of each; a column that isn't there is null.
SIGNALS = {
    "domain": "string", "tld": "string", "official": "boolean", "brand_detected": "string", "is_typosquatting": "int", "url_entropy": "double", "domain_entropy": "double", "is_suspicious_tld": "int",
    "is_url_shortener": "int", "subdomain_count": "int", "age_days": "int", "whois_success": "boolean", "whois_registrar": "string", "whois_country": "string", "whois_dnssec": "string", "vt_success": "boolean",
    "vt_positives": "int", "vt_total": "int", "ssl_success": "boolean", "ssl_has": "boolean", "ssl_status": "string", "ssl_expired": "boolean", "ssl_self_signed": "boolean", "ssl_days_left": "int", "ssl_hsts": "boolean",
    "dns_success": "boolean", "dns_spf": "boolean", "dns_dmarc": "boolean", "dns_records": "int", "asn_org": "string",
}


def intel_scores(df: DataFrame, brands: tuple[str, ...], risky: tuple[str, ...]) -> dict[str, Column]:
    """The risk, 0 to 1, of each intelligence signal; without an answer most are in the middle."""
    c, yes = F.col, lambda n: F.coalesce(F.col(n), F.lit(False))
    some = lambda n, words: reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(n, F.lit(""))), F.lit(w)) for w in words))
    points = lambda tests: reduce(lambda a, b: a + b, (F.when(t, x).otherwise(0.0) for t, x in tests))
    age = F.when(c("age_days").isNull(), 0.5).when(c("age_days") <= 7, 1.0).when(c("age_days") <= 30, 0.85).when(c("age_days") <= 90, 0.6).when(c("age_days") <= 180, 0.4).when(c("age_days") <= 365, 0.2).otherwise(0.0)
    blank = lambda n: F.coalesce(c(n), F.lit("")) == ""
    whois = points([(blank("whois_registrar"), 1.0), (blank("whois_country"), 0.6), (some(c("whois_dnssec"), ("unsigned",)), 0.3), (some(c("whois_registrar"), PRIVATE_REGISTRARS), 0.5)]) / 4
    positives, total = F.coalesce(c("vt_positives"), F.lit(0)), F.coalesce(c("vt_total"), F.lit(1))
    ratio = positives / total
    vt = F.when(~yes("vt_success") | (total <= 0), 0.0).when(ratio >= 0.3, 1.0).when(ratio >= 0.15, 0.85).when(ratio >= 0.05, 0.6).when(positives >= 1, 0.35).otherwise(0.0)
    days = F.when(c("ssl_days_left") < 0, 1.0).when(c("ssl_days_left") <= 7, 0.7).when(c("ssl_days_left") <= 30, 0.4).otherwise(0.0)
    certificate = (points([(yes("ssl_expired"), 1.0), (yes("ssl_self_signed"), 0.9)]) + days) / 3
    ssl = F.when(~yes("ssl_success") | (F.coalesce(c("ssl_status"), F.lit("")) == "UNKNOWN"), 0.5).when(~yes("ssl_has"), 1.0).otherwise(F.least(F.lit(1.0), certificate))
    records = F.coalesce(c("dns_records"), F.lit(0))
    dns = (points([(~yes("dns_spf"), 0.7), (~yes("dns_dmarc"), 0.6)]) + F.when(records == 0, 1.0).when(records <= 2, 0.5).otherwise(0.0)) / 3
    name, url = F.lower(F.coalesce(c("domain"), F.lit(""))), F.lower("url")
    own = lambda b: name.isin(f"{b}.com", f"{b}.net", f"{b}.org", f"www.{b}.com")
    inside = reduce(lambda a, b: a + b, ((F.contains(name, F.lit(b)) & ~own(b)).cast("int") for b in brands))
    beside = reduce(lambda a, b: a + b, ((F.contains(url, F.lit(b)) & ~F.contains(name, F.lit(b))).cast("int") for b in brands))
    matched = F.when(inside > 0, inside).otherwise(beside)
    brand = F.when(name == "", 0.0).when(matched >= 2, 1.0).when(matched == 1, 0.8).otherwise(0.0)
    tld = F.regexp_replace(F.lower(F.coalesce(c("tld"), F.lit(""))), r"^\.+", "")
    ending = F.when(tld == "", 0.3).when(tld.isin(*risky), 1.0).when(tld.isin(*PLAIN_TLDS), 0.0).when(F.length(tld) == 2, 0.2).otherwise(0.3)
    return {"domain_age": age, "whois": F.when(~yes("whois_success"), 0.5).otherwise(F.least(F.lit(1.0), whois)), "virustotal": vt, "ssl": ssl, "dns": F.when(~yes("dns_success"), 0.5).otherwise(F.least(F.lit(1.0), dns)), "tld_risk": ending, "brand_similarity": brand}


def trust_score(df: DataFrame) -> Column:
    """What speaks for and against a domain, from 50, within 0 and 100."""
    c, yes = F.col, lambda n: F.coalesce(F.col(n), F.lit(False))
    some = lambda n, words: reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c(n), F.lit(""))), F.lit(w)) for w in words))
    signed = (F.coalesce(c("whois_dnssec"), F.lit("")) != "") & ~some("whois_dnssec", ("unsigned",))
    tests = [
        (yes("official"), 30), (c("ssl_status") == "VALID", 15), (yes("dns_spf"), 10), (yes("dns_dmarc"), 10), (signed, 10), (yes("ssl_hsts"), 5), (c("age_days") > 1825, 15), (c("age_days").between(366, 1825), 10),
        (some("asn_org", TRUSTED_NETWORKS), 5), (some("whois_registrar", TRUSTED_REGISTRARS), 5), (yes("vt_success") & (F.coalesce(c("vt_positives"), F.lit(0)) == 0), 10), (c("brand_detected").isNotNull() & ~yes("official"), -35),
        (c("is_typosquatting") == 1, -30), ((F.coalesce(c("url_entropy"), F.lit(0.0)) > 4.5) | (F.coalesce(c("domain_entropy"), F.lit(0.0)) > 4.0), -15), (c("age_days") < 90, -25), (c("is_suspicious_tld") == 1, -15),
        (c("is_url_shortener") == 1, -15), (c("subdomain_count") >= 3, -10)]
    return F.greatest(F.lit(0), F.least(F.lit(100), reduce(lambda a, b: a + b, (F.when(t, x).otherwise(0) for t, x in tests)) + 50))


def hybrid_threat_score(df: DataFrame, brands: tuple[str, ...] = tuple(W.OFFICIAL_DOMAINS), risky: tuple[str, ...] = W.SUSPICIOUS_TLDS) -> DataFrame:
    """``df`` with intel, trust, risk_score (0 to 100, at most 20 on an official domain) and risk_level, from url, ml, rule
    and what it has of ``SIGNALS``."""
    full = df.withColumns({n: F.lit(None).cast(t) for n, t in SIGNALS.items() if n not in df.columns})
    parts = intel_scores(full, brands, risky)
    intel = reduce(lambda a, b: a + b, (v * INTEL_WEIGHTS[k] for k, v in parts.items())) / round(sum(INTEL_WEIGHTS.values()), 10)
    out = full.withColumns({"intel": F.round(intel, 6), "trust": trust_score(full)})
    w = HYBRID_WEIGHTS
    whole = F.round((F.col("ml") * w["ml"] + F.col("rule") * w["rule"] + F.col("intel") * w["intel"] + (1 - F.col("trust") / 100) * w["distrust"]) * 100, 6)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(whole).cast("int")))
    score = F.when(F.coalesce("official", F.lit(False)), F.least(score, F.lit(20))).otherwise(score)
    level = reduce(lambda x, kv: x.when(score >= kv[1], kv[0]), HYBRID_LEVELS.items(), F).otherwise("Safe")
    return out.withColumns({"risk_score": score, "risk_level": level}).select(*df.columns, "intel", "trust", "risk_score", "risk_level")


def weighted_vote(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the 0-100 signals that aren't null, the decision, and its distance from the boundary."""
    out = df.withColumn("vote", F.round(weighted_mean({k: (F.col(k), w) for k, w in weights.items()}), 4))
    return out.withColumn("decision", F.when(F.col("vote") <= 30, "benign").when(F.col("vote") <= 60, "suspicious").when(F.col("vote").isNotNull(), "phishing")).withColumn("vote_confidence", F.round(F.abs(F.col("vote") - 50) / 50, 4))


def reputation(df: DataFrame) -> DataFrame:
    """From (url, exact, risk_points, points) and, where it is there, ``adjustment``: reputation 0-100 and level; unknown
    without any source. ``intel_adjustment`` gives the adjustment."""
    adjustment = F.col("adjustment") if "adjustment" in df.columns else F.lit(None).cast("int")
    known = F.col("exact").isNotNull() | F.col("risk_points").isNotNull() | F.col("points").isNotNull() | adjustment.isNotNull()
    z = lambda c: F.coalesce(c, F.lit(0))
    score = 100 - F.least(F.lit(70), 45 * z("exact")) - F.least(F.lit(60), z("risk_points")) - F.least(F.lit(35), z("points")) + z(adjustment)
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return df.withColumn("reputation", F.when(known, score)).withColumn("level", F.when(~known, "unknown").when(F.col("reputation") >= 85, "trusted").when(F.col("reputation") >= 60, "neutral").when(F.col("reputation") >= 35, "suspicious").otherwise("hostile"))


def intel_adjustment(intel: Column) -> Column:
    """Points that network intelligence, written out as text, adds to a reputation: 5 for an age told in years or as old, 3
    for SPF, 3 for DMARC, 4 for a valid certificate, 15 at most; null without intelligence."""
    flat = F.lower(intel)
    tests = [(flat.contains("age") & (flat.contains("year") | flat.contains("old")), 5), (flat.contains("spf"), 3), (flat.contains("dmarc"), 3), (flat.contains("valid") & flat.contains("ssl"), 4)]
    return F.when(F.coalesce(intel, F.lit("")) != "", F.least(F.lit(15), reduce(lambda a, b: a + b, (F.when(t, x).otherwise(0) for t, x in tests))))


def indicator_rows(df: DataFrame) -> DataFrame:
    """One row an indicator of a reputation row, with severity rank and confidence."""
    make = lambda t, name, rank, conf: F.when(t, F.struct(F.lit(name).alias("indicator"), F.lit(rank).alias("severity_rank"), F.lit(conf).alias("confidence")))
    rows = F.array_compact(F.array(make(F.col("exact") > 0, "blocklisted", 1, 0.95), make(F.col("risk_points") >= 30, "risky_domain", 2, 0.7), make(F.col("points") > 0, "cloud_abuse", 3, 0.6), make(F.col("risk_points").between(10, 29), "odd_domain", 4, 0.4)))
    return df.select("url", F.explode(rows).alias("i")).select("url", "i.*")


def explain(features: DataFrame) -> DataFrame:
    """Text reasons for a URL's risk, one per rule that fires."""
    c = F.col
    reasons = F.array_compact(F.array(F.when(c("is_ip_address") == 1, "uses a raw IP address"), F.when(c("is_https") == 0, "is not encrypted"), F.when(c("suspicious_keyword_count") > 0, F.format_string("holds %d suspicious words", "suspicious_keyword_count")),
                                      F.when(c("subdomain_count") >= 2, F.format_string("has %d subdomain levels", "subdomain_count")), F.when(c("is_suspicious_tld") == 1, "has a risky ending"), F.when(c("url_length") > 75, F.format_string("is %d characters long", "url_length"))))
    return features.select("url", F.array_join(reasons, "; ").alias("reasons"))


def classify_ioc(value: Column) -> Column:
    """The kind of an indicator: the first pattern that fits."""
    v = F.trim(value)
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    # The patterns of indicator kinds, in order.
    kinds = [("ipv4", rf"^{octet}(\.{octet}){{3}}$"), ("ipv6", r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"), ("url", r"(?i)^(https?://|www\.)"), ("email", r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$"), ("md5", "^[a-fA-F0-9]{32}$"), ("sha1", "^[a-fA-F0-9]{40}$"),
             ("sha256", "^[a-fA-F0-9]{64}$"), ("eth_wallet", "^0x[a-fA-F0-9]{40}$"), ("btc_wallet", "^(bc1[ac-hj-np-z02-9]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})$"), ("telegram", r"^@[A-Za-z][A-Za-z0-9_]{4,31}$|(?i)^(https?://)?t\.me/"),
             ("whatsapp", r"(?i)^(https?://)?wa\.me/\+?\d{8,15}$"), ("phone", r"^\+?[\d][\d\-\s]{6,15}\d$"), ("domain", r"(?i)^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}$")]
    out = F.when(v.rlike(kinds[0][1]), kinds[0][0])
    for name, pattern in kinds[1:]:
        out = out.when(v.rlike(pattern), name)
    return out.otherwise("unknown")


#: Characters by number, from 2 on; 0 fills up and 1 is any other character.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-/:?=&#%+_~@!$'()*,;[]{}|\\^`<>\""


def encode_urls(df: DataFrame, max_len: int = 256, alphabet: str = LETTERS) -> DataFrame:
    """``df`` with ``char_ids``: character numbers of the URL without space around it, cut and filled up to ``max_len``."""
    chars = F.slice(F.filter(F.split(F.trim("url"), ""), lambda c: c != ""), 1, max_len)
    ids = F.transform(chars, lambda c: F.when(F.instr(F.lit(alphabet), c) > 0, F.instr(F.lit(alphabet), c) + 1).otherwise(1))
    return df.withColumn("char_ids", F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - F.size(ids), F.lit(0)))))


def subwords(url: Column) -> Column:
    """The parts of a URL between its separators, and the separators."""
    return F.regexp_extract_all(url, F.lit(r"://|[/?&=#._@:-]|[^/?&=#._@:-]+"), F.lit(0))


def subword_vocabulary(df: DataFrame, size: int = 30_000) -> DataFrame:
    """(token, id, n): the ``size`` most frequent parts of all URLs, numbered from 2 on; 0 fills up and 1 is any other."""
    n = df.select(F.explode(subwords(F.col("url"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    top = n.orderBy(F.col("n").desc(), "token").limit(size)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.col("n").desc(), "token")) + 1).select("token", "id", "n")


def encode_subwords(df: DataFrame, vocabulary: DataFrame, max_len: int = 256) -> DataFrame:
    """``df`` with ``token_ids``: numbers of the URL's parts by the vocabulary, cut and filled up to ``max_len``. Different
    URLs are encoded once; their parts meet the vocabulary by equality."""
    own = df.select("url").distinct()
    each = own.select("url", F.posexplode(F.slice(subwords(F.col("url")), 1, max_len)).alias("place", "token")).join(vocabulary.select("token", "id"), "token", "left")
    ids = each.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("id", F.lit(1)).alias("id")))).alias("held")).select("url", F.transform("held", lambda x: x.id).alias("held"))
    got = F.coalesce("held", F.array().cast("array<int>"))
    return df.join(ids, "url", "left").select(*df.columns, F.concat(got, F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - F.size(got), F.lit(0)))).alias("token_ids"))
