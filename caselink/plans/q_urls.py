"""Queries of the URL operators over pages; indicator tables come from other pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselink.functions import brands as B
from caselink.functions import web as W
from caselink.operators import brands, urls as op
from caselink.plans.tables import table


def _urls(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


def d1_canonical_url(spark, d):
    return _urls(spark, d).select("page_id", op.canonical_url(F.col("url")).alias("form"), op.canonical_url(F.col("url"), True).alias("reputation_form"))


def d2_url_parts(spark, d):
    return op.url_parts(_urls(spark, d)).select("page_id", "scheme", "host", "port", "path", "query", "fragment", "suffix", "domain", "registered_domain", "subdomain", "extension")


#: Rules of a suffix list for the given hosts: a plain one, a wildcard, an exception.
SUFFIX_RULES = ("com", "net", "org", "example.com", "*.example.net", "!www.example.net", "spam-farm.example.org")


def d2_public_suffix(spark, d):
    rules = spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    return op.with_public_suffix(op.url_parts(_urls(spark, d)), rules).select("page_id", "host", "suffix", "domain", "registered_domain", "subdomain")


def d3_validate_urls(spark, d):
    return op.validate_urls(_urls(spark, d)).select("page_id", F.array_join("findings", ",").alias("findings"))


def _family(name):
    def run(spark, d):
        return op.url_features(_urls(spark, d), (name,))

    return run


def d9_features_brand(spark, d):
    return op.url_parts(_urls(spark, d)).select("page_id", "url", *(c.alias(k) for k, c in op.features_brand(metadata=True).items()))


def d12_url_features(spark, d):
    return op.url_features(_urls(spark, d))


def d13_rule_findings(spark, d):
    return op.rule_findings(op.url_features(_urls(spark, d)))


def d14_score_host(spark, d):
    return op.score_host(_urls(spark, d))


def d15_lookup_indicators(spark, d):
    parts = op.url_parts(_urls(spark, d)).select("page_id", "url", "host")
    full = _urls(spark, d).where(F.col("url").contains("ref=")).groupBy(F.col("url").alias("indicator")).agg(F.lit("Phishing").alias("verdict"))
    hosts = op.url_parts(_urls(spark, d).where(F.col("url").contains("/fr/"))).select(F.col("host").alias("indicator")).distinct().withColumn("verdict", F.lit("clean"))
    return op.lookup_indicators(parts, "url", "host", full, hosts)


def d16_match_blocklist(spark, d):
    return op.match_blocklist(_urls(spark, d), _urls(spark, d).where(F.col("url").contains("utm_source")))


def d17_domain_risk(spark, d):
    return op.domain_risk(_urls(spark, d))


def d18_cloud_context(spark, d):
    return op.cloud_context(_urls(spark, d).withColumn("url", F.regexp_replace("url", r"example\.org", "github.io")))


#: Hosts of the given pages with brands, imitations of brands, and cloud hosts in them; the same text in both dialects.
SPOOFED = """replace(replace(replace(replace(url, 'example.net', 'example.com'), 'example.org', 'example.com'), 'example.com',
  CASE page_id % 12 WHEN 0 THEN 'paypal' WHEN 1 THEN 'paypa1' WHEN 2 THEN 'secure-netflix' WHEN 3 THEN 'micros0ft-login' WHEN 4 THEN 'gogole' WHEN 5 THEN 'example'
    WHEN 6 THEN 'faceboook' WHEN 7 THEN 'khalti' WHEN 8 THEN 'rnicrosoft' WHEN 9 THEN 'amazon-prime' WHEN 10 THEN 'log.insta-help' ELSE 'nabil' END
  || CASE page_id % 5 WHEN 0 THEN '.github.io' WHEN 1 THEN '.netlify.app' WHEN 2 THEN '.com.np' ELSE '.com' END), '/en/', '/login/whatsapp/')"""


def _spoofed(spark, d):
    return _urls(spark, d).withColumn("url", F.expr(SPOOFED))


def d19_brand_findings(spark, d):
    return brands.brand_findings(_spoofed(spark, d))


def d19_brand_risk(spark, d):
    more = {"domain_age_days": F.when(F.col("page_id") % 3 > 0, F.col("page_id") % 400), "ssl_valid": F.col("page_id") % 4 > 0, "whois_private": F.col("page_id") % 7 == 0, "suspicious_keyword_count": F.col("page_id") % 4}
    return brands.brand_risk(_spoofed(spark, d).withColumns(more)).select("page_id", "url", "official_brand", F.array_join(F.array_sort("brands"), ",").alias("brands"), "brand_score", "brand_level")


def _intel(spark, d):
    u = op.url_features(_urls(spark, d), ("length", "security"))
    return u.select("url", (F.col("url_length") % 100 / 100).alias("ml"), (F.col("path_length") % 50 / 50).alias("rule"), F.when(F.col("is_https") == 1, F.col("page_id") % 1000).alias("age_days"), F.when(F.col("page_id") % 3 == 0, F.col("page_id") % 7).alias("detections"), (F.col("page_id") % 11 == 0).alias("official"))


def d20_threat_score(spark, d):
    return op.threat_score(_intel(spark, d))


#: Signals of the given pages, made of their numbers; the same text in both dialects.
MADE = {
    "ml": "(page_id % 101) / 100.0", "rule": "(page_id % 37) / 40.0", "domain": "CASE page_id % 9 WHEN 0 THEN 'esewa.com' WHEN 1 THEN 'my-esewa-khalti.com' WHEN 2 THEN 'khalti-x.org' ELSE 'plain.net' END",
    "tld": "CASE page_id % 6 WHEN 0 THEN '.xyz' WHEN 1 THEN 'com' WHEN 2 THEN 'np' WHEN 3 THEN 'shop' WHEN 4 THEN '' END", "official": "page_id % 13 = 0", "brand_detected": "CASE WHEN page_id % 4 = 0 THEN 'esewa' END",
    "is_typosquatting": "CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END", "url_entropy": "CAST(3 + (page_id % 20) / 10.0 AS DOUBLE)", "domain_entropy": "CAST((page_id % 45) / 10.0 AS DOUBLE)", "is_suspicious_tld": "CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END",
    "is_url_shortener": "CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END", "subdomain_count": "CAST(page_id % 5 AS INT)", "age_days": "CASE WHEN page_id % 5 > 0 THEN CAST(page_id * 7 % 2500 - 3 AS INT) END", "whois_success": "page_id % 3 > 0",
    "whois_registrar": "CASE page_id % 8 WHEN 0 THEN 'GoDaddy LLC' WHEN 1 THEN 'Privacy Proxy' WHEN 2 THEN '' WHEN 3 THEN 'Gandi WhoisGuard' END", "whois_country": "CASE WHEN page_id % 2 = 0 THEN 'NP' END",
    "whois_dnssec": "CASE page_id % 4 WHEN 0 THEN 'Unsigned' WHEN 1 THEN 'signedDelegation' END", "vt_success": "page_id % 5 < 4", "vt_positives": "CAST(page_id % 30 AS INT)", "vt_total": "CASE WHEN page_id % 17 > 0 THEN 70 ELSE 0 END",
    "ssl_success": "page_id % 6 > 0", "ssl_has": "CASE WHEN page_id % 10 > 0 THEN page_id % 10 < 9 END", "ssl_status": "CASE page_id % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'VALID' WHEN 2 THEN 'INVALID' END", "ssl_expired": "page_id % 8 = 1",
    "ssl_self_signed": "page_id % 12 = 1", "ssl_days_left": "CASE WHEN page_id % 4 > 0 THEN CAST(page_id % 60 - 10 AS INT) END", "ssl_hsts": "page_id % 3 = 1", "dns_success": "page_id % 7 > 0", "dns_spf": "page_id % 2 = 1", "dns_dmarc": "page_id % 3 = 2",
    "dns_records": "CAST(page_id % 6 AS INT)", "asn_org": "CASE WHEN page_id % 9 = 4 THEN 'CLOUDFLARENET' END",
}
TOLD = "CASE page_id % 6 WHEN 0 THEN 'age: 7 years, SPF ok, DMARC ok, SSL valid' WHEN 1 THEN 'spf' WHEN 2 THEN 'page is old' WHEN 3 THEN '' WHEN 4 THEN 'valid ssl dmarc' END"


def d20_hybrid_threat_score(spark, d):
    rows = _urls(spark, d).select("page_id", "url", *(F.expr(x).alias(n) for n, x in MADE.items()))
    return op.hybrid_threat_score(rows.withColumns({c: F.col(c).cast("double") for c in ("ml", "rule")})).select("page_id", "intel", "trust", "risk_score", "risk_level")


def d21_weighted_vote(spark, d):
    p = _urls(spark, d)
    signals = p.select("page_id", (F.col("page_id") % 100).cast("double").alias("a"), F.when(F.col("page_id") % 3 > 0, (F.col("page_id") % 70).cast("double")).alias("b"), F.when(F.col("page_id") % 5 == 0, 90.0).alias("c"))
    return op.weighted_vote(signals, {"a": 0.5, "b": 0.3, "c": 0.2})


def _reputation(spark, d):
    base = op.match_blocklist(_urls(spark, d), _urls(spark, d).where(F.col("url").contains("utm_source"))).select("page_id", "url", "exact")
    risk = op.domain_risk(_urls(spark, d)).select("page_id", "risk_points")
    cloud = op.cloud_context(_urls(spark, d)).select("page_id", "points")
    return op.reputation(base.join(risk, "page_id").join(cloud, "page_id"))


def d22_reputation(spark, d):
    return _reputation(spark, d)


def d22_reputation_with_intel(spark, d):
    base = op.match_blocklist(_urls(spark, d), _urls(spark, d).where(F.col("url").contains("utm_source"))).select("page_id", "url", F.when(F.col("page_id") % 4 > 0, F.col("exact")).alias("exact"))
    points = base.withColumns({"risk_points": F.when(F.col("page_id") % 4 > 1, F.col("page_id") % 80), "points": F.when(F.col("page_id") % 4 > 1, F.col("page_id") % 50)})
    return op.reputation(points.withColumn("adjustment", op.intel_adjustment(F.expr(TOLD)))).select("page_id", "adjustment", "reputation", "level")


def d23_indicator_rows(spark, d):
    return op.indicator_rows(_reputation(spark, d))


def d24_explain(spark, d):
    return op.explain(op.url_features(_urls(spark, d)))


def c14_classify_ioc(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9@.+:_/-]+"))).alias("value"))
    found = docs.where(F.length("value") > 3).withColumn("kind", op.classify_ioc(F.col("value")))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


def c15_encode_urls(spark, d):
    return op.encode_urls(_urls(spark, d)).select("page_id", F.array_join(F.transform("char_ids", lambda x: x.cast("string")), ",").alias("char_ids"))


def c15_subword_vocabulary(spark, d):
    return op.subword_vocabulary(_urls(spark, d), 300)


def c15_encode_subwords(spark, d):
    u = _urls(spark, d)
    return op.encode_subwords(u, op.subword_vocabulary(u, 300), 24).select("page_id", F.array_join(F.transform("token_ids", lambda x: x.cast("string")), ",").alias("token_ids"))


QUERIES = {k: f for k, f in globals().items() if k[0] in "dc" and k[1].isdigit()} | {f"d{i}_features_{n}": _family(n) for i, n in ((4, "length"), (5, "character"), (6, "entropy"), (7, "structural"), (8, "lexical"), (10, "security"), (11, "tld"))}

_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
PARTS = rf"""p0 AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:(\d+)', 1) AS port, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages),
p1 AS (SELECT *, regexp_matches(host, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') AS is_ip, string_split(host, '.') AS labels FROM p0),
p2 AS (SELECT *, CASE WHEN is_ip OR len(labels) < 2 THEN '' WHEN len(labels) > 2 AND labels[-2] || '.' || labels[-1] IN {_in(W.TWO_LABEL_SUFFIXES)} THEN labels[-2] || '.' || labels[-1] ELSE labels[-1] END AS suffix FROM p1),
p3 AS (SELECT *, len(labels) - len(string_split(suffix, '.')) AS n FROM p2),
p AS (
  SELECT *, CASE WHEN suffix = '' THEN host ELSE labels[n] END AS domain, CASE WHEN suffix = '' THEN '' ELSE array_to_string(labels[1:greatest(n - 1, 0)], '.') END AS subdomain,
    CASE WHEN suffix = '' THEN host ELSE labels[n] || '.' || suffix END AS registered_domain, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments,
    list_filter(string_split(query, '&'), lambda x: x <> '') AS params, list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda x: x <> '') AS tokens FROM p3),
q AS (SELECT *, CASE WHEN contains(coalesce(segments[-1], ''), '.') THEN segments[-1] ELSE '' END AS filename, regexp_extract(coalesce(segments[-1], ''), '\.([A-Za-z0-9]+)$', 1) AS extension FROM p)"""
_n = lambda pat: f"len(regexp_extract_all(url, '{pat}'))::INTEGER"
_hits = lambda t, ws: "(" + " + ".join(f"contains({t}, '{w}')::INTEGER" for w in ws) + ")"
BRANDS = [b for b in W.OFFICIAL_DOMAINS if b not in W.NOT_IMPERSONATED]
OFFICIAL = _in(x for v in W.OFFICIAL_DOMAINS.values() for x in v)
SQL_FAMILIES = {
    "length": {**{f"{k}_length": f"length({c})::INTEGER" for k, c in (("url", "url"), ("hostname", "host"), ("domain", "domain"), ("path", "path"), ("query", "query"), ("subdomain", "subdomain"), ("filename", "filename"), ("fragment", "fragment"), ("tld", "suffix"), ("scheme", "scheme"))},
               "max_path_segment_length": "coalesce(list_max(list_transform(segments, lambda x: length(x))), 0)::INTEGER", "avg_path_segment_length": "round(coalesce(list_sum(list_transform(segments, lambda x: length(x)))::DOUBLE / nullif(len(segments), 0), 0), 4)"},
    "character": {"digit_count": _n("[0-9]"), "letter_count": _n("[A-Za-z]"), "uppercase_count": _n("[A-Z]"), "lowercase_count": _n("[a-z]"), "special_char_count": _n(r"[^A-Za-z0-9\s]"), **{f"{k}_count": _n(p) for k, p in (
        ("dot", r"\."), ("slash", "/"), ("hyphen", "-"), ("underscore", "_"), ("at_symbol", "@"), ("tilde", "~"), ("question_mark", r"\?"), ("ampersand", "&"), ("equals_sign", "="), ("percent", "%"))}},
    "structural": {"subdomain_count": "CASE WHEN subdomain = '' THEN 0 ELSE len(string_split(subdomain, '.')) END::INTEGER", "directory_depth": "greatest(len(segments) - CASE WHEN filename <> '' THEN 1 ELSE 0 END, 0)::INTEGER", "has_port": "(port <> '')::INTEGER", "has_query": "(query <> '')::INTEGER",
                   "has_fragment": "(fragment <> '')::INTEGER", "has_at_symbol": "contains(url, '@')::INTEGER", "has_double_slash": "contains(path, '//')::INTEGER", "query_param_count": "len(params)::INTEGER", "has_file_extension": "(extension <> '')::INTEGER", "path_segment_count": "len(segments)::INTEGER", "has_www": "starts_with(host, 'www.')::INTEGER"},
    "lexical": {"url_token_count": "len(tokens)::INTEGER", "avg_token_length": "round(coalesce(list_sum(list_transform(tokens, lambda x: length(x)))::DOUBLE / nullif(len(tokens), 0), 0), 4)", "max_token_length": "coalesce(list_max(list_transform(tokens, lambda x: length(x))), 0)::INTEGER",
                "suspicious_keyword_count": _hits("lower(url)", W.LURE_WORDS), "contains_suspicious_keyword": f"({_hits('lower(url)', W.LURE_WORDS)} > 0)::INTEGER", "longest_word_length": "coalesce(list_max(list_transform(tokens, lambda x: length(x))), 0)::INTEGER",
                "digit_to_letter_ratio": f"round(coalesce({_n('[0-9]')}::DOUBLE / nullif({_n('[A-Za-z]')}, 0), 0), 4)"},
    "security": {"is_https": "(scheme = 'https')::INTEGER", "is_ip_address": "is_ip::INTEGER", "is_punycode": "contains(host, 'xn--')::INTEGER", "has_homograph_chars": r"regexp_matches(url, '[^\x00-\x7f]')::INTEGER", "homograph_char_count": _n(r"[^\x00-\x7f]"),
                 "is_url_shortener": f"(registered_domain IN {_in(W.SHORTENERS)})::INTEGER", "is_data_uri": "starts_with(lower(url), 'data:')::INTEGER", "has_javascript": "contains(lower(url), 'javascript:')::INTEGER"},
    "tld": {"is_suspicious_tld": f"(suffix IN {_in(W.RISKY_TLDS)})::INTEGER", "tld_risk_score": f"CASE WHEN suffix IN {_in(W.RISKY_TLDS)} THEN 0.8 WHEN length(string_split(suffix, '.')[-1]) = 2 THEN 0.3 WHEN suffix IN ('com','org','net','edu','gov') THEN 0.1 ELSE 0.4 END::DOUBLE",
            "is_cctld": "(length(string_split(suffix, '.')[-1]) = 2)::INTEGER", "is_new_gtld": "(length(string_split(suffix, '.')[-1]) <> 2 AND suffix NOT IN ('com','org','net','edu','gov','mil','int',''))::INTEGER"},
    "brand": {**{f"brand_in_{k}": f"list_contains(held, '{k}')::INTEGER" for k in ("domain", "subdomain", "path")}, "min_brand_distance": "near",
              "brand_similarity_score": "CASE WHEN official THEN 0 ELSE alike END::DOUBLE", "is_typosquat": "(near BETWEEN 1 AND 2 AND NOT list_contains(held, 'domain') AND NOT official)::INTEGER"},
}
WORDS = "regexp_replace(host, '[^a-z0-9]+', '', 'g')"
EVERY = f"({WORDS} || regexp_replace(lower(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END), '[^a-z0-9]+', '', 'g'))"
_word = lambda ws: f"CASE WHEN {_hits(WORDS, ws)} > 0 THEN 20 WHEN {_hits(EVERY, ws)} > 0 THEN 10 ELSE 0 END"
SCORE = rf"""s AS (SELECT page_id, url, host, CASE WHEN contains(host, '.') THEN CASE WHEN host IN {OFFICIAL} OR registered_domain IN {OFFICIAL} THEN 0 ELSE least(100, CASE WHEN {_hits(WORDS, BRANDS)} > 0 THEN 55 ELSE 0 END
  + CASE WHEN is_ip THEN 40 WHEN labels[-1] IN {_in(W.RISKY_TLDS)} THEN 25 ELSE 0 END + CASE WHEN registered_domain IN {_in(W.SHORTENERS)} THEN 35 ELSE 0 END + CASE WHEN contains(host, 'xn--') THEN 30 ELSE 0 END + CASE WHEN len(labels) >= 5 THEN 15 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(host, '-')) >= 3 THEN 15 ELSE 0 END + CASE WHEN length(host) > 40 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(labels[1], '^[0-9a-f]{{8,}}$') THEN 10 ELSE 0 END + {_word(W.LURE_WORDS)} + {_word(W.REWARD_WORDS)}
  + CASE WHEN {_hits(EVERY, W.LURE_WORDS)} > 0 AND {_hits(EVERY, W.REWARD_WORDS)} > 0 THEN 10 ELSE 0 END) END END::INTEGER AS risk_score FROM q)"""
_has = lambda b, text: f"contains({text}, '{b}')" if len(b) > 4 else f"regexp_matches({text}, '(^|[^\\p{{L}}]){b}([^\\p{{L}}]|$)')"
PLACES = {"domain": "lower(registered_domain)", "subdomain": "lower(subdomain)", "path": "lower(path)", "filename": "lower(filename)", "query": "lower(query)"}
BRANDED = f"""b0 AS (SELECT *, coalesce({', '.join(f"CASE WHEN registered_domain IN {_in(W.OFFICIAL_DOMAINS[b])} OR {' OR '.join(_has(b, t) for t in PLACES.values())} THEN '{b}' END" for b in BRANDS)}) AS brand,
    list_min([{', '.join(f"(levenshtein(lower(domain), '{b}') * 1000 + {i})" for i, b in enumerate(BRANDS))}]) AS packed FROM q),
b1 AS (SELECT *, coalesce({' OR '.join(f"(brand = '{b}' AND registered_domain IN {_in(W.OFFICIAL_DOMAINS[b])})" for b in BRANDS)}, false) AS official, (packed // 1000)::INTEGER AS near,
    {_in(BRANDS).replace('(', '[').replace(')', ']')}[packed % 1000 + 1] AS closest FROM b0),
b2 AS (SELECT *, CASE WHEN official OR brand IS NULL THEN []::VARCHAR[] ELSE list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'(brand = {chr(39)}{b}{chr(39)} AND {_has(b, t)})' for b in BRANDS)} THEN '{k}' END" for k, t in PLACES.items())}], lambda x: x IS NOT NULL) END AS held,
    round(1 - near / greatest(length(domain), length(closest), 1)::DOUBLE, 4) AS alike FROM b1)"""
_h = lambda text: (f"round(coalesce(list_sum(list_transform(list_distinct(list_filter(string_split({text}, ''), lambda x: x <> '')), lambda c: -(len(list_filter(string_split({text}, ''), lambda y: y = c))::DOUBLE / length({text}))"  # noqa: E731
                   f" * log2(len(list_filter(string_split({text}, ''), lambda y: y = c))::DOUBLE / length({text})))), 0), 6)")
SQL_FAMILIES["entropy"] = {f"{k}_entropy": _h(c) for k, c in (("url", "url"), ("hostname", "host"), ("domain", "domain"), ("path", "path"), ("subdomain", "subdomain"), ("query", "query"))} | {
    "digit_ratio": f"round({_n('[0-9]')} / greatest(length(url), 1)::DOUBLE, 4)",
    "vowel_consonant_ratio": "round(coalesce(len(regexp_extract_all(host, '[aeiou]'))::DOUBLE / nullif(len(regexp_extract_all(host, '[b-df-hj-np-tv-z]')), 0), 0), 4)"}
FEATURES = f"WITH {PARTS}, {BRANDED}, f AS (SELECT page_id, url, host, " + ", ".join(f"{v} AS {k}" for n in ("length", "character", "entropy", "structural", "lexical", "brand", "security", "tld") for k, v in SQL_FAMILIES[n].items()) + " FROM b2)"
_any = lambda text, ws: "(" + " OR ".join(f"contains({text}, '{w}')" for w in ws) + ")"
FIRES = {"is_ip_based": "is_ip_address = 1", "is_url_shortener": f"is_url_shortener = 1 OR {_any('host', W.SHORTENERS)}", "is_punycode": "is_punycode = 1", "has_homograph_chars": "has_homograph_chars = 1",
         "suspicious_tld": "is_suspicious_tld = 1 OR tld_risk_score >= 0.7", "brand_in_subdomain": "brand_in_subdomain = 1", "brand_in_domain": "brand_in_domain = 1", "typosquatting": "is_typosquat = 1",
         "excessive_subdomains": "subdomain_count >= 3", "suspicious_keywords": "suspicious_keyword_count >= 2", "suspicious_keyword_single": "suspicious_keyword_count = 1", "long_url": "url_length >= 75",
         "no_https": "is_https = 0 AND NOT (host IN ('localhost', '127.0.0.1', '') OR starts_with(host, '192.168.'))", "double_slash_in_path": "has_double_slash = 1", "at_symbol_in_url": "has_at_symbol = 1",
         "data_or_js_uri": "is_data_uri = 1 OR has_javascript = 1 OR regexp_matches(lower(url), '^(data|javascript):')"}
_severity = lambda k: "CASE WHEN suspicious_keyword_count < 4 THEN 'medium' ELSE 'high' END" if k == "suspicious_keywords" else f"'{W.RULES[k][0]}'"
_share = lambda k: "least(0.55, 0.15::DOUBLE * suspicious_keyword_count)" if k == "suspicious_keywords" else f"{W.RULES[k][1]}::DOUBLE"
_listed = lambda make: "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {make(k)} END" for k, t in FIRES.items()) + "], lambda x: x IS NOT NULL)"
RISK = f"""r0 AS (SELECT page_id, url, host, CASE WHEN len(labels) >= 2 THEN labels[-2] ELSE labels[1] END AS core, CASE WHEN len(labels) >= 2 THEN labels[-1] ELSE '' END AS ending, greatest(len(labels) - 2, 0)::INTEGER AS depth FROM q),
r1 AS (SELECT *, replace(core, '-', '') AS flat, round({_h('core')}, 2) AS core_entropy FROM r0),
r2 AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (core_entropy - 2.6) / 1.6)), 2) AS randomness,
  CASE {' '.join(f"WHEN flat = '{b}' OR core = '{b}' THEN '' WHEN contains(flat, '{b}') THEN 'in:{b}' WHEN levenshtein(flat, '{b}') <= 1 THEN 'by:{b}'" for b in W.PROTECTED_BRANDS)} ELSE '' END AS brand FROM r1),
risk AS (SELECT page_id, url, host, depth, core_entropy, randomness, CASE WHEN starts_with(brand, 'in:') THEN brand[4:] ELSE '' END AS impersonated_brand, CASE WHEN starts_with(brand, 'by:') THEN brand[4:] ELSE '' END AS typosquat_of,
  (CASE WHEN depth >= 3 THEN 10 ELSE 0 END + CASE WHEN randomness >= 0.6 AND length(core) >= 8 THEN 15 ELSE 0 END + CASE WHEN ending IN {_in(W.DOMAIN_RISKY_TLDS)} THEN 15 ELSE 0 END
   + CASE WHEN regexp_matches(host, '[^\\x00-\\x7f]') THEN 20 ELSE 0 END + CASE WHEN brand <> '' THEN 30 ELSE 0 END)::INTEGER AS risk_points FROM r2)"""
CLOUD = f"""c AS (SELECT page_id, url, CASE {' '.join(f"WHEN {' OR '.join(f"ends_with(host, '{x}')" for x in xs)} THEN '{k}'" for k, xs in W.CLOUD_PROVIDERS.items())} END AS provider,
  {_any('lower(url)', W.CLOUD_LOGIN_WORDS)}::INTEGER + {_any('lower(url)', W.CLOUD_MONEY_WORDS)}::INTEGER + {_any('lower(url)', W.CLOUD_BRAND_WORDS)}::INTEGER + (impersonated_brand <> '')::INTEGER + (typosquat_of <> '')::INTEGER + (depth >= 3)::INTEGER AS n FROM risk)"""
REASONS = ["CASE WHEN is_ip_address = 1 THEN 'uses a raw IP address' END", "CASE WHEN is_https = 0 THEN 'is not encrypted' END", "CASE WHEN suspicious_keyword_count > 0 THEN 'holds ' || suspicious_keyword_count || ' suspicious words' END",
           "CASE WHEN subdomain_count >= 2 THEN 'has ' || subdomain_count || ' subdomain levels' END", "CASE WHEN is_suspicious_tld = 1 THEN 'has a risky ending' END", "CASE WHEN url_length > 75 THEN 'is ' || url_length || ' characters long' END"]
_tokens = ", ".join(f"('{b}', {i}, '{w}', {k})" for i, (b, ws) in enumerate(B.BRAND_TOKENS.items()) for k, w in enumerate(ws))
_homes = ", ".join(f"('{d}', '{b}')" for b, ds in B.BRAND_DOMAINS.items() for d in ds)
_ends = "CASE " + " ".join(f"WHEN registered_domain = '{e}' OR ends_with(registered_domain, '.{e}') THEN '{b}'" for e, b in B.BRAND_ENDINGS.items()) + " END"
_providers = "CASE " + " ".join(f"WHEN {' OR '.join(f"ends_with(host, '{x}')" for x in xs)} THEN '{k}'" for k, xs in W.CLOUD_PROVIDERS.items()) + " END"
_read = "lower(label)"
for _a, _b in B.READ_PAIRS:
    _read = f"replace({_read}, '{_a}', '{_b}')"
_read = f"translate({_read}, '{B.READ_SINGLE[0] + B.READ_SINGLE[2]}', '{B.READ_SINGLE[1] + B.READ_SINGLE[3]}')"
_w = B.BRAND_WEIGHTS
# The given hosts are ASCII: the SQL has no homoglyphs. Tests hold these by hand.
BRANDS_SQL = PARTS.replace("FROM pages", f"FROM (SELECT page_id, {SPOOFED} AS url FROM pages)") + f""", t(brand, turn, word, pos) AS (VALUES {_tokens}), home(domain, brand) AS (VALUES {_homes}),
v0 AS (SELECT q.page_id, q.url, host, lower(path) AS path, lower(query) AS query, q.subdomain, coalesce(home.brand, {_ends}) AS owner, {_providers} AS cloud,
  flatten(list_transform([q.domain] || list_filter(string_split(q.subdomain, '.'), lambda x: x <> '' AND x <> 'www'), lambda x: [x] || string_split(x, '-'))) AS every FROM q LEFT JOIN home ON home.domain = q.registered_domain),
v AS (SELECT *, list_filter(every, lambda x, i: length(x) >= 3 AND list_position(every, x) = i) AS labels FROM v0),
named AS (SELECT page_id, brand, min(turn) AS turn, bool_or(contains(host, word)) AS deep FROM v JOIN t ON length(word) >= 4 AND contains(host || chr(10) || path || chr(10) || query, word) GROUP BY ALL),
conflict AS (SELECT v.page_id, n.brand, n.turn, n.deep FROM v JOIN named n USING (page_id) WHERE owner IS NULL OR n.brand <> owner),
mode AS (SELECT v.*, CASE WHEN owner IS NOT NULL THEN 'home' WHEN cloud IS NOT NULL AND page_id IN (SELECT page_id FROM conflict) THEN 'cloud' ELSE 'plain' END AS mode FROM v),
lab AS (SELECT page_id, unnest(labels) AS label, generate_subscripts(labels, 1) AS place FROM v),
form AS (SELECT *, {_read} AS r FROM (SELECT DISTINCT label FROM lab)),
form2 AS (SELECT *, array_to_string(list_filter(string_split(r, ''), lambda c, i: i = 1 OR c <> string_split(r, '')[i - 1]), '') AS once FROM form),
dist AS (SELECT label, brand, turn, pos, damerau_levenshtein(label, word) AS raw, least(CASE WHEN r <> label THEN damerau_levenshtein(r, word) ELSE 9 END, CASE WHEN once <> label THEN damerau_levenshtein(once, word) ELSE 9 END) AS turned
  FROM form2 JOIN t ON length(word) >= 5 WHERE NOT EXISTS (FROM t AS own WHERE own.brand = t.brand AND own.word = form2.label)),
near AS (SELECT label, brand, turn, least(raw, turned) AS distance FROM dist WHERE raw BETWEEN 1 AND 2 OR turned <= 2 QUALIFY row_number() OVER (PARTITION BY label, brand ORDER BY pos) = 1),
typo AS (SELECT m.page_id, near.brand, near.turn, near.label, distance, place FROM mode m JOIN lab USING (page_id) JOIN near USING (label) WHERE mode <> 'home'),
spoken AS (SELECT page_id, brand, bool_or(deep) AS deep, min(first) AS first FROM (SELECT n.page_id, n.brand, n.deep, n.turn AS first FROM named n JOIN mode USING (page_id) WHERE mode <> 'home' UNION ALL SELECT page_id, brand, false, 1000 + 1000 * place + turn FROM typo) GROUP BY ALL),
affix AS (SELECT s.page_id, s.brand, arg_min(word, pos) AS word FROM spoken s JOIN mode m USING (page_id) JOIN t ON t.brand = s.brand
  WHERE mode = 'plain' AND contains(array_to_string(labels, '-'), word) AND len(list_filter([{', '.join(f"'{a}'" for a in B.AFFIXES)}], lambda a: a <> word AND contains(array_to_string(labels, '-'), a))) > 0 GROUP BY ALL),
base AS (
  SELECT page_id, 'brand_conflict' AS finding, brand, NULL AS label, CASE WHEN deep THEN 'high' ELSE 'medium' END AS severity, CASE WHEN deep THEN {_w['brand_conflict'] + _w['brand_token']} ELSE {_w['brand_conflict']} END AS score FROM conflict JOIN mode USING (page_id) WHERE mode <> 'plain'
  UNION ALL SELECT page_id, 'typosquatting', brand, label, CASE WHEN distance = 1 THEN 'critical' ELSE 'high' END, {_w['typosquatting']} FROM typo
  UNION ALL SELECT s.page_id, CASE WHEN d THEN 'official_domain_mismatch' ELSE 'brand_token_reference' END, brand, NULL, CASE WHEN d THEN 'high' ELSE 'info' END, CASE WHEN d THEN {_w['official_domain_mismatch']} ELSE {_w['brand_token']} END
    FROM (SELECT *, deep OR page_id IN (SELECT page_id FROM typo) AS d FROM spoken) s JOIN mode USING (page_id) WHERE mode = 'plain'
  UNION ALL SELECT page_id, 'misleading_affix', brand, word, 'high', {_w['misleading_affix']} FROM affix),
found AS (FROM base UNION ALL SELECT m.page_id, 'cloud_hosted_impersonation', (SELECT arg_min(brand, first) FROM spoken s WHERE s.page_id = m.page_id), cloud, 'high', {_w['cloud_hosted_impersonation']}
  FROM mode m WHERE mode <> 'home' AND cloud IS NOT NULL AND len(list_filter([{', '.join(f"'{a}'" for a in B.CREDENTIAL_WORDS)}], lambda w: contains(subdomain || ' ' || path || ' ' || query, w))) > 0
    AND m.page_id IN (SELECT page_id FROM base WHERE finding IN ('official_domain_mismatch', 'typosquatting', 'brand_conflict')))"""
D19_SQL = f"WITH {BRANDS_SQL} SELECT page_id, url, finding, brand, label, severity, score::DOUBLE AS score FROM found JOIN v USING (page_id)"
D19_RISK_SQL = f"""WITH {BRANDS_SQL}, s AS (SELECT page_id, sum(score) AS base, bool_or(severity IN ('high', 'critical')) AS severe FROM found GROUP BY ALL),
z AS (SELECT v.page_id, v.url, v.owner AS official_brand, round(least(1.0, coalesce(base, 0) + CASE WHEN severe THEN CASE WHEN page_id % 3 > 0 AND page_id % 400 < 180 THEN 0.1 ELSE 0 END + CASE WHEN page_id % 4 = 0 THEN 0.05 ELSE 0 END
  + CASE WHEN page_id % 7 = 0 THEN 0.05 ELSE 0 END + CASE WHEN page_id % 4 >= 2 THEN 0.1 ELSE 0 END ELSE 0 END)::DOUBLE, 4) AS brand_score FROM v LEFT JOIN s USING (page_id))
SELECT page_id, url, official_brand, coalesce((SELECT string_agg(brand, ',' ORDER BY brand) FROM (SELECT brand FROM spoken WHERE spoken.page_id = z.page_id UNION SELECT brand FROM conflict JOIN mode USING (page_id) WHERE conflict.page_id = z.page_id AND mode = 'home' UNION SELECT official_brand WHERE official_brand IS NOT NULL)), '') AS brands,
  brand_score, CASE WHEN brand_score >= 0.6 THEN 'high' WHEN brand_score >= 0.3 THEN 'medium' WHEN brand_score > 0 THEN 'low' ELSE 'none' END AS brand_level FROM z"""

VOCAB = r"""tok AS (SELECT page_id, regexp_extract_all(url, '://|[/?&=#._@:-]|[^/?&=#._@:-]+') AS t FROM pages), cnt AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM tok) GROUP BY token),
voc AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 1)::INTEGER AS id, n FROM cnt QUALIFY id <= 301)"""
_letters = op.LETTERS.replace("'", "''")
C15 = {
    "c15_encode_urls": f"WITH c AS (SELECT page_id, string_split(trim(url), '')[1:256] AS c FROM pages) SELECT page_id, array_to_string(list_transform(list_resize(list_transform(c, lambda x: CASE WHEN instr('{_letters}', x) > 0 THEN instr('{_letters}', x) + 1 ELSE 1 END), 256, 0), lambda x: x::VARCHAR), ',') AS char_ids FROM c",
    "c15_subword_vocabulary": f"WITH {VOCAB} SELECT * FROM voc",
    "c15_encode_subwords": f"WITH {VOCAB}, e AS (SELECT page_id, unnest(t[1:24]) AS token, generate_subscripts(t[1:24], 1) AS place FROM tok) SELECT page_id, array_to_string(list_transform(list_resize(list(coalesce(id, 1) ORDER BY place), 24, 0), lambda x: x::VARCHAR), ',') AS token_ids FROM e LEFT JOIN voc USING (token) GROUP BY page_id",
}

_b = list(W.OFFICIAL_DOMAINS)
_own = lambda b: f"domain IN ('{b}.com', '{b}.net', '{b}.org', 'www.{b}.com')"
_any = lambda c, ws: "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in ws) + ")"
HYBRID_SQL = f"""WITH r AS (SELECT page_id, url, {', '.join(f'{x} AS {n}' for n, x in MADE.items())} FROM pages),
b AS (SELECT *, {' + '.join(f"(contains(domain, '{b}') AND NOT {_own(b)})::INT" for b in _b)} AS inside, {' + '.join(f"(contains(lower(url), '{b}') AND NOT contains(domain, '{b}'))::INT" for b in _b)} AS beside, ltrim(lower(coalesce(tld, '')), '.') AS e FROM r),
i AS (SELECT *, CASE WHEN age_days IS NULL THEN 0.5 WHEN age_days <= 7 THEN 1 WHEN age_days <= 30 THEN 0.85 WHEN age_days <= 90 THEN 0.6 WHEN age_days <= 180 THEN 0.4 WHEN age_days <= 365 THEN 0.2 ELSE 0 END::DOUBLE AS s_age,
  CASE WHEN NOT whois_success THEN 0.5 ELSE (CASE WHEN coalesce(whois_registrar, '') = '' THEN 1 ELSE 0 END + CASE WHEN whois_country IS NULL THEN 0.6 ELSE 0 END + CASE WHEN {_any('whois_dnssec', ('unsigned',))} THEN 0.3 ELSE 0 END + CASE WHEN {_any('whois_registrar', op.PRIVATE_REGISTRARS)} THEN 0.5 ELSE 0 END)::DOUBLE / 4 END AS s_whois,
  CASE WHEN NOT vt_success OR vt_total <= 0 THEN 0 WHEN vt_positives / vt_total >= 0.3 THEN 1 WHEN vt_positives / vt_total >= 0.15 THEN 0.85 WHEN vt_positives / vt_total >= 0.05 THEN 0.6 WHEN vt_positives >= 1 THEN 0.35 ELSE 0 END::DOUBLE AS s_vt,
  CASE WHEN NOT ssl_success OR coalesce(ssl_status, '') = 'UNKNOWN' THEN 0.5 WHEN NOT coalesce(ssl_has, false) THEN 1 ELSE least(1, (CASE WHEN ssl_expired THEN 1 ELSE 0 END + CASE WHEN ssl_self_signed THEN 0.9 ELSE 0 END + CASE WHEN ssl_days_left < 0 THEN 1 WHEN ssl_days_left <= 7 THEN 0.7 WHEN ssl_days_left <= 30 THEN 0.4 ELSE 0 END)::DOUBLE / 3) END AS s_ssl,
  CASE WHEN NOT dns_success THEN 0.5 ELSE (CASE WHEN dns_spf THEN 0 ELSE 0.7 END + CASE WHEN dns_dmarc THEN 0 ELSE 0.6 END + CASE WHEN dns_records = 0 THEN 1 WHEN dns_records <= 2 THEN 0.5 ELSE 0 END)::DOUBLE / 3 END AS s_dns,
  CASE WHEN e = '' THEN 0.3 WHEN e IN {_in(W.SUSPICIOUS_TLDS)} THEN 1 WHEN e IN {_in(op.PLAIN_TLDS)} THEN 0 WHEN length(e) = 2 THEN 0.2 ELSE 0.3 END::DOUBLE AS s_tld,
  CASE WHEN (CASE WHEN inside > 0 THEN inside ELSE beside END) >= 2 THEN 1 WHEN inside + beside > 0 AND (CASE WHEN inside > 0 THEN inside ELSE beside END) = 1 THEN 0.8 ELSE 0 END::DOUBLE AS s_brand,
  greatest(0, least(100, 50 + CASE WHEN official THEN 30 ELSE 0 END + CASE WHEN ssl_status = 'VALID' THEN 15 ELSE 0 END + CASE WHEN dns_spf THEN 10 ELSE 0 END + CASE WHEN dns_dmarc THEN 10 ELSE 0 END + CASE WHEN whois_dnssec IS NOT NULL AND NOT {_any('whois_dnssec', ('unsigned',))} THEN 10 ELSE 0 END
    + CASE WHEN ssl_hsts THEN 5 ELSE 0 END + CASE WHEN age_days > 1825 THEN 15 WHEN age_days > 365 THEN 10 ELSE 0 END + CASE WHEN {_any('asn_org', op.TRUSTED_NETWORKS)} THEN 5 ELSE 0 END + CASE WHEN {_any('whois_registrar', op.TRUSTED_REGISTRARS)} THEN 5 ELSE 0 END + CASE WHEN vt_success AND vt_positives = 0 THEN 10 ELSE 0 END
    - CASE WHEN brand_detected IS NOT NULL AND NOT official THEN 35 ELSE 0 END - CASE WHEN is_typosquatting = 1 THEN 30 ELSE 0 END - CASE WHEN url_entropy > 4.5 OR domain_entropy > 4.0 THEN 15 ELSE 0 END - CASE WHEN age_days < 90 THEN 25 ELSE 0 END - CASE WHEN is_suspicious_tld = 1 THEN 15 ELSE 0 END
    - CASE WHEN is_url_shortener = 1 THEN 15 ELSE 0 END - CASE WHEN subdomain_count >= 3 THEN 10 ELSE 0 END)) AS trust FROM b),
w AS (SELECT *, round((s_age * 0.1::DOUBLE + s_whois * 0.1::DOUBLE + s_vt * 0.15::DOUBLE + s_ssl * 0.08::DOUBLE + s_dns * 0.07::DOUBLE + s_tld * 0.05::DOUBLE + s_brand * 0.1::DOUBLE) / 0.65::DOUBLE, 6) AS intel FROM i),
z AS (SELECT *, round_even(round((ml::DOUBLE * 0.35::DOUBLE + rule::DOUBLE * 0.3::DOUBLE + intel * 0.2::DOUBLE + (1 - trust / 100.0::DOUBLE) * 0.15::DOUBLE) * 100, 6), 0)::INTEGER AS raw FROM w),
y AS (SELECT *, CASE WHEN official THEN least(raw, 20) ELSE raw END AS risk_score FROM z)
SELECT page_id, intel, trust, risk_score, CASE WHEN risk_score >= 80 THEN 'Critical' WHEN risk_score >= 60 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' WHEN risk_score >= 20 THEN 'Low' ELSE 'Safe' END AS risk_level FROM y"""
REPUTE_SQL = f"""WITH t AS (SELECT page_id, lower({TOLD}) AS f FROM pages), f AS (SELECT url FROM pages WHERE contains(url, 'utm_source')),
a AS (SELECT page_id, CASE WHEN coalesce(f, '') <> '' THEN least(15, CASE WHEN contains(f, 'age') AND (contains(f, 'year') OR contains(f, 'old')) THEN 5 ELSE 0 END + CASE WHEN contains(f, 'spf') THEN 3 ELSE 0 END + CASE WHEN contains(f, 'dmarc') THEN 3 ELSE 0 END + CASE WHEN contains(f, 'valid') AND contains(f, 'ssl') THEN 4 ELSE 0 END) END AS adjustment FROM t),
x AS (SELECT p.page_id, adjustment, CASE WHEN p.page_id % 4 > 0 THEN (SELECT count(*) FROM f WHERE f.url = p.url) END AS exact, CASE WHEN p.page_id % 4 > 1 THEN p.page_id % 80 END AS risk, CASE WHEN p.page_id % 4 > 1 THEN p.page_id % 50 END AS cloud FROM pages p JOIN a USING (page_id)),
y AS (SELECT page_id, adjustment, CASE WHEN exact IS NOT NULL OR risk IS NOT NULL OR cloud IS NOT NULL OR adjustment IS NOT NULL THEN greatest(0, least(100, 100 - least(70, 45 * coalesce(exact, 0)) - least(60, coalesce(risk, 0)) - least(35, coalesce(cloud, 0)) + coalesce(adjustment, 0))) END AS reputation FROM x)
SELECT *, CASE WHEN reputation IS NULL THEN 'unknown' WHEN reputation >= 85 THEN 'trusted' WHEN reputation >= 60 THEN 'neutral' WHEN reputation >= 35 THEN 'suspicious' ELSE 'hostile' END AS level FROM y"""

ORACLES = C15 | {"d20_hybrid_threat_score": HYBRID_SQL, "d22_reputation_with_intel": REPUTE_SQL} | {
    "d6_features_entropy": f"WITH {PARTS} SELECT page_id, url, " + ", ".join(f"{v} AS {k}" for k, v in SQL_FAMILIES["entropy"].items()) + " FROM q",
    "d9_features_brand": f"WITH {PARTS}, {BRANDED} SELECT page_id, url, " + ", ".join(f"{v} AS {k}" for k, v in SQL_FAMILIES["brand"].items()) + """, brand AS brand_detected, official AS official_domain_match, closest AS closest_brand,
  CASE WHEN official THEN 'domain' ELSE coalesce(held[1], 'none') END AS brand_location, CASE WHEN brand IS NULL OR official THEN 0 ELSE alike END::DOUBLE AS brand_similarity FROM b2""",
    "d12_url_features": FEATURES + " SELECT * EXCLUDE (host) FROM f",
    "d13_rule_findings": FEATURES + f""" SELECT url, array_to_string({_listed(lambda k: f"'{k}'")}, ',') AS rules, array_to_string({_listed(_severity)}, ',') AS severities,
  round(least(1.0::DOUBLE, coalesce(list_sum({_listed(_share)}), 0)), 4) AS rule_score, list_contains({_listed(_severity)}, 'critical') AS definite FROM f""",
    "d17_domain_risk": f"WITH {PARTS}, {RISK} SELECT * FROM risk",
    "d18_cloud_context": f"WITH {PARTS.replace('FROM pages)', 'FROM (SELECT page_id, replace(url, ' + chr(39) + 'example.org' + chr(39) + ', ' + chr(39) + 'github.io' + chr(39) + ') AS url FROM pages))')}, {RISK}, {CLOUD}" + """
SELECT page_id, url, provider, CASE WHEN provider IS NULL THEN 0 ELSE n END::INTEGER AS signals, CASE WHEN provider IS NULL OR n = 0 THEN 0 ELSE least(35, 12 + 8 * (n - 1)) END::INTEGER AS points FROM c""",
    "d19_brand_findings": D19_SQL,
    "d19_brand_risk": D19_RISK_SQL,
    "d24_explain": FEATURES + f" SELECT url, array_to_string(list_filter([{', '.join(REASONS)}], lambda x: x IS NOT NULL), '; ') AS reasons FROM f",
    "d2_public_suffix": f"""WITH {PARTS}, rule(rule) AS (VALUES {', '.join(f"('{r}')" for r in SUFFIX_RULES)}), e AS (SELECT page_id, labels, unnest(range(1, len(labels) + 1)) AS n FROM q WHERE NOT is_ip AND len(labels) > 1),
k AS (SELECT page_id, n, array_to_string(labels[len(labels) - n + 1:], '.') AS ending, CASE WHEN n > 1 THEN '*.' || array_to_string(labels[len(labels) - n + 2:], '.') ELSE '*' END AS below FROM e),
h AS (SELECT page_id, max(CASE WHEN starts_with(rule, '!') THEN n - 1 END) AS ex, max(n) AS most FROM k JOIN rule ON rule IN (ending, below, '!' || ending) GROUP BY page_id),
z AS (SELECT q.page_id, host, labels, len(labels) - coalesce(ex, most, 1) AS rest, NOT is_ip AND len(labels) > 1 AND len(labels) > coalesce(ex, most, 1) AS named FROM q LEFT JOIN h USING (page_id))
SELECT page_id, host, CASE WHEN named THEN array_to_string(labels[rest + 1:], '.') ELSE '' END AS suffix, CASE WHEN named THEN labels[rest] ELSE host END AS domain, CASE WHEN named THEN array_to_string(labels[rest:], '.') ELSE host END AS registered_domain,
  CASE WHEN named THEN array_to_string(labels[1:rest - 1], '.') ELSE '' END AS subdomain FROM z""",
    "d2_url_parts": f"WITH {PARTS} SELECT page_id, scheme, host, port, path, query, fragment, suffix, domain, registered_domain, subdomain, extension FROM q",
    **{f"d{i}_features_{n}": f"WITH {PARTS} SELECT page_id, url, " + ", ".join(f"{v} AS {k}" for k, v in SQL_FAMILIES[n].items()) + " FROM q" for i, n in ((4, "length"), (5, "character"), (7, "structural"), (8, "lexical"), (10, "security"), (11, "tld"))},
    "d14_score_host": f"WITH {PARTS}, {SCORE} SELECT *, CASE WHEN risk_score >= 70 THEN 'malicious' WHEN risk_score >= 35 THEN 'suspicious' WHEN risk_score IS NOT NULL THEN 'benign' END AS verdict FROM s",
    "d15_lookup_indicators": f"""
WITH {PARTS}, f AS (SELECT DISTINCT url FROM pages WHERE contains(url, 'ref=')), h AS (SELECT DISTINCT host FROM q WHERE contains(url, '/fr/'))
SELECT page_id, q.url, q.host, CASE WHEN f.url IS NOT NULL THEN 'Phishing' WHEN h.host IS NOT NULL THEN 'clean' END AS verdict, f.url IS NOT NULL AS malicious FROM q LEFT JOIN f ON f.url = q.url LEFT JOIN h ON h.host = q.host""",
    "d21_weighted_vote": """
WITH s AS (SELECT page_id, (page_id % 100)::DOUBLE AS a, CASE WHEN page_id % 3 > 0 THEN (page_id % 70)::DOUBLE END AS b, CASE WHEN page_id % 5 = 0 THEN 90.0::DOUBLE END AS c FROM pages),
v AS (SELECT *, round((a * 0.5::DOUBLE + coalesce(b * 0.3::DOUBLE, 0) + coalesce(c * 0.2::DOUBLE, 0)) / (0.5::DOUBLE + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.2::DOUBLE END), 4) AS vote FROM s)
SELECT *, CASE WHEN vote <= 30 THEN 'benign' WHEN vote <= 60 THEN 'suspicious' ELSE 'phishing' END AS decision, round(abs(vote - 50) / 50, 4) AS vote_confidence FROM v""",
}
