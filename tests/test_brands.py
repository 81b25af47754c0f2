"""Brand findings by hand, and the parts they are made of."""

import random

from caselink.operators import brands
from caselink.operators.brands import edits, near_brands, read_as, skeleton

CASES = {
    # a brand at home
    "https://www.microsoft.com": ("microsoft", 0.0, "none", set()),
    "https://a.b.c.login.microsoftonline.com/x": ("microsoft", 0.0, "none", set()),
    "https://accounts.google.com/signin": ("google", 0.0, "none", set()),
    "https://ird.gov.np/": ("government_of_nepal", 0.0, "none", set()),
    "https://www.esewa.com.np/login": ("esewa", 0.0, "none", set()),
    # another brand on a trusted domain
    "https://user.github.io/microsoft-login": ("github", 0.35, "medium", {("brand_conflict", "microsoft")}),
    "https://paypal.github.io/": ("github", 0.45, "medium", {("brand_conflict", "paypal")}),
    "https://firebaseapp.com/google": (None, 0.35, "medium", {("brand_conflict", "google")}),
    "https://my-paypal-shop.netlify.app/login": (None, 0.6, "high", {("brand_conflict", "paypal"), ("cloud_hosted_impersonation", "paypal")}),
    # imitations
    "http://paypa1.com/": (None, 0.6, "high", {("typosquatting", "paypal"), ("official_domain_mismatch", "paypal")}),
    "http://payypal.com/": (None, 0.6, "high", {("typosquatting", "paypal"), ("official_domain_mismatch", "paypal")}),
    "http://papyal.com/": (None, 0.6, "high", {("typosquatting", "paypal"), ("official_domain_mismatch", "paypal")}),
    "http://rnicrosoft.com/": (None, 0.6, "high", {("typosquatting", "microsoft"), ("official_domain_mismatch", "microsoft")}),
    "http://secure-khalti.com/": (None, 0.45, "medium", {("official_domain_mismatch", "khalti"), ("misleading_affix", "khalti")}),
    "http://shop.example/netflix": (None, 0.1, "low", {("brand_token_reference", "netflix")}),
    "http://раyраl.com/": (None, 0.6, "high", {("homoglyph", "paypal"), ("official_domain_mismatch", "paypal")}),
    "http://xn--pypal-4ve.com/": (None, 0.9, "high", {("typosquatting", "paypal"), ("homoglyph", "paypal"), ("official_domain_mismatch", "paypal")}),
    # nothing
    "https://münchen.example/": (None, 0.0, "none", set()),
    "https://news.example.org/today": (None, 0.0, "none", set()),
    "": (None, 0.0, "none", set()),
}


def test_findings_and_risk(spark):
    table = spark.createDataFrame([(i, u) for i, u in enumerate([*CASES, None, "http://paypa1.com/"])], "n int, url string").repartition(3)
    risk = {r.n: r for r in brands.brand_risk(table).collect()}
    found = {}
    for f in brands.brand_findings(table).collect():
        found.setdefault(f.n, []).append(f)
    for i, (url, (owner, score, level, kinds)) in enumerate(CASES.items()):
        assert (risk[i].official_brand, risk[i].brand_score, risk[i].brand_level) == (owner, score, level), url
        assert {(f.finding, f.brand) for f in found.get(i, [])} == kinds, url
    assert len(risk) == len(CASES) + 2 and risk[len(CASES)].brand_score is None and len(found[len(CASES) + 1]) == 2
    severe = {(f.finding, f.severity) for fs in found.values() for f in fs}
    assert {("typosquatting", "critical"), ("typosquatting", "high"), ("homoglyph", "critical"), ("brand_conflict", "medium"), ("brand_conflict", "high")} <= severe


def test_context_adds_to_severe_findings_only(spark):
    rows = [("http://paypa1.com/", 10, False, True, 2), ("http://paypa1.com/", 900, True, False, 1), ("http://shop.example/netflix", 10, False, True, 2), ("http://secure-khalti.com/", None, False, None, None), ("http://secure-khalti.com/", -1, None, True, 0)]
    table = spark.createDataFrame(rows, "url string, domain_age_days int, ssl_valid boolean, whois_private boolean, suspicious_keyword_count int")
    got = sorted((r.url, r.domain_age_days, r.brand_score) for r in brands.brand_risk(table).collect() if r.domain_age_days is not None)
    assert got == [("http://paypa1.com/", 10, 0.9), ("http://paypa1.com/", 900, 0.6), ("http://secure-khalti.com/", -1, 0.5), ("http://shop.example/netflix", 10, 0.1)]


def test_distance_equals_the_table_with_swaps():
    import duckdb

    r = random.Random(3)
    pairs = [("".join(r.choice("abcd") for _ in range(r.randrange(0, 9))), "".join(r.choice("abcd") for _ in range(r.randrange(0, 9)))) for _ in range(3000)]
    pairs += [(a, a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :]) for a, _ in pairs for i in range(0, 3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE p(a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs[:4000])
    for a, b, n in con.execute("SELECT a, b, damerau_levenshtein(a, b) FROM p").fetchall():
        assert edits(a, b) == min(n, 3) and edits(a, b, 6) == min(n, 7), (a, b)


def test_readings():
    assert read_as("rnicr0s0ft") == "microsoft" and read_as("c1oud") == "cloud" and skeleton("xn--pypal-4ve.com")[1] == "paypal.com"
    assert skeleton("ｐａｙpal.com") == ("paypal.com", "paypal.com") and skeleton("xn--99999999.com")[0]
    words = {"paypal": ("paypal",), "x": ("abcd",)}
    assert near_brands("paypal", words) == [] and near_brands("payppal", words) == [("paypal", 0)] and near_brands("abce", words) == []
