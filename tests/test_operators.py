"""Hand-made tables with hand-derived results."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from caselink.operators import correlate, curate, entities, graph, metrics, retrieve, timeline, urls
from caselink.operators.components import component_roots
from caselink.operators.retrieve import cut_points
from caselink.sources import files


@pytest.fixture(scope="module")
def case(spark):
    """Four items: A and B share a phone and a wallet, A and C a domain, D has one e-mail address."""
    rows = [("c", "A", "phones", "+9779801122334"), ("c", "B", "phones", "+9779801122334"), ("c", "A", "esewa_ids", "+9779801122334"), ("c", "B", "esewa_ids", "+9779801122334"),
            ("c", "A", "domains", "esewa-login.xyz"), ("c", "C", "domains", "ESEWA-login.xyz"), ("c", "D", "emails", "d@x.org"), ("c", "D", "money", " "), ("c", "D", "ports", "80")]
    return spark.createDataFrame(rows, "case_id string, item_id string, entity_type string, value string")


def test_seeded_case_pairs(spark, case):
    occ = correlate.normalised(case)
    assert occ.count() == 7  # the blank value and the type that isn't linkable go
    spec = {(r.entity_type, r.value): r for r in correlate.value_specificity(correlate.document_frequency(occ)).collect()}
    assert spec["phones", "+9779801122334"].df == 2 and spec["phones", "+9779801122334"].corpus == 4
    # rarity 1 at df 2; 13 digits carry 13 * log2(10) = 43 bits, above 40: fully specific
    assert spec["phones", "+9779801122334"].specificity == 1.0
    pairs = {(r.a, r.b): r for r in correlate.correlate_pairs(correlate.shared_value_pairs(occ, correlate.value_specificity(correlate.document_frequency(occ)))).collect()}
    assert set(pairs) == {("A", "B"), ("A", "C")}
    assert pairs["A", "B"].weight == pytest.approx(1.9) and pairs["A", "B"].confidence == pytest.approx(round(1 - math.exp(-1.9 / 1.6), 4))
    assert pairs["A", "B"].strength == "STRONG" and pairs["A", "C"].strength == "MEDIUM"


def test_round_amounts_say_little(spark):
    df = spark.createDataFrame([("npr 2000",), ("npr 2017",), ("khalti9876543210",), ("5rs",)], "v string").select("v", correlate.intrinsic(F.col("v")).alias("s"))
    got = {r.v: r.s for r in df.collect()}
    assert got["npr 2000"] == pytest.approx(4 * math.log2(10) / 40 * 0.2)
    assert got["npr 2017"] == pytest.approx(4 * math.log2(10) / 40)
    assert got["khalti9876543210"] == 1.0


def test_values_of_padding_and_case_meet_across_cases_only_trimmed(spark):
    occ = spark.createDataFrame([("a", 1, "emails", " X@y.org"), ("b", 2, "emails", "x@Y.org ")], "case_id string, item_id long, entity_type string, value string")
    assert correlate.normalised(occ, trim=True).select("value").distinct().count() == 1
    assert correlate.normalised(occ, trim=False).select("value").distinct().count() == 2


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (7, 6), (9, 9)], [(i, i + 1) for i in range(40)], []])
def test_components(spark, edges):
    got = {r.node: r.component for r in component_roots(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {}
    for a, b in edges:
        x, y = want.setdefault(a, a), want.setdefault(b, b)
        for k in want:
            if want[k] in (x, y):
                want[k] = min(x, y)
    assert got == {k: v for k, v in want.items() if k != v}


def test_spanning_forest_has_nodes_less_components(spark):
    rows = [(1, 2, 0.9), (2, 3, 0.5), (1, 3, 0.7), (4, 5, 0.2), (5, 6, 0.2), (4, 6, 0.2)]
    got = {(r.u, r.v) for r in graph.backbone(spark.createDataFrame(rows, "u long, v long, weight double")).collect()}
    assert got == {(1, 2), (1, 3), (4, 5), (4, 6)}


def test_pagerank_sums_to_one_and_ranks_the_centre_first(spark):
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 6)], "u long, v long, weight double")
    got = {r.node: r["rank"] for r in graph.pagerank(star).collect()}
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-6) and max(got, key=got.get) == 0


def test_communities_label_every_node(spark):
    two = [(a, b, 1.0) for g in ((1, 2, 3), (11, 12, 13)) for a in g for b in g if a < b] + [(3, 11, 0.01)]
    got = {r.node: r.community for r in graph.communities(spark.createDataFrame(two, "u long, v long, weight double")).collect()}
    assert set(got) == {1, 2, 3, 11, 12, 13} and len({got[1], got[2], got[3]}) == 1 and len({got[11], got[12], got[13]}) == 1


def test_entities_of_a_receipt(spark):
    text = "Pay Rs 2,000 to eSewa ID: 9801122334 or visit https://ESEWA-login.xyz/Verify. Card 4539578763621486, CVE-2024-3400\nAccount No.:\n0501-0198765432 mail A.b@Example.com from 10.0.0.1 on 2026-01-04 at 11:15 AM"
    got = {(r.entity_type, r.normalized) for r in entities.extract_entities(spark.createDataFrame([("c", 1, text), ("c", 2, None)], "case_id string, item_id long, text string")).collect()}
    for want in (("money", "NPR 2000"), ("esewa_ids", "+9779801122334"), ("urls", "https://esewa-login.xyz/Verify"), ("card_numbers", "4539578763621486"), ("cve_ids", "CVE-2024-3400"), ("bank_accounts", "05010198765432"),
                 ("emails", "a.b@example.com"), ("ipv4", "10.0.0.1"), ("dates", "2026-01-04"), ("domains", "esewa-login.xyz")):
        assert want in got
    assert not any(t == "ports" for t, _ in got) and ("transaction_ids", "CVE-2024-3400") not in got


def test_network_entities(spark):
    text = ("see https://mail.Example.com:8443/x. and a.b@sub.corp.co.uk, my-site.dev or @my-site.com; nothing.here but v1.2, http://10.0.0.1/ "
            "fe80::1 and 2001:DB8:0:0:0:0:0:1, not 1::2::3 nor 12:30:45, ::1 host-a:8080 at 11:15 AM 10.1.2.3:443, port 22 00-1A-2B-3C-4D-5E 00:1a-2b:3c:4d:5e www.x.np?")
    got = {}
    for r in entities.extract_entities(spark.createDataFrame([("c", 1, text)], "case_id string, item_id long, text string"), ("network",)).collect():
        got.setdefault(r.entity_type, set()).add(r.normalized)
    assert got["domains"] == {"mail.example.com", "sub.corp.co.uk", "my-site.dev", "www.x.np"}
    assert got["ipv6"] == {"fe80::1", "2001:DB8:0:0:0:0:0:1", "::1"} and got["ipv4"] == {"10.0.0.1", "10.1.2.3"}
    assert got["ports"] == {"8443", "8080", "443", "22"} and got["mac_addresses"] == {"00:1a:2b:3c:4d:5e"}
    assert got["urls"] == {"https://mail.example.com:8443/x", "http://10.0.0.1/", "www.x.np"}


def test_valid_ipv6_as_the_standard_library(spark):
    import ipaddress

    def ok(v):
        try:
            return bool(ipaddress.IPv6Address(v))
        except ValueError:
            return False

    r = random.Random(3)
    forms = [":".join(r.choice(["", "1", "ab", "FFFF", "12345", "0"]) for _ in range(r.randrange(1, 10))) for _ in range(1500)] + ["::", ":::", "1::", "::1", ":1::", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7::8"]
    got = {x.v: x.k for x in spark.createDataFrame([(f,) for f in forms], "v string").select("v", entities.valid_ipv6(F.col("v")).alias("k")).collect()}
    assert all(bool(got[f]) == ok(f) for f in forms), [f for f in forms if bool(got[f]) != ok(f)]


def test_devanagari_cues(spark):
    text = "रु 2,000 खाता: 0501-0198765432 ओटीपी 4821।"
    got = {(r.entity_type, r.normalized) for r in entities.extract_entities(spark.createDataFrame([("c", 1, text)], "case_id string, item_id long, text string"), ("financial",)).collect()}
    assert {("bank_accounts", "05010198765432"), ("otp", "4821")} <= got and any(t == "money" for t, _ in got)


def test_public_suffix_rules(spark, tmp_path):
    from caselink.operators import urls
    from caselink.sources.files import read_suffix_rules

    (tmp_path / "list.dat").write_text("// comment\ncom\nuk\nco.uk\n\n*.ck   // wild\n!www.ck\nnp\ncom.np\nblogspot.com\n")
    rules = read_suffix_rules(spark, str(tmp_path / "list.dat"))
    hosts = {"a.b.example.co.uk": ("co.uk", "example.co.uk", "a.b"), "x.y.ck": ("y.ck", "x.y.ck", ""), "a.x.y.ck": ("y.ck", "x.y.ck", "a"), "www.ck": ("ck", "www.ck", ""), "a.www.ck": ("ck", "www.ck", "a"), "me.blogspot.com": ("blogspot.com", "me.blogspot.com", ""),
             "blogspot.com": ("", "blogspot.com", ""), "shop.unknown": ("unknown", "shop.unknown", ""), "localhost": ("", "localhost", ""), "10.0.0.1": ("", "10.0.0.1", ""), "esewa.com.np": ("com.np", "esewa.com.np", "")}
    table = urls.url_parts(spark.createDataFrame([(f"http://{h}/p",) for h in hosts], "url string"))
    assert {r.host: (r.suffix, r.registered_domain, r.subdomain) for r in urls.with_public_suffix(table, rules).collect()} == hosts


LAYOUTS = {
    "a.csv": "id,Label,URL\n1,phishing,http://a.com/x\n2,benign,b.org\n3,odd,http://c.net\n4,good,http://d.com/?q=1\n",
    "b.tsv": "site\tis_phishing\nhttp://a.com/x\t1\nb.org\t0\nhttp://d.com/?q=1\t0\n",
    "c.txt": "web|Result\nhttp://a.com/x|1\nb.org|-1\nhttp://d.com/?q=1|-1\n",
    "d.jsonl": '{"u": "http://a.com/x", "what": "Phishing", "flag": 0}\n{"u": "b.org", "what": "legitimate", "flag": 1}\n{"u": "http://d.com/?q=1", "what": "safe", "flag": 1}\n',
    "e.json": '{"data": [{"url": "http://a.com/x", "y": 1.0},\n {"url": "b.org", "y": 0.0},\n {"url": "http://d.com/?q=1", "y": 0.0}]}\n',
    "f.csv": 'note;type;link\n"a; b";bad;http://a.com/x\nc;normal;b.org\n"d";safe;http://d.com/?q=1\n',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_labelled_urls_of_any_layout(spark, tmp_path, name):
    from caselink.sources.files import read_labelled_urls

    (tmp_path / name).write_text(LAYOUTS[name])
    assert {(r.url, r.label) for r in read_labelled_urls(spark, str(tmp_path / name)).collect()} == {("http://a.com/x", 1), ("b.org", 0), ("http://d.com/?q=1", 0)}


def test_lists_by_their_names(spark, tmp_path):
    from caselink.sources.files import read_labelled_urls, sniff_layout

    for name, label in (("tranco-top.txt", 0), ("openphish.txt", 1)):
        (tmp_path / name).write_text("http://a.com/x\n\nb.org\n")
        assert {(r.url, r.label) for r in read_labelled_urls(spark, str(tmp_path / name)).collect()} == {("http://a.com/x", label), ("b.org", label)}
    (tmp_path / "list.txt").write_text("http://a.com/x\nb.org\n")
    (tmp_path / "mail.csv").write_text("a,b\nx@y.com,1\nz@y.com,0\n")
    (tmp_path / "none.txt").write_text("")
    for bad in ("list.txt", "mail.csv", "none.txt"):
        with pytest.raises(ValueError):
            read_labelled_urls(spark, str(tmp_path / bad))
    assert sniff_layout(spark, str(tmp_path / "none.txt")) == {"kind": "lines", "sep": ""}


def test_nearest_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(5)
    rows = [(i, i % 3 if i % 50 else None, r.integers(0, 4, 4).astype(float).tolist()) for i in range(400)] + [(900, 0, None), (901, 1, [1.0, None, 2.0, 3.0]), (902, 2, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, scope int, v array<double>").repartition(4)
    queries = vectors.where("vec_id % 7 = 0 or vec_id > 899").withColumnRenamed("vec_id", "query_id")
    want = {}
    ok = [(i, s, np.array(v)) for i, s, v in rows if s is not None and v and None not in v]
    for q, s, x in ok:
        if q % 7 == 0 or q > 899:
            near = sorted((round(float(np.sqrt(((x - v) ** 2).sum())), 6), i) for i, t, v in ok if t == s and len(v) == len(x))[:5]
            want[q] = near
    for block in (10_000, 30):
        got = {}
        for g in retrieve.knn(queries, vectors, 5, block).orderBy("rank").collect():
            got.setdefault(g.query_id, []).append((g.distance, g.vec_id))
        assert got == want
    assert retrieve.knn(queries.limit(0), vectors).count() == 0 == retrieve.knn(queries, vectors.limit(0)).count()


def test_subwords(spark):
    from caselink.operators import urls

    df = spark.createDataFrame([(1, "https://a.b/c?x=1&y=2"), (2, "https://a.b/c"), (3, None), (4, ""), (5, "é")], "n int, url string")
    assert spark.createDataFrame([("http://a.b-c/d_e?f=g#h@i:j",)], "url string").select(urls.subwords(F.col("url")).alias("t")).first().t == ["http", "://", "a", ".", "b", "-", "c", "/", "d", "_", "e", "?", "f", "=", "g", "#", "h", "@", "i", ":", "j"]
    vocabulary = urls.subword_vocabulary(df, 5)
    assert {r.token: (r.id, r.n) for r in vocabulary.collect()} == {".": (2, 2), "/": (3, 2), "://": (4, 2), "=": (5, 2), "a": (6, 2)}
    got = {r.n: r.token_ids for r in urls.encode_subwords(df, vocabulary, 8).collect()}
    assert got == {1: [1, 4, 6, 2, 1, 3, 1, 1], 2: [1, 4, 6, 2, 1, 3, 1, 0], 3: [0] * 8, 4: [0] * 8, 5: [1] + [0] * 7}
    chars = urls.encode_urls(spark.createDataFrame([(" aZ0é",)], "url string"), 6).first().char_ids
    assert chars == [2, 53, 54, 1, 0, 0]


def test_citation_scores(spark):
    make = lambda rows: spark.createDataFrame(rows, "query_id int, item_id int")
    got = {r.query_id: (r.precision, r.recall, r.f1) for r in retrieve.citation_scores(make([(1, 1), (1, 2), (1, 2), (2, 5), (3, None), (4, None)]), make([(1, 2), (1, 3), (1, 3), (4, 9), (5, 1)])).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0, 0, 0), 3: (0, 1, 0), 4: (0, 1, 0), 5: (0, 1, 0)}


def test_money_forms_are_one(spark):
    forms = ["Rs 2,000", "rs2000", "2000 NPR", "Rs. 2000.00", "2000 rupees"]
    assert {r.m for r in spark.createDataFrame([(f,) for f in forms], "v string").select(entities.normalize_money(F.col("v")).alias("m")).collect()} == {"NPR 2000"}


def test_cards_need_an_issuer_and_luhn(spark):
    rows = [("4539578763621486", True), ("4539578763621487", False), ("0000000000000000", False), ("9539578763621486", False)]
    got = {r.v: r.ok for r in spark.createDataFrame([(v,) for v, _ in rows], "v string").select("v", F.coalesce(entities.valid_card(F.col("v")), F.lit(False)).alias("ok")).collect()}
    assert got == dict(rows)


def test_canonical_urls(spark):
    rows = [("  HTTP://WWW.Example.COM:80/Path?q=1#frag  ", "http://www.example.com/Path?q=1"), ("example.com/", "http://example.com"), ("", ""), ("https://a.b:443/x%20y", "https://a.b/x y")]
    got = spark.createDataFrame(rows, "u string, want string").select("want", urls.canonical_url(F.col("u")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    rep = spark.createDataFrame([("http://a.b//c/?b=2&a=1&b=2",)], "u string").select(urls.canonical_url(F.col("u"), True).alias("x")).first().x
    assert rep == "http://a.b/c?a=1&b=2"


def test_host_scores(spark):
    rows = [("https://esewa.com.np/login", 0), ("http://esewa-login.xyz/verify", 100), ("http://10.0.0.1/x", 40), ("https://bit.ly/abc", 35), ("nohost", None)]
    got = {r.url: r.risk_score for r in urls.score_host(spark.createDataFrame([(u,) for u, _ in rows], "url string")).collect()}
    assert got == {u: (s if u != "http://esewa-login.xyz/verify" else 100) for u, s in rows}


def test_missing_scheme_follows_md5(spark):
    import hashlib

    names = [f"host{i}.example" for i in range(60)]
    got = {r.url for r in curate.clean_labelled(spark.createDataFrame([(n, "1") for n in names], "url string, label string")).collect()}
    want = set()
    for n in names:
        r = int(hashlib.md5(n.encode()).hexdigest(), 16) % 100
        want.add(("https://www." if r < 70 else "https://" if r < 90 else "http://www." if r < 95 else "http://") + n)
    assert got == want


def test_auc_of_ties_and_single_classes(spark):
    df = lambda rows: spark.createDataFrame(rows, "label int, proba double")
    assert metrics.roc_auc(df([(1, 0.5), (0, 0.5)])).first()[0] == 0.5
    assert metrics.roc_auc(df([(1, 0.9), (0, 0.1)])).first()[0] == 1.0
    assert metrics.roc_auc(df([(1, 0.9)])).first()[0] == 0.5
    assert metrics.pr_auc(df([(0, 0.9)])).first()[0] == 0.0


def test_stated_times(spark):
    up = dt.datetime(2026, 7, 3, 10)
    rows = [("paid 04/01/2026 at 11:15", dt.datetime(2026, 1, 4, 11, 15)), ("on 2026-02-30", None), ("in 1850-01-01", None), ("none", None), (None, None)]
    got = [r.t for r in spark.createDataFrame([(t, up) for t, _ in rows], "x string, u timestamp").select(timeline.stated_time(F.col("x"), F.col("u")).alias("t")).collect()]
    assert got == [w for _, w in rows]


def test_chunks_cover_the_text():
    text = " ".join(f"word{i}" for i in range(500))
    parts = cut_points(text, 400, 40)
    assert all(len(p) <= 400 for p in parts) and parts[0].startswith("word0 ") and parts[-1].endswith("word499")
    assert cut_points("", 10, 2) == [""] and {w for p in parts for w in p.split()} >= {f"word{i}" for i in range(500)}


def test_cleaned_text_keeps_addresses(spark):
    text = "Hello​  there,\nfriend\n-----\nSee https://a.b/c__d  and  a@b.org"
    row = files.clean_text(spark.createDataFrame([(1, text), (2, None)], "id long, text string")).collect()
    assert row[0].cleaned == "Hello there, friend\nSee https://a.b/c__d and a@b.org" and "hidden" in row[0].operations and row[1].cleaned == ""


def test_registers_that_are_missing_are_empty(spark, tmp_path):
    found = files.read_registers(spark, f"file://{tmp_path}")
    assert set(found) == set(files.REGISTERS) and all(df.isEmpty() for df in found.values())


def test_growth_of_cross_case_linking_is_in_its_shared_values(spark):
    """Rows of the link join: four times the cases, with the same number of items a value, give about four times the rows."""
    def made(cases):
        occ = spark.range(cases * 8).selectExpr("id div 8 as case_id", "id as item_id").selectExpr("case_id", "item_id", "'emails' as entity_type", "concat('v', item_id div 2, '@x.org') as value")
        occ = occ.unionByName(occ.selectExpr("case_id", "item_id", "entity_type", "concat('w', pmod(item_id * 7, " + str(cases * 4) + "), '@x.org') as value"))
        return correlate.shared_values(correlate.normalised(occ), correlate.value_specificity(correlate.document_frequency(correlate.normalised(occ))), [], "case_id").count()

    assert made(100) <= 1.5 ** math.log2(4) * 4 * max(made(25), 1)


def test_error_rates_of_many_words_and_whole_texts(spark, tmp_path):
    from caselink.operators import metrics
    from caselink.plans import q_metrics

    words = [f"w{i}" for i in range(500)]
    found = [*words[:10], "new", *words[11:480]]
    got = metrics.error_rates(spark.createDataFrame([("a", " ".join(words), " ".join(found))], "id string, expected string, found string")).first()
    assert (got.word_errors, got.wer) == (21, 0.042)
    spark.createDataFrame([(1, 1, "user", "x" * 400 + " on")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert q_metrics.l2_error_rates(spark, str(tmp_path)).first().char_errors == 2
