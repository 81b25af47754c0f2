"""The provenance graph by hand: all nine edge types, filled times, ties, and what is flagged."""

import datetime

from caselink.operators import case_graph as cg


def tables(spark):
    day = lambda n: datetime.datetime(2024, 1, n, 12)
    make = spark.createDataFrame
    return {
        "items": make([(1, 10, "Cam "), (1, 11, "cam"), (1, 12, ""), (1, 13, None), (2, 20, "cam")], "case_id long, item_id long, device string"),
        "occ": make([(1, 10, "phones", "9800"), (1, 11, "phones", "9800"), (1, 11, "people", "Ram"), (1, 12, "cves", "CVE-1"), (2, 20, "phones", "9800"), (1, 10, "phones", "9800")], "case_id long, item_id long, entity_type string, value string"),
        "verdicts": make([("9800", True), ("Ram", False)], "value string, flagged boolean"),
        "brands": make([(1, 12, "PayPal")], "case_id long, item_id long, brand string"),
        "events": make([(1, 10, day(1), "text", False, "high"), (1, 11, day(2), "meta", True, "medium"), (1, 12, day(1), cg.FALLBACK, False, "odd"), (1, 13, None, "unresolved", False, "low")],
                       "case_id long, item_id long, ts timestamp, ts_source string, inferred boolean, confidence string"),
        "pairs": make([(1, 10, 11, 0.8), (1, 10, 12, 0.1), (1, 10, 11, 0.5)], "case_id long, a long, b long, confidence double"),
        "matches": make([(1, 2, "phones", "9800", [10, 11], [20], 0.6)], "case_id long, other_case long, entity_type string, value string, items array<long>, other_items array<long>, confidence double"),
    }


def test_nine_types(spark):
    t = tables(spark)
    edges = cg.finished_edges(cg.case_edges(**t), t["events"]).collect()
    got = {(e.case_id, e.u, e.v, e.edge_type): e for e in edges}
    assert len(got) == len(edges) and {e.edge_type for e in edges} == set(cg.TYPE_WEIGHTS)
    ends = lambda kind, case=1: {(e.u, e.v) for e in edges if e.edge_type == kind and e.case_id == case}
    assert ends("contains") == {("case:1", f"evidence:{i}") for i in (10, 11, 12, 13)} | {("case:2", "evidence:20")}
    assert ends("shared_entity") == {("evidence:10", "phone_number:9800"), ("evidence:11", "phone_number:9800"), ("evidence:11", "person:ram"), ("cve:cve-1", "evidence:12"), ("brand:paypal", "evidence:12")}
    assert ends("threat_relationship", 2) == {("evidence:20", "phone_number:9800")}
    assert ends("metadata_relationship") == {("device:cam", "evidence:10"), ("device:cam", "evidence:11"), ("evidence:10", "evidence:11")} and ends("metadata_relationship", 2) == {("device:cam", "evidence:20")}
    assert ends("temporal_relationship") == {("evidence:10", "evidence:11")} == ends("behavioral_relationship")
    assert ends("cross_case_relationship") == {("case:1", "case:2")} and ends("cross_case_entity_match") == {("evidence:20", "phone_number:9800")}
    near = got[1, "evidence:10", "evidence:11", "temporal_relationship"]
    assert (near.weight, near.ts.day, near.ts_source, near.inferred) == (0.5, 1, "mixed_content_timestamps", True)
    assert got[1, "evidence:10", "evidence:11", "behavioral_relationship"].confidence == 0.8
    assert [got[1, f"evidence:{i}", f"timeline_event:1:{i}", "timeline_event"].confidence for i in (10, 11, 12, 13)] == [1.0, 0.7, 0.4, 0.4]
    crossed = got[1, "case:1", "case:2", "cross_case_relationship"]
    assert crossed.items == [10, 11, 20] and crossed.ts.day == 1 and crossed.ts_source == "text"  # the first item with an event
    late = got[1, "evidence:11", "person:ram", "shared_entity"]
    assert (late.ts.day, late.ts_source, late.inferred) == (2, "meta", True)
    none = got[1, "case:1", "evidence:13", "contains"]
    assert (none.ts, none.ts_source, none.inferred) == (None, "unresolved", False)


def test_flags_and_summary(spark):
    t = tables(spark)
    flagged = cg.flagged_edges(cg.finished_edges(cg.case_edges(**t), t["events"]))
    rows = flagged.collect()
    kept = {(e.u, e.v, e.edge_type) for e in rows if e.backbone and e.case_id == 1}
    assert {k[2] for k in kept} >= set(cg.ALWAYS) and ("evidence:10", "evidence:11", "behavioral_relationship") not in kept  # the flagged number joins them at 1.0
    nodes = {n for e in rows if e.case_id == 1 for n in (e.u, e.v)}
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v, _ in kept:
        root[find(u)] = find(v)
    assert len({find(n) for n in nodes}) == 1  # the backbone spans the case
    s = {r.case_id: r for r in cg.case_graph_summary(flagged).collect()}
    assert s[1].threat_edges == 2 and s[1].behavioral_edges == 1 and s[1].nodes == len(nodes) and s[1].key_connectors[0] == "phone_number:9800" and s[2].key_connectors == ["device:cam", "phone_number:9800"]
    alone = cg.flagged_edges(cg.finished_edges(cg.case_edges(t["items"].limit(0))))
    assert alone.count() == 0
