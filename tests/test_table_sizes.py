"""What the queries read of the given tables goes through session.spread, so that shuffles and scans follow its size."""

from conftest import DATA

from caselink.plans import tables


def test_occurrences_are_dealt_by_the_size_of_their_tables(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tables, "spread", lambda spark, path: seen.append(path))
    tables.occurrences(spark, DATA)
    assert sorted(seen) == [f"{DATA}/lineitem.parquet", f"{DATA}/orders.parquet"]
