"""Links between cases in cells: what travels, and what is counted inside a cell."""

from caselink.operators import correlate as op
from oracle import rows


def crowds(spark):
    """Twelve crowds of twenty cases; inside a crowd values are shared, between crowds only one, by two cases."""
    own = [(c, c * 10 + k, "phones", f"98{c // 20}{(c * 7 + k * k) % 30:03d}") for c in range(240) for k in range(4)]
    return spark.createDataFrame([*own, (3, 30, "emails", "x@y"), (233, 2330, "emails", "x@y")], "case_id long, item_id long, entity_type string, value string")


def test_cells_grow_with_rows_where_neighbours_share(spark):
    shared = crowds(spark).select("case_id", op.F.xxhash64("entity_type", "value").alias("v")).distinct().select(op.F.col("case_id").alias("n"), "v", op.F.lit(1).alias("what"))
    found = op.case_cells(shared, 12)
    assert found.count() < 2.5 * shared.count()  # by hash a row went to nearly every block
    assert found.select("low", "high").distinct().count() < 40


def test_counts_are_those_of_the_links(spark):
    occ = crowds(spark)
    spec = op.value_specificity(op.document_frequency(occ))
    whole = op.cross_case_links(occ, spec)
    parts = op.cross_case_links(occ, spec, block=30)
    assert whole.count() == parts.count() > 500 and parts.exceptAll(whole).isEmpty()
    assert parts.where("a = 3 and b = 233").count() == 1
    for named in (occ, occ.withColumn("case_id", op.F.concat(op.F.lit("c"), op.F.lpad(op.F.col("case_id").cast("string"), 4, "0")))):
        expected, got = op.propagate_links(op.cross_case_links(named, spec, block=30)), op.cross_case_counts(named, spec, block=30)
        assert got.schema["case_id"].dataType == named.schema["case_id"].dataType
        order = ["case_id", "linked_cases", "first_case"]
        assert rows(got.columns, got.collect(), order) == rows(expected.columns, expected.collect(), order)


def test_specificity_names_its_parts_once(spark):
    """Nested uses made a plan of thousands of expressions, which took milliseconds a value."""
    text = spark.range(1).select(op.intrinsic(op.F.col("id").cast("string")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.lower().count("regexp_replace") <= 6
