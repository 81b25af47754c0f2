"""Queries of metrics: labels' quality as truth, a score from the document's md5; gold tables from lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselink.operators import calibrate as cal, metrics as op
from caselink.operators.curate import stratified_kfold
from caselink.plans.tables import table


def _scores(spark, d):
    score = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 3), 16, 10).cast("double") / 4095
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), F.round(score * 0.7 + F.col("quality") * 0.3, 3).alias("proba"))
    return rows.withColumn("pred", (F.col("proba") >= 0.5).cast("int"))


def f1_train_compare(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), "l_quantity", "l_discount", "l_tax", "l_orderkey")
    return op.train_compare(rows.where("l_orderkey % 4 > 0"), rows.where("l_orderkey % 4 = 0"), ["l_quantity", "l_discount", "l_tax"])


def f3_tune(spark, d):
    return op.tune(table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), "l_quantity", "l_discount"), ["l_quantity", "l_discount"])


def f4_binary_metrics(spark, d):
    return op.binary_metrics(_scores(spark, d))


def f5_roc_auc(spark, d):
    return op.roc_auc(_scores(spark, d))


def f6_pr_auc(spark, d):
    return op.pr_auc(_scores(spark, d))


def f7_curve_points(spark, d):
    return op.curve_points(_scores(spark, d))


def f8_fit_temperature(spark, d):
    return op.fit_temperature(_scores(spark, d))


def f9_reliability(spark, d):
    return op.reliability(_scores(spark, d))


def f9_calibration_error(spark, d):
    return op.calibration_error(_scores(spark, d))


def f10_auto_recalibrate(spark, d):
    return cal.auto_recalibrate(_scores(spark, d))


def f10_recalibrate_on_other_rows(spark, d):
    s = _scores(spark, d)
    return cal.auto_recalibrate(s.where("doc_id % 2 = 0"), s.where("doc_id % 2 = 1"), ("identity", "temperature", "isotonic"))


def f8_isotonic_intervals(spark, d):
    out = cal.isotonic_intervals(_scores(spark, d))
    return out.select(*(F.round(F.when(F.abs(c) < 2, F.col(c)), 6).alias(c) for c in ("lo", "hi", "y_lo", "y_hi")))


def f8_isotonic_applied(spark, d):
    s = _scores(spark, d)
    return cal.fit_calibrator(s.where("doc_id % 2 = 0"), "isotonic").apply(s.select("doc_id", "label", "proba"))


def f8_temperature_applied(spark, d):
    s = _scores(spark, d)
    return cal.fit_calibrator(s.where("doc_id % 2 = 0"), "temperature").apply(s.select("doc_id", "label", "proba"))


def f8_platt_applied(spark, d):
    s = _scores(spark, d)
    return cal.fit_calibrator(s, "platt").apply(s.select("doc_id", "label", "proba"))


def f2_fold_metrics(spark, d):
    """Metrics of the md5 score on each stratified fold, and over the folds."""
    s = _scores(spark, d).withColumn("url", F.col("doc_id").cast("string"))
    folds = op.grouped_metrics(stratified_kfold(s, 4), ("fold",))
    return folds.drop("tp", "fp", "tn", "fn")


def f2_cross_validate(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), "l_quantity", "l_discount", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("url"))
    return op.cross_validate(rows, ["l_quantity", "l_discount"], 3, ("tree",))[1]


def f11_error_analysis(spark, d):
    return op.error_analysis(_scores(spark, d))


def f12_rank_models(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_type").alias("model")).agg(F.round(F.avg("p_size") / 50, 2).alias("f1"), F.max("p_size").alias("roc_auc"), F.min("p_retailprice").alias("recall"), F.max("p_retailprice").alias("precision"))
    return op.rank_models(m)


def _gold(spark, d, n):
    return table(spark, d, "lineitem").where(n).select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("entity_type"), F.col("l_suppkey").alias("value"))


def l1_entity_prf(spark, d):
    return op.entity_prf(_gold(spark, d, "l_linenumber <= 4"), _gold(spark, d, "l_linenumber >= 3"))


def l1_entity_prf_summary(spark, d):
    return op.entity_prf_summary(l1_entity_prf(spark, d))


def l2_error_summary(spark, d):
    return op.error_summary(l2_error_rates(spark, d))


def l2_error_rates(spark, d):
    t = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("expected"))
    return op.error_rates(t.withColumn("found", F.regexp_replace("expected", "on", "no")))


def l3_preservation_rate(spark, d):
    gold = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("entity_type"), F.lit("tion").alias("value"))
    return op.preservation_rate(gold, table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"))


def l4_pair_prf(spark, d):
    lines = table(spark, d, "lineitem")
    return op.pair_prf(lines.where("l_linenumber = 1").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), lines.where("l_quantity > 25").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


def l5_order_accuracy(spark, d):
    o = table(spark, d, "orders")
    return op.order_accuracy(o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), F.unix_micros("o_orderdate").alias("rank")), o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("rank")))


def l6_timestamp_error(spark, d):
    first = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.min("l_shipdate").alias("ts"))
    return op.timestamp_error(table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("ts")), first)


QUERIES = {k: f for k, f in globals().items() if k[0] in "fl" and k[1].isdigit()}

S = "s AS (SELECT doc_id, quality AS label, round(('0x' || md5(doc_id::VARCHAR)[1:3])::INTEGER::DOUBLE / 4095 * 0.7::DOUBLE + quality * 0.3::DOUBLE, 3) AS proba FROM labels), m AS (SELECT *, (proba >= 0.5)::INTEGER AS pred FROM s)"
RUN = S + ", g AS (SELECT proba, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM m GROUP BY proba), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY proba DESC ROWS UNBOUNDED PRECEDING))"
METRICS = """mg AS (SELECT *, {by} AS g FROM {m}), cg AS (SELECT g, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fn,
  avg(-CASE WHEN label = 1 THEN ln(greatest(least(proba, 1 - 1e-7), 1e-7)) ELSE ln(1 - greatest(least(proba, 1 - 1e-7), 1e-7)) END) AS ll, avg((proba - label) * (proba - label)) AS br FROM mg GROUP BY g),
eg AS (SELECT g, sum(gap) / sum(n) AS ce FROM (SELECT g, abs(sum(proba - label)) AS gap, count(*) AS n FROM mg GROUP BY g, least(floor(proba * 10), 9)) GROUP BY g),
sg AS (SELECT g, proba, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM mg GROUP BY g, proba), rg AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM sg WINDOW w AS (PARTITION BY g ORDER BY proba DESC ROWS UNBOUNDED PRECEDING)),
ag AS (SELECT g, sum(neg * (tp - pos) + neg * pos / 2) / (sum(pos) * sum(neg)) AS roc, sum(pos * tp / (tp + fp)) / sum(pos) AS pr FROM rg GROUP BY g),
rated AS (SELECT g, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr, round(roc, 6) AS roc_auc, round(pr, 6) AS pr_auc,
  round(ll, 6) AS log_loss, round(br, 6) AS brier, round(ce, 6) AS ece FROM cg JOIN eg USING (g) JOIN ag USING (g))"""
# isotonic regression by its max-min formula: the highest of the lowest means of the ranges that hold a score
ISO = """i0 AS (SELECT proba AS x, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM m WHERE {where} GROUP BY proba), i1 AS (SELECT row_number() OVER (ORDER BY x) AS i, x, pos, n FROM i0),
i2 AS (SELECT i, x, pos, n, sum(pos) OVER w AS s, sum(n) OVER w AS w FROM i1 WINDOW w AS (ORDER BY i)),
i3 AS (SELECT j.i AS j, k.i AS k, min((k.s - j.s + j.pos) / (k.w - j.w + j.n)) OVER (PARTITION BY j.i ORDER BY k.i DESC ROWS UNBOUNDED PRECEDING) AS low FROM i2 j JOIN i2 k ON k.i >= j.i),
i4 AS (SELECT x, round(max(low), 12) AS y FROM i3 JOIN i2 ON j <= i2.i AND k = i2.i GROUP BY x), i5 AS (SELECT y, min(x) AS first, max(x) AS last FROM i4 GROUP BY y),
i6 AS (SELECT *, lag(last) OVER (ORDER BY y) AS before, lag(y) OVER (ORDER BY y) AS y0, lead(y) OVER (ORDER BY y) AS after FROM i5),
iv AS (SELECT coalesce(before, '-infinity'::DOUBLE) AS lo, first AS hi, coalesce(y0, y) AS y_lo, y AS y_hi FROM i6 UNION ALL SELECT first, last, y, y FROM i6 WHERE first < last UNION ALL SELECT last, 'infinity'::DOUBLE, y, y FROM i6 WHERE after IS NULL)"""
LOOK = "round(CASE WHEN y_lo = y_hi THEN y_lo ELSE y_lo + (y_hi - y_lo) * (proba - lo) / (hi - lo) END, 6)"
TEMP = """tg AS (SELECT round(0.1 + 4.9 * i / 199, 6) AS t, 0.1::DOUBLE + 4.9::DOUBLE * i / 199 AS raw FROM range(200) r(i)), ts AS (SELECT label, ln(greatest(least(proba, 1 - 1e-7), 1e-7) / (1 - greatest(least(proba, 1 - 1e-7), 1e-7))) AS z FROM m WHERE {where}),
tb AS (SELECT t FROM (SELECT t, round(avg(ln(1 + exp(CASE WHEN label = 1 THEN -z ELSE z END / raw))), 9) AS loss FROM tg, ts GROUP BY t) ORDER BY loss, t LIMIT 1)"""
HEAT = "round(1 / (1 + exp(-ln(greatest(least(proba, 1 - 1e-7), 1e-7) / (1 - greatest(least(proba, 1 - 1e-7), 1e-7))) / t)), 6)"
GOLD = "(SELECT DISTINCT l_orderkey AS item_id, l_returnflag AS entity_type, l_suppkey AS value FROM lineitem WHERE {})"
ORACLES = {
    "f4_binary_metrics": f"WITH {S}, {METRICS.format(by='1', m='m')} SELECT * EXCLUDE (g) FROM rated",
    "f2_fold_metrics": f"WITH {S}, k AS (SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id::VARCHAR)) % 4)::INTEGER AS fold FROM m), {METRICS.format(by='fold', m='k')} SELECT * EXCLUDE (g, tp, fp, tn, fn), g AS fold FROM rated",
    "f8_isotonic_intervals": f"WITH {S}, {ISO.format(where='true')} SELECT round(CASE WHEN abs(lo) < 2 THEN lo END, 6) AS lo, round(CASE WHEN abs(hi) < 2 THEN hi END, 6) AS hi, round(y_lo, 6) AS y_lo, round(y_hi, 6) AS y_hi FROM iv",
    "f8_isotonic_applied": f"WITH {S}, {ISO.format(where='doc_id % 2 = 0')} SELECT doc_id, label, {LOOK} AS proba FROM m JOIN iv ON proba >= lo AND proba < hi",
    "f8_temperature_applied": f"WITH {S}, {TEMP.format(where='doc_id % 2 = 0')} SELECT doc_id, label, {HEAT} AS proba FROM m, tb",
    "f10_recalibrate_on_other_rows": f"""WITH {S}, {ISO.format(where='doc_id % 2 = 0')}, {TEMP.format(where='doc_id % 2 = 0')}, z AS (SELECT 'identity' AS method, label, round(proba, 6) AS proba FROM m WHERE doc_id % 2 = 1
  UNION ALL SELECT 'temperature', label, {HEAT} FROM m, tb WHERE doc_id % 2 = 1 UNION ALL SELECT 'isotonic', label, {LOOK} FROM m JOIN iv ON proba >= lo AND proba < hi WHERE doc_id % 2 = 1),
b AS (SELECT method, count(*) AS n, round(abs(avg(proba) - avg(label)), 6) AS gap FROM z GROUP BY method, least(floor(proba * 10), 9)), e AS (SELECT method, round(sum(n * gap) / sum(n), 6) AS ece, max(gap) AS mce FROM b GROUP BY method),
w AS (SELECT *, (SELECT round(avg((proba - label) * (proba - label)), 6) FROM z WHERE z.method = e.method) AS brier FROM e), best AS (SELECT * FROM w ORDER BY ece, brier, method LIMIT 1)
SELECT w.*, CASE WHEN (SELECT ece FROM w WHERE method = 'identity') - best.ece >= 0.002 THEN w.method = best.method ELSE w.method = 'identity' END AS chosen FROM w, best""",
    "f5_roc_auc": f"WITH {RUN} SELECT round(sum(neg * (tp - pos) + neg * pos / 2) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM r",
    "f6_pr_auc": f"WITH {RUN} SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS pr_auc FROM r",
    "f7_curve_points": f"WITH {RUN} SELECT proba, round(tp / (SELECT sum(pos) FROM g), 6) AS tpr, round(fp / (SELECT sum(neg) FROM g), 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM r",
    "f9_reliability": f"WITH {S} SELECT least(floor(proba * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(proba), 6) AS mean_proba, round(avg(label), 6) AS positive_rate, round(abs(avg(proba) - avg(label)), 6) AS gap FROM m GROUP BY 1",
    "f9_calibration_error": f"WITH {S}, b AS (SELECT count(*) AS n, round(abs(avg(proba) - avg(label)), 6) AS gap FROM m GROUP BY least(floor(proba * 10), 9)) SELECT round(sum(n * gap) / sum(n), 6) AS ece, max(gap) AS mce FROM b",
    "f11_error_analysis": f"WITH {S} SELECT doc_id, CASE WHEN pred = 1 THEN 'false_positive' ELSE 'false_negative' END AS kind, round(abs(proba - 0.5) * 2, 6) AS confidence FROM m WHERE label <> pred ORDER BY confidence DESC, doc_id LIMIT 20",
    "f12_rank_models": "WITH m AS (SELECT p_type AS model, round(avg(p_size) / 50, 2) AS f1, max(p_size) AS roc_auc, min(p_retailprice) AS recall, max(p_retailprice) AS precision FROM part GROUP BY p_type) SELECT *, (row_number() OVER (ORDER BY f1 DESC, roc_auc DESC, recall DESC, precision DESC, model))::INTEGER AS rank FROM m",
    "l1_entity_prf_summary": f"""
WITH e AS (WITH g AS {GOLD.format('l_linenumber <= 4')}, p AS {GOLD.format('l_linenumber >= 3')}, c AS (SELECT coalesce(g.entity_type, p.entity_type) AS entity_type, count(*) FILTER (g.value IS NOT NULL AND p.value IS NOT NULL) AS tp, count(*) FILTER (g.value IS NULL) AS fp, count(*) FILTER (p.value IS NULL) AS fn
  FROM g FULL JOIN p ON g.item_id = p.item_id AND g.entity_type = p.entity_type AND g.value = p.value GROUP BY 1)
SELECT entity_type, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c) SELECT count(*) AS types, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall,
  round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1 FROM e""",
    "l1_entity_prf": f"""
WITH g AS {GOLD.format('l_linenumber <= 4')}, p AS {GOLD.format('l_linenumber >= 3')}, c AS (SELECT coalesce(g.entity_type, p.entity_type) AS entity_type, count(*) FILTER (g.value IS NOT NULL AND p.value IS NOT NULL) AS tp, count(*) FILTER (g.value IS NULL) AS fp, count(*) FILTER (p.value IS NULL) AS fn
  FROM g FULL JOIN p ON g.item_id = p.item_id AND g.entity_type = p.entity_type AND g.value = p.value GROUP BY 1)
SELECT entity_type, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "l3_preservation_rate": "SELECT lang AS entity_type, count(*) AS n, round(avg(contains(text, 'tion')::INTEGER), 6) AS preserved FROM documents GROUP BY lang",
    "l4_pair_prf": """
WITH g AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_linenumber = 1), p AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_quantity > 25),
c AS (SELECT count(*) FILTER (g.a IS NOT NULL AND p.a IS NOT NULL) AS tp, count(*) FILTER (g.a IS NULL) AS fp, count(*) FILTER (p.a IS NULL) AS fn FROM g FULL JOIN p ON g.a = p.a AND g.b = p.b)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""",
    "l5_order_accuracy": """
WITH b AS (SELECT o_custkey AS case_id, o_orderdate AS r, o_totalprice AS f FROM orders WHERE o_orderstatus <> 'P'),
s AS (SELECT x.case_id, avg((x.f < y.f)::INTEGER) AS a, count(*) AS pairs FROM b x JOIN b y ON x.case_id = y.case_id AND x.r < y.r GROUP BY x.case_id)
SELECT case_id, coalesce(pairs, 0) AS pairs, round(coalesce(a, 1), 6) AS accuracy, round(2 * coalesce(a, 1) - 1, 6) AS tau, coalesce(a, 1) = 1 AS exact FROM (SELECT DISTINCT case_id FROM b) LEFT JOIN s USING (case_id)""",
    "l6_timestamp_error": """
WITH p AS (SELECT l_orderkey, min(l_shipdate) AS ts FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), e AS (SELECT abs(epoch_us(o_orderdate) - epoch_us(ts)) / 1e6 AS e FROM orders LEFT JOIN p ON l_orderkey = o_orderkey)
SELECT count(*) AS n, round(avg(e), 3) AS mae_s, round(median(e), 3) AS median_s, round(avg((e <= 60)::INTEGER), 6) AS within_minute, round(avg((e <= 3600)::INTEGER), 6) AS within_hour, round(avg((e <= 86400)::INTEGER), 6) AS within_day, round(avg((e IS NULL)::INTEGER), 6) AS unresolved FROM e""",
}
