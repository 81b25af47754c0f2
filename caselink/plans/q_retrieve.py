"""Queries of retrieval: documents are items of their source; benchmark passages are the questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselink.operators import retrieve as op
from caselink.plans.tables import table


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("item_id"), "text")


def k1_chunk_text(spark, d):
    return op.chunk_text(_texts(spark, d)).select("chunk_id", "item_id", "chunk_no", F.length("text").alias("n_chars"), "digest")


def k2_build_chunks(spark, d):
    occ = _texts(spark, d).select("case_id", "item_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), F.lit(0))).alias("value"))
    pairs = occ.alias("x").join(occ.alias("y"), "value").where("x.item_id < y.item_id and x.case_id = y.case_id").select("x.case_id", F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"))
    return op.build_chunks(op.chunk_text(_texts(spark, d)), occ, pairs).select("chunk_id", "digest", F.size("entity_values").alias("values"), F.size("related").alias("related"))


def k3_sync_chunks(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.md5("text").alias("digest"), "lang")
    old = rows.where("lang <> 'fr'").withColumn("digest", F.when(F.col("lang") == "de", "x").otherwise(F.col("digest")))
    return op.sync_chunks(old, rows.where("lang <> 'es'"))


def k4_knn(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("scope"), F.col("embedding").cast("array<double>").alias("v"))
    return op.knn(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows)


def _questions(spark, d):
    """Benchmark passages: the entity is their first long word, the exact id their own number where it is even."""
    entity = F.regexp_extract("text", "[A-Za-z]{9,}", 0)
    exact = F.when(F.col("item_id") % 2 == 0, F.col("item_id"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.when(entity != "", entity).alias("entity"), exact.alias("exact_id"))


def _chunks(spark, d):
    return _texts(spark, d).select(F.concat(F.col("item_id").cast("string"), F.lit(":000")).alias("chunk_id"), "item_id", "text")


def _near(spark, d):
    """A question has the vector of its number, a document that of its id."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("scope"), F.col("embedding").cast("array<double>").alias("v"))
    asked = rows.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return op.knn(asked.withColumnRenamed("vec_id", "query_id"), rows).select("query_id", F.col("vec_id").alias("item_id"), "score")


def _ranked(spark, d):
    return op.hybrid_rank(_questions(spark, d), _chunks(spark, d), _near(spark, d))


def k5_hybrid_rank(spark, d):
    return _ranked(spark, d)


def k6_expand_and_diversify(spark, d):
    related = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") + 1).alias("other"))
    return op.expand_and_diversify(_ranked(spark, d), related)


def k7_missing_constraints(spark, d):
    rows = table(spark, d, "documents")
    return op.missing_constraints(rows.select(F.col("doc_id").alias("query_id"), "text"), rows.select((F.col("doc_id") - 1).alias("query_id"), "text"))


def k8_citation_scores(spark, d):
    """Orders as queries: the suppliers of their first lines are expected, those of full lines cited."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("item_id"), "l_linenumber", "l_quantity")
    return op.citation_scores(lines.where("l_linenumber <= 3"), lines.where("l_quantity > 20"))


def k8_retrieval_metrics(spark, d):
    found = op.knn(*(lambda r: (r.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), r))(table(spark, d, "embeddings").select("vec_id", F.col("label").alias("scope"), F.col("embedding").cast("array<double>").alias("v"))))
    expected = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("item_id"))
    return op.retrieval_metrics(expected, found.select("query_id", F.col("vec_id").alias("item_id"), "rank"))


QUERIES = {k: f for k, f in globals().items() if k[0] == "k" and k[1].isdigit()}

NEAR = """near AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 20 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near QUALIFY rank <= 5)"""
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: length(x) > 2))"
HITS = NEAR.replace("q.vec_id % 20 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)") + f""",
q AS (SELECT item_id AS query_id, {WORDS.format('text')} AS ws, nullif(regexp_extract(text, '[A-Za-z]{{9,}}'), '') AS entity, CASE WHEN item_id % 2 = 0 THEN item_id END AS exact_id FROM benchmark),
h AS (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents),
words AS (SELECT query_id, doc_id, 0.35::DOUBLE * (count(*) / len(any_value(ws))::DOUBLE) AS s FROM (SELECT query_id, ws, unnest(ws) AS w FROM q) JOIN h USING (w) GROUP BY query_id, doc_id),
parts AS (
  SELECT * FROM words UNION ALL SELECT query_id, vec_id, 0.65::DOUBLE * round(1 / (1 + distance), 6) FROM top
  UNION ALL SELECT query_id, exact_id, 0.85::DOUBLE FROM q WHERE exact_id IS NOT NULL),
summed AS (SELECT query_id, doc_id, sum(s) AS s FROM parts GROUP BY query_id, doc_id),
rated AS (
  SELECT query_id, doc_id || ':000' AS chunk_id, doc_id AS item_id, round(least(1.0::DOUBLE, s + CASE WHEN entity IS NOT NULL AND contains(text, entity) THEN 0.55::DOUBLE ELSE 0 END), 6) AS score
  FROM summed JOIN q USING (query_id) JOIN documents USING (doc_id)),
hits AS (SELECT * FROM rated WHERE score >= 0.18)"""
CONSTRAINT = r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|\b[a-f0-9]{32,64}\b|(?:NPR|Rs\.?|USD|\$)\s?[0-9][0-9,]*|\b[0-9]{6,}\b"
ORACLES = {
    "k3_sync_chunks": """
SELECT doc_id::VARCHAR AS chunk_id, CASE lang WHEN 'fr' THEN 'add' WHEN 'es' THEN 'delete' WHEN 'de' THEN 'update' ELSE 'keep' END AS action FROM documents""",
    "k4_knn": f"WITH {NEAR} SELECT query_id, vec_id, rank::INTEGER AS rank, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM top",
    "k5_hybrid_rank": f"WITH {HITS} SELECT * FROM hits",
    "k6_expand_and_diversify": f"""
WITH {HITS}, every AS (SELECT query_id, chunk_id, item_id, score FROM hits UNION ALL SELECT query_id, (item_id + 1) || ':000', item_id + 1, round(score * 0.72::DOUBLE, 6) FROM hits),
best AS (SELECT query_id, chunk_id, item_id, max(score) AS score FROM every GROUP BY ALL),
turned AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY score DESC, chunk_id)::INTEGER AS turn FROM best)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, score DESC, chunk_id)::INTEGER AS rank FROM turned QUALIFY rank <= 8""",
    "k7_missing_constraints": f"""
WITH v AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{CONSTRAINT}'))) AS value FROM documents)
SELECT DISTINCT doc_id AS query_id, value FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.doc_id - 1 = v.doc_id AND w.value = v.value)""",
    "k8_citation_scores": """WITH e AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS i FROM lineitem WHERE l_linenumber <= 3), c AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS i FROM lineitem WHERE l_quantity > 20),
s AS (SELECT q, (SELECT count(*) FROM e WHERE e.q = o.q) AS want, (SELECT count(*) FROM c WHERE c.q = o.q) AS got, (SELECT count(*) FROM e JOIN c ON c.q = e.q AND c.i = e.i WHERE e.q = o.q) AS tp FROM (SELECT q FROM e UNION SELECT q FROM c) o),
r AS (SELECT q, CASE WHEN got > 0 THEN tp / got ELSE 0 END AS p, CASE WHEN want > 0 THEN tp / want ELSE 1 END AS r FROM s)
SELECT q AS query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""",
    "k8_retrieval_metrics": f"WITH {NEAR} SELECT count(*) AS queries, 1.0::DOUBLE AS recall, round(avg(1.0::DOUBLE / n), 6) AS precision, 1.0::DOUBLE AS mrr FROM (SELECT query_id, count(*) AS n FROM top GROUP BY query_id)",
}
