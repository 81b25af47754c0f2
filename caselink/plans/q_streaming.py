"""Streaming queries: the given tables arrive as streams and are run to their end; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselink.operators.urls import url_parts
from caselink.plans.q_urls import PARTS, SCORE
from caselink.plans.tables import table
from caselink.session import new_path
from caselink.streaming import jobs
from caselink.streaming.versions import read_version


def _stream(spark, d, name):
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    # a single file is read through its folder, by name
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    fs = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    return reader.parquet(f"{d}/{name}.parquet") if fs.getFileStatus(whole).isDirectory() else spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def s1_stream_score(spark, d):
    pages = _stream(spark, d, "pages").select("page_id", "url")
    listed = url_parts(table(spark, d, "pages").where("url like '%/fr/%'").select("url")).select(F.col("host").alias("indicator")).distinct().withColumn("verdict", F.lit("listed"))
    return jobs.drain(jobs.stream_score(pages, listed), "s1")


def s2_stream_first_seen(spark, d):
    docs = _stream(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.md5("text").alias("hash"))
    return jobs.drain(jobs.stream_first_seen(docs), "s2")


def s3_stream_sync(spark, d):
    target = new_path(spark, "s3")
    docs = _stream(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.md5("text").alias("digest"))
    jobs.stream_sync(docs, target).awaitTermination()
    return read_version(spark, target)


QUERIES = {k: f for k, f in globals().items() if k[0] == "s" and k[1].isdigit()}
ORACLES = {
    "s1_stream_score": f"""
WITH {PARTS}, {SCORE}, l AS (SELECT DISTINCT host FROM q WHERE contains(url, '/fr/')) SELECT s.*, CASE WHEN risk_score >= 70 THEN 'malicious' WHEN risk_score >= 35 THEN 'suspicious' WHEN risk_score IS NOT NULL THEN 'benign' END AS verdict,
  CASE WHEN l.host IS NOT NULL THEN 'listed' END AS listed FROM s LEFT JOIN l ON l.host = s.host""",
    "s2_stream_first_seen": "SELECT doc_id AS file_id, md5(text) AS hash, min(doc_id) OVER (PARTITION BY text) AS original, doc_id <> min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents",
    "s3_stream_sync": "SELECT doc_id::VARCHAR AS chunk_id, md5(text) AS digest FROM documents",
}
