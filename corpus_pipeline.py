"""A training corpus from ``documents``: reject toxic texts, keep one of each near-duplicate group, redact personal
data, mix sources to target weights, and encode.

Each stage takes all that the stage before it kept, as the columns of documents; what it decides takes effect. The last
returns token ids and the digest of what they decode to. Extra columns pass, whatever they are called. Stages keep clean documents as they are; rows with a null doc_id pass all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselink.llm.minhash_dedup import near_duplicates
from caselink.llm.mixing import mixed
from caselink.llm.pieces import piece_model, round_trip
from caselink.llm.pii import redact
from caselink.llm.toxicity import score_toxicity
from caselink.session import durable

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic, by labels of the training rows.

    Rows are told by doc_id and the digest of their text: only these go through the scoring, and the toxic ones are joined
    away afterwards.
    """
    own = docs.select("doc_id", "text", F.md5("text").alias("digest"))
    scored = score_toxicity(own, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_columns=("doc_id", "digest"))
    toxic = durable(scored.where("predicted = 1").select(F.col("row.doc_id").alias("toxic_id"), F.col("row.digest").alias("toxic_digest")).distinct(), "pipeline-toxic")
    same = docs["doc_id"].eqNullSafe(toxic["toxic_id"]) & F.md5(docs["text"]).eqNullSafe(toxic["toxic_digest"])
    return docs.join(toxic, same, "left_anti")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity of 0.8 or more), that with the smallest doc_id.

    Rows that repeat a doc_id with another text are texts of their own and stay with it; of rows equal in doc_id and
    text, the first by their other columns (as JSON) stays.
    """
    kept = near_duplicates(docs, num=80).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"))
    named = rows.where("id is not null").join(kept.select(F.col("doc_id").alias("id"), "times").hint("merge"), "id")
    repeated = F.col("times") > 1
    first = Window.partitionBy("id", F.when(repeated, F.md5("row.text"))).orderBy(F.when(repeated, F.to_json("row")))
    once = named.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("row")
    return once.unionByName(rows.where("id is null").select("row")).select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars is that of the new text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of the text they decode to, of every document of the mix."""
    both = round_trip(docs.select("doc_id", "lang", "source", "text"), piece_model())
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_each),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
