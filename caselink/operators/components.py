"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.session import durable


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct())


def component_roots(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(node, component): every node of an edge that isn't its component's smallest node, with that smallest node.

    Each round joins on node ids only and is written to the shared folder; rounds stop when the edge set no longer
    changes, which the counts and an order-free checksum of two rounds show. Self loops and null ends are ignored.
    """
    cur = durable(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        if cur.isEmpty():
            break
        cur = durable(_small_star(_large_star(cur)), "cc")
        now = cur.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
