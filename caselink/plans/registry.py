"""Every registered query of the library with the SQL it is checked against, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselink.plans import q_cases, q_correlate, q_graph, q_metrics, q_retrieve, q_sources, q_streaming, q_text, q_timeline, q_urls
from caselink.session import ship

MODULES: list = [q_correlate, q_cases, q_timeline, q_graph, q_urls, q_text, q_metrics, q_retrieve, q_streaming, q_sources]


def _shipped(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shipped(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: sql for m in MODULES for k, sql in m.ORACLES.items()}


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return queries()["g7_correlate_pairs"](spark, sf_dir)
