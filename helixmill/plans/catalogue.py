"""All registered queries of the library, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixmill.plans import q_intervals, q_kmers, q_labels, q_loci, q_resample, q_scores, q_sources, q_streams  # noqa: F401
from helixmill.plans.registry import QUERIES, SQL


def entry(spark: SparkSession) -> DataFrame:
    """k-mer entropy of the smallest tables."""
    return q_kmers.a03_a09_entropy_summary(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
