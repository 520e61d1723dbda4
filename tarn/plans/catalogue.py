"""All queries by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.plans import extras, fixtures, ranking, texts  # noqa: F401  they register their queries
from tarn.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.gated_rerank(spark, sf_dir)
