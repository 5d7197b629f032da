"""Catalogue entry point: every query plus its oracle, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans import queries as _queries  # noqa: F401  (registers queries)
from riskloom.plans.oracle import ORACLE
from riskloom.plans.queries import QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["history_top30"](spark, sf_dir) if "history_top30" in QUERIES else QUERIES["score_employees"](spark, sf_dir)


__all__ = ["QUERIES", "ORACLE", "flagship"]
