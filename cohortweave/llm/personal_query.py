"""op6: personal data of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import personal
from .common import table


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op6_weak_supervision": op6_weak_supervision}
SQL: dict[str, str] = {}
