"""op11: groups of equal texts of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact
from .common import table


def op11_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.verdicts(table(spark, sf_dir, "documents"), keep="largest", columns=["doc_id"])
    return out.select(F.col("row_.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op11_content_hash": op11_content_hash}

SQL = {
    "op11_content_hash": """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM folded WINDOW same AS (PARTITION BY body)
"""
}
