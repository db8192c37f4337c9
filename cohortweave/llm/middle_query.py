"""op12: all documents, rearranged for filling in the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import middle
from .common import table


def op12_wavelet_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.transformed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(
        F.col("row_.doc_id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {"op12_wavelet_middle": op12_wavelet_middle}

SQL = {
    "op12_wavelet_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || doc_id::VARCHAR) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
  FROM documents),
drawn AS (
  SELECT doc_id, body, t, len(t) AS n,
         ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
         ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d
  FROM cut),
parts AS (
  SELECT doc_id, body, n,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR c >= 50 THEN 'plain'
              WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(t[1:least(a, b)], '') AS p,
         array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(t[greatest(a, b) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""
}
