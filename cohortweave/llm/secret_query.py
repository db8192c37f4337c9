"""op4: secrets of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import secret_scan
from .common import table
from .span_sql import span_rows


def op4_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op4_credential_links": op4_credential_links}

_ROLE = "CASE {0}.kind WHEN 'access' THEN 'id' WHEN 'identifier' THEN 'id' WHEN 'endpoint' THEN 'endpoint' ELSE 'secret' END"

SQL = {
    "op4_credential_links": f"""
WITH parts AS ({span_rows(secret_scan.PATTERNS)}),
roled AS (SELECT *, {_ROLE.format("parts")} AS role FROM parts),
spans AS (
  SELECT doc_id, kind, ord, s, e FROM roled WHERE ord < 3
  UNION ALL
  SELECT doc_id, kind, ord, s, e FROM roled a WHERE ord >= 3 AND EXISTS (
    SELECT 1 FROM roled b WHERE b.doc_id = a.doc_id AND b.s < a.e + 200 AND b.e > a.s - 200
      AND (b.e <= a.s OR b.s >= a.e)
      AND CASE WHEN a.role = 'secret' THEN b.role <> 'secret' ELSE b.role = 'secret' END)),
grouped AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e) FILTER (ord < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN grouped USING (doc_id)
"""
}
