"""op9: near-copies among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .common import table


def op9_metric_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.linked(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(F.col("row_.doc_id").alias("doc_id"), "n_shingles", "component_id")


QUERIES = {"op9_metric_jaccard": op9_metric_jaccard}

SQL = {
    "op9_metric_jaccard": r"""
WITH RECURSIVE
lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lowered),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
}
