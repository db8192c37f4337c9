"""op5: repeated passages of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import substring
from .common import table


def op5_count_min_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.deduplicated(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(F.col("row_.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_", 256).alias("kept_sha256"))


QUERIES = {"op5_count_min_passages": op5_count_min_passages}

SQL = {
    "op5_count_min_passages": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w WHERE len(w) >= 20),
grams AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM starts),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM grams) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words a WHERE NOT EXISTS (SELECT 1 FROM gone b WHERE b.doc_id = a.doc_id AND b.p = a.p) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
}
