"""op7: repeated lines of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines
from .common import table


def op7_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(F.col("row_.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("kept_", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op7_line_join": op7_line_join}

#: The lines that go, as common table expressions over ``documents``; also used for the pipeline.
GONE = r"""
l AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS body FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
s AS (SELECT * FROM (SELECT doc_id, i, list_distinct(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS w FROM l) WHERE len(w) >= 1),
tokens AS (SELECT doc_id, i, len(w) AS n, unnest(w) AS t FROM s),
frequency AS (SELECT t, count(*) AS f FROM tokens GROUP BY t),
ranked AS (SELECT doc_id, i, n, t, row_number() OVER (PARTITION BY doc_id, i ORDER BY f, t) AS r FROM tokens JOIN frequency USING (t)),
prefix AS (SELECT * FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
near AS (
  SELECT DISTINCT a.doc_id, a.i, b.doc_id AS doc2, b.i AS i2 FROM prefix a JOIN prefix b ON a.t = b.t AND (b.doc_id, b.i) < (a.doc_id, a.i)
  AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
gone AS (
  SELECT DISTINCT doc_id, i FROM (
    SELECT near.doc_id, near.i, len(list_intersect(x.w, y.w)) AS c, len(x.w) + len(y.w) AS n
    FROM near JOIN s x ON x.doc_id = near.doc_id AND x.i = near.i JOIN s y ON y.doc_id = doc2 AND y.i = i2)
  WHERE 100 * c >= 80 * (n - c))"""

SQL = {
    "op7_line_join": f"""
WITH {GONE}
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(gone.i)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id
"""
}
