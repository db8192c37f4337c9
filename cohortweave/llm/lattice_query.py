"""op2: near-duplicates among all embeddings of equal label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lattice
from .common import table


def op2_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lattice.linked(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    vec_id = F.col("row_.vec_id")
    return out.select(vec_id.alias("vec_id"), "n_links", "component_id", F.coalesce(vec_id == F.col("component_id"), F.lit(True)).alias("kept"))


QUERIES = {"op2_e8_lattice": op2_e8_lattice}

SQL = {
    "op2_e8_lattice": """
WITH RECURSIVE
v AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree USING (vec_id) LEFT JOIN least USING (vec_id)
"""
}
