"""op10: quality rules of every document, with the verdicts on hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import table


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.measures_only(docs, ["doc_id"]).select(
        F.col("row_.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


QUERIES = {"op10_host_rules": op10_host_rules}

SQL = {
    "op10_host_rules": r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
counted AS (
  SELECT doc_id, host, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines
  FROM base),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS p FROM counted WHERE n_words >= 8)),
twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(p - before, 8))) AS n
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM twice) GROUP BY doc_id),
judged AS (
  SELECT c.*, coalesce(v.n, 0) AS n_repeat_words,
         n_words < 20 OR 100 * coalesce(v.n, 0) > 30 * n_words AS base_failed
  FROM counted c LEFT JOIN covered v USING (doc_id)),
failing AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed FROM judged),
hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (failed) AS k FROM failing GROUP BY host),
moments AS (
  SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM hosts),
prior AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 10 END AS s FROM moments),
condemned AS (
  SELECT host FROM hosts, prior WHERE (k + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (failed AND host IN (SELECT host FROM condemned)) AS kept
FROM failing
"""
}
