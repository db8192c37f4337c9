"""op13: phrases of all documents, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocation
from .common import table


def op13_stripe_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mined(table(spark, sf_dir, "documents"))


QUERIES = {"op13_stripe_phrases": op13_stripe_phrases}

SQL = {
    "op13_stripe_phrases": r"""
WITH folded AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM folded),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM cut, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, w[s:s + k - 1] AS p, k, count(*) AS f FROM starts GROUP BY ALL HAVING k = 1 OR count(*) >= 100),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, p, k, f AS a FROM f WHERE k > 1 AND f >= 100),
inside AS (
  SELECT lang, p[s:s + j - 1] AS p, max(a) AS longer
  FROM (SELECT lang, p, a, j, unnest(range(1, k - j + 2)) AS s FROM candidates, range(2, 5) AS t(j) WHERE j < k) GROUP BY ALL),
whole AS (SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, p) WHERE i.longer IS NULL OR 100 * i.longer < 100 * a),
cuts AS (SELECT lang, p, k, a, unnest(range(1, k)) AS j FROM whole),
scores AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, n, j,
         (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.j] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.j + 1:c.k] JOIN total t ON t.lang = c.lang),
weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
named AS (SELECT *, array_to_string(p, ' ') AS phrase FROM weakest),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
}
