"""The same functions for SQL users, as native temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
    RETURN CASE WHEN size(a) <> size(b) THEN raise_error('vector dimensions differ')
      WHEN aggregate(a, 0D, (s, x) -> s + x * x) = 0 OR aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 1D
      ELSE 1D - greatest(-1D, least(1D, aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
        / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))))) END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION rrf_score(k INT, place INT) RETURNS DOUBLE RETURN 1D / (k + place)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION span_text(content STRING, idx ARRAY<INT>) RETURNS STRING
    RETURN array_join(transform(filter(idx, i -> i < size(split(content, '\\n', -1))),
      i -> element_at(split(content, '\\n', -1), i + 1)), '\\n')""",
    """CREATE OR REPLACE TEMPORARY FUNCTION equal_count_bin(place BIGINT, total BIGINT, bins INT) RETURNS INT
    RETURN CASE WHEN total < bins THEN bins - 1
      ELSE CAST(least((place - 1) DIV (total DIV bins), bins - 1) AS INT) END""",
)


def register(spark: SparkSession) -> None:
    for statement in DEFINITIONS:
        spark.sql(statement)
