"""Registration of queries and composition of their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def compose(select: str) -> str:
    """Prefix ``select`` with the common table expressions it needs, each after those it uses."""
    ordered: list[str] = []

    def visit(text: str, skip: str = "") -> None:
        for name in CTES:
            if name != skip and name not in ordered and re.search(rf"\b{name}\b", text):
                visit(CTES[name], name)
                ordered.append(name)

    select = select.strip()
    visit(select)
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in ordered]
    if not parts:
        return select
    if select.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {select[5:]}"
    return f"WITH {', '.join(parts)} {select}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Comparable column types: long integers, doubles to six decimals, lists as text."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = F.round(col.cast("double"), 6)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
            col = F.array_join(F.transform(col, lambda v: F.format_string("%.6f", v)), ",")
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            col = F.array_join(col.cast("array<string>"), ",")
        elif isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            col = F.to_json(col)
        out.append(col.alias(field.name))
    return df.select(*out)
