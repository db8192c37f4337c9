"""The operators over their whole tables, as the entry point registers them."""

from __future__ import annotations

from importlib import import_module

#: One module per operator; each has QUERIES and SQL.
MODULES = (
    "packing_query",
    "lattice_query",
    "bpe_query",
    "secret_query",
    "substring_query",
    "personal_query",
    "lines_query",
    "warc_query",
    "jaccard_query",
    "quality_query",
    "exact_query",
    "middle_query",
    "collocation_query",
)


def load_all():
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"{__package__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
