"""The library's queries over the given tables, each with equivalent plain SQL."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("search", "sessions", "harvest", "refine", "apply", "scalars", "live")


def load_all():
    from .registry import QUERIES, SQL, compose

    for group in GROUPS:
        import_module(f"{__name__}.{group}_queries")
    return QUERIES, {name: compose(sql) for name, sql in SQL.items()}
