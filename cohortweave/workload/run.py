"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    cols, a = rows_of(df.columns, got)
    if sql is None:
        return f"rows-only n={len(a)}", spent, bool(a)
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    want_cols, b = rows_of(want_cols, want)
    if cols != want_cols:
        return f"COLUMNS {cols} != {want_cols}", spent, False
    if len(a) != len(b):
        return f"COUNT {len(a)} != {len(b)}; first spark {a[:2]} duck {b[:2]}", spent, False
    for x, y in zip(a, b):
        for c, p, q in zip(cols, x, y):
            same = p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 1.5e-6)
            if not same:
                return f"VALUE {c}: {p!r} != {q!r} in {str(x)[:300]} / {str(y)[:300]}", spent, False
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    spark_types = {f.name: KINDS.get(f.dataType.simpleString()) for f in df.schema}
    odd = {c: (spark_types[c], duck_types[c]) for c in cols if spark_types[c] != duck_types[c]}
    if odd:
        return f"TYPES {odd}", spent, False
    return f"ok n={len(a)}{'' if a == b else ' (rounding)'}", spent, True


def main(argv: list[str]) -> None:
    from ..session import build_session
    from . import load_all

    queries, sql = load_all()
    sf_dir = argv[0]
    wanted = argv[1:] or list(queries)
    spark = build_session(cpus=8)
    con = duck(sf_dir)
    bad = 0
    for name in wanted:
        for full in [n for n in queries if n == name or (name.endswith("*") and n.startswith(name[:-1]))]:
            try:
                message, spent, ok = compare(spark, con, full, queries[full], sql.get(full), sf_dir)
            except Exception as exc:  # report and go on
                message, spent, ok = f"ERROR {type(exc).__name__} {str(exc)[:1500]}", 0.0, False
            bad += not ok
            print(f"{'  ' if ok else '! '}{full:28s} {spent:6.2f}s {message}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
