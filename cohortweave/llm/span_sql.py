"""DuckDB counterpart of the span scan."""

from __future__ import annotations

from .spans import Pattern


def span_rows(patterns: tuple[Pattern, ...]) -> str:
    """SELECT of doc_id, kind, ord, s, e, hit for every match in documents."""
    parts = []
    for i, p in enumerate(patterns):
        regex = p.regex.replace("'", "''")
        most = 2**31 - 1 if p.most is None else p.most
        parts.append(
            f"""SELECT doc_id, '{p.kind}' AS kind, {i} AS ord, e - length(hit) AS s, e, hit FROM (
  SELECT doc_id, hit, size, sum(gap + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM (
    SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(list_transform(gaps, lambda g: length(g))[:len(hits)]) AS gap,
           unnest(hits) AS hit, unnest(list_transform(vals, lambda v: length(v))) AS size FROM (
      SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{regex}') AS gaps,
             regexp_extract_all(coalesce(text, ''), '{regex}', 0) AS hits,
             regexp_extract_all(coalesce(text, ''), '{regex}', {p.value}) AS vals FROM documents)))
WHERE size BETWEEN {p.least} AND {most}"""
        )
    return "\nUNION ALL\n".join(parts)
