"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as sql_functions, text, vectors
from ..operators import judging
from . import tables as t
from .registry import cte, query

# Transcripts: the lines of each conversation in turn order.
cte(
    "transcripts_t",
    "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, count(*) AS n_turns FROM conversations GROUP BY conv_id",
)


def transcripts(spark, d):
    rows = t.load(spark, d, "conversations").withColumn("line", F.concat("role", F.lit(": "), "text"))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n").alias("body"),
        F.count("*").alias("n_turns"),
    )


@query(
    "l2_normalise",
    """SELECT vec_id AS pk, round(list_sum([x * x FOR x IN u]), 6) AS size, round(u[1], 6) AS first FROM
    (SELECT vec_id, [x / n FOR x IN v] AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings))""",
)
def l2_normalise(spark, d):
    unit = t.vectors(spark, d).select("pk", vectors.l2_normalise(F.col("dense")).alias("u"))
    return unit.select("pk", vectors.dot(F.col("u"), F.col("u")).alias("size"), F.element_at("u", 1).alias("first"))


@query("chunk_display_id", "SELECT doc_id AS pk, source || '_C' || lpad(doc_id::VARCHAR, 7, '0') AS chunk_id, source || '_C' || doc_id AS text_key_id FROM documents")
def chunk_display_id(spark, d):
    docs = t.load(spark, d, "documents")
    none = F.lit(None).cast("int")
    seq = F.when(F.col("lang") == "en", F.col("doc_id").cast("int"))
    return docs.select(
        F.col("doc_id").alias("pk"),
        text.display_id(F.col("source"), seq, F.col("doc_id")).alias("chunk_id"),
        text.display_id(F.col("source"), none, F.col("doc_id"), pk_is_text=True).alias("text_key_id"),
    )


@query(
    "number_lines",
    """SELECT conv_id, md5(array_to_string(list_transform(ls, lambda x, i: '[' || (i - 1) || '] ' || x), chr(10))) AS from_zero,
    md5(array_to_string(list_transform(ls, lambda x, i: '[' || i || '] ' || x), chr(10))) AS from_one
    FROM (SELECT conv_id, string_split(body, chr(10)) AS ls FROM transcripts_t)""",
)
def number_lines(spark, d):
    body = F.col("body")
    return transcripts(spark, d).select(
        "conv_id", F.md5(text.number_lines(body, 0)).alias("from_zero"), F.md5(text.number_lines(body, 1)).alias("from_one")
    )


IDX = "[0, (n_turns // 2)::INTEGER, 5000]"


def picked(spark, d):
    return transcripts(spark, d).withColumn(
        "idx", F.array(F.lit(0), F.floor(F.col("n_turns") / 2).cast("int"), F.lit(5000))
    )


@query(
    "span_text",
    f"""SELECT conv_id, md5(array_to_string([ls[i + 1] FOR i IN {IDX} IF i < len(ls)], chr(10))) AS lenient, md5(ls[1]) AS strict
    FROM (SELECT *, string_split(body, chr(10)) AS ls FROM transcripts_t)""",
)
def span_text(spark, d):
    rows = picked(spark, d)
    return rows.select(
        "conv_id", F.md5(text.span_text(F.col("body"), F.col("idx"))).alias("lenient"),
        F.md5(text.span_text(F.col("body"), F.array(F.lit(0)), strict=True)).alias("strict"),
    )


@query(
    "sql_functions",
    f"""SELECT conv_id, md5(array_to_string([ls[i + 1] FOR i IN {IDX} IF i < len(ls)], chr(10))) AS span, round(1.0 / (60 + n_turns), 6) AS rrf,
    CASE WHEN n_turns < 3 THEN 2 ELSE least((1 - 1) // (n_turns // 3), 2) END::BIGINT AS bin, 0.0::DOUBLE AS d
    FROM (SELECT *, string_split(body, chr(10)) AS ls FROM transcripts_t)""",
)
def registered(spark, d):
    sql_functions.register(spark)
    return picked(spark, d).select(
        "conv_id",
        F.expr("md5(span_text(body, idx))").alias("span"),
        F.expr("rrf_score(60, CAST(n_turns AS INT))").alias("rrf"),
        F.expr("equal_count_bin(1L, n_turns, 3)").alias("bin"),
        F.expr("cosine_distance(array(1D, double(n_turns)), array(1D, double(n_turns)))").alias("d"),
    )


@query(
    "span_valid",
    """SELECT doc_id, idx_text, len(idx) <= 3 AND list_sort(list_distinct(idx)) = idx AND list_min(idx) >= 0 AND list_max(idx) < len(string_split(text, chr(10))) AS valid FROM
    (SELECT doc_id, text, idx, array_to_string(idx, ',') AS idx_text FROM
    (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN [0] WHEN 1 THEN [0, 2] WHEN 2 THEN [2, 1] ELSE [0, 1, 2, 3] END AS idx FROM documents))""",
)
def span_valid(spark, d):
    mod = F.col("doc_id") % 4

    def ints(*values):
        return F.array(*[F.lit(v) for v in values])

    idx = F.when(mod == 0, ints(0)).when(mod == 1, ints(0, 2)).when(mod == 2, ints(2, 1)).otherwise(ints(0, 1, 2, 3))
    rows = t.load(spark, d, "documents").withColumn("idx", idx)
    return rows.select(
        "doc_id", F.array_join(F.col("idx").cast("array<string>"), ",").alias("idx_text"),
        text.span_is_valid(F.col("idx"), F.col("text")).alias("valid"),
    )


@query(
    "span_union",
    """SELECT doc_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL THEN array_to_string(b, ',') WHEN b IS NULL THEN array_to_string(a, ',')
    ELSE array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') END AS indices,
    CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL THEN 'b' || doc_id WHEN b IS NULL THEN 'a' ELSE '[primary] a || [secondary] b' || doc_id END AS reason FROM
    (SELECT doc_id, CASE WHEN lang <> 'fr' AND source NOT LIKE '%3' THEN [2, doc_id % 5] END AS a, CASE WHEN source NOT LIKE '%3' AND lang <> 'de' THEN [doc_id % 3, 2] END AS b FROM documents)
    WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def span_union(spark, d):
    docs = t.load(spark, d, "documents")
    three = F.col("source").like("%3")
    a = F.when((F.col("lang") != "fr") & ~three, F.array(F.lit(2).cast("long"), F.col("doc_id") % 5))
    b = F.when(~three & (F.col("lang") != "de"), F.array(F.col("doc_id") % 3, F.lit(2).cast("long")))
    ra = F.when(a.isNotNull(), F.lit("a"))
    rb = F.when(b.isNotNull(), F.concat(F.lit("b"), "doc_id"))
    return docs.select(
        "doc_id", text.union_spans(a, b).alias("indices"), text.merged_reason(ra, rb).alias("reason")
    ).where("indices IS NOT NULL")


@query(
    "first_lines",
    r"""SELECT doc_id, coalesce(nullif(array_to_string(([s FOR s IN [regexp_replace(regexp_replace(l, '^\s+', ''), '\s+$', '') FOR l IN string_split(text, chr(10))]
    IF s <> ''])[1:3], ' / '), ''), '(empty)') AS head FROM documents""",
)
def first_lines(spark, d):
    return t.load(spark, d, "documents").select("doc_id", text.first_lines(F.col("text"), 3).alias("head"))


@query("cache_key", "SELECT doc_id, sha256(to_json(['m', 'v1', lang, text])::VARCHAR) AS cache_key FROM documents")
def cache_key(spark, d):
    return t.load(spark, d, "documents").select(
        "doc_id", text.cache_key(F.lit("m"), F.lit("v1"), F.col("lang"), F.col("text")).alias("cache_key")
    )


@query("sparse_keys", "SELECT pk, sum(length(term)) ::BIGINT AS key_sum, round(sum(weight), 6) AS weight FROM (SELECT pk, length(term) AS len, min(term) AS term, sum(weight) AS weight FROM postings GROUP BY 1, 2) GROUP BY pk")
def sparse_keys(spark, d):
    """Sparse vectors with text keys (here: word lengths) become integer-keyed."""
    per = t.postings(spark, d).groupBy("pk", F.length("term").cast("string").alias("k")).agg(F.sum("weight").alias("w"))
    maps = per.groupBy("pk").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("sparse"))
    whole = maps.withColumn("sparse", text.int_keys(F.col("sparse")))
    return whole.select(
        "pk", F.aggregate(F.map_keys("sparse"), F.lit(0), lambda s, k: s + k).alias("key_sum"),
        F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda s, w: s + w).alias("weight"),
    )


# Raw judge answers of every kind, by the chunk's id and length, citing its own lines.
KIND = "(label + 10 * (length(chunk_content) % 2))"


def answers(spark, d):
    lines = F.size(text.lines(F.col("chunk_content")))
    made = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    keep = '{"verdict": "KEEP", "evidence_line_indices": '
    kinds = {
        0: made(keep, '[1], "failed_check": null, "reason": "fine"}'),
        1: made('<think>maybe {"x": 1}</think>\n {"verdict": "DROP", "evidence_line_indices": [1], "failed_check": "check_1"} '),
        2: made("Sure: ", keep, '[1], "reason": "ok ', F.col("pk"), '"} done'),
        3: made(keep, '[1], "score": 3}'),
        4: made(keep, "[3, 1, 3, 2, 9]}"),
        5: made(keep, "[999999]}"),
        6: made(keep, '[1], "failed_check": "check_1"}'),
        7: made('{"verdict": "DROP", "evidence_line_indices": [1]}'),
        8: made('{"verdict": "DROP", "evidence_line_indices": [1], "failed_check": "check_9"}'),
        9: made("no json here"),
        10: made(keep, "[1]} trailing words"),
        11: made(keep, "[1]}", keep, "[1]}"),
        12: made("{'verdict': 'KEEP', 'evidence_line_indices': [1]}"),
        13: made(keep, '[1], "reason": 5}'),
        14: made(keep, "[", lines, ".0]}"),
        15: made(keep, '["', lines, '"]}'),
        16: made(keep, '["a", 1, 2, 3]}'),
        17: made(keep, "[", lines, "]}"),
        18: made(keep, "[", lines + 1, "]}"),
        19: made(keep, '[1], "reason": "', F.repeat(F.lit("x"), 501), '"}'),
    }
    kind = F.expr(KIND)
    raw = F.coalesce(*[F.when(kind == k, v) for k, v in kinds.items()])
    return t.corpus(spark, d).select("pk", "chunk_content", "label", raw.alias("raw"))


def parsed(spark, d):
    return judging.parse_verdicts(answers(spark, d), F.array(*[F.lit(f"check_{i}") for i in range(3)]))


@query(
    "verdict_parse",
    f"""SELECT pk, CASE WHEN {KIND} IN (1, 7, 8) THEN 'DROP' WHEN {KIND} NOT IN (9, 10, 11, 12) THEN 'KEEP' END AS verdict,
    CASE WHEN {KIND} IN (1, 6) THEN 'check_1' WHEN {KIND} = 8 THEN 'check_9' END AS failed_check,
    CASE {KIND} WHEN 0 THEN 'fine' WHEN 2 THEN 'ok ' || pk WHEN 19 THEN repeat('x', 501) ELSE '' END AS reason FROM corpus""",
)
def verdict_parse(spark, d):
    return parsed(spark, d).select("pk", "verdict", "failed_check", "reason")


@query(
    "verdict_contract",
    f"""SELECT pk, CASE WHEN {KIND} = 3 THEN 'unknown_key'
    WHEN {KIND} IN (4, 16) AND len(string_split(chunk_content, chr(10))) < 3 THEN 'evidence_range'
    WHEN {KIND} IN (5, 18) THEN 'evidence_range' WHEN {KIND} = 6 THEN 'keep_with_check' WHEN {KIND} = 7 THEN 'drop_without_check'
    WHEN {KIND} = 8 THEN 'unknown_check' WHEN {KIND} = 9 THEN 'no_json' WHEN {KIND} IN (10, 11, 12) THEN 'invalid_json'
    WHEN {KIND} = 13 THEN 'bad_type' WHEN {KIND} = 19 THEN 'reason_too_long' END AS breach FROM corpus""",
)
def verdict_contract(spark, d):
    return parsed(spark, d).select("pk", "breach")


@query(
    "evidence_salvage",
    f"""SELECT pk, CASE WHEN {KIND} IN (4, 16) THEN '1,2,3' WHEN {KIND} = 5 THEN '999999' WHEN {KIND} IN (9, 10, 11, 12) THEN NULL
    WHEN {KIND} IN (14, 15, 17) THEN len(string_split(chunk_content, chr(10)))::VARCHAR
    WHEN {KIND} = 18 THEN (len(string_split(chunk_content, chr(10))) + 1)::VARCHAR ELSE '1' END AS evidence FROM corpus""",
)
def evidence_salvage(spark, d):
    return parsed(spark, d).select("pk", F.col("evidence_line_indices").alias("evidence"))


@query(
    "evidence_zero_based",
    "SELECT conv_id, array_to_string([i - 1 FOR i IN [0, 1, n_turns, -3] IF i >= 1], ',') AS evidence FROM transcripts_t",
)
def evidence_zero_based(spark, d):
    idx = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("n_turns"), F.lit(-3).cast("long"))
    return transcripts(spark, d).select("conv_id", text.zero_based(idx).alias("evidence"))
