"""Retrieval queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import text
from ..operators import ratings, retrieval as rt
from ..params import SearchParams
from ..session import cut, scratch_path
from ..sources import stores
from . import tables as t
from .registry import cte, query

P = SearchParams()
# Asks for more survivors than one pass yields, so that deepening happens.
DEEP = SearchParams(min_survivors=9)
DENSE_ONLY = SearchParams(active_paths=("dense",))

SIM = "round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(q.dense, c.dense))), 12)"
cte("dense_all", f"SELECT q.query_id, c.pk, {SIM} AS score FROM queries_t q CROSS JOIN vectors_t c")
cte(
    "sparse_all",
    """SELECT q.query_id, p.pk, sum(q.weight * p.weight) AS score FROM query_postings_t q JOIN postings p ON p.term = q.term
    GROUP BY q.query_id, p.pk""",
)
cte(
    "scored_unseen",
    """SELECT query_id, 'dense' AS path, pk, score FROM dense_all a WHERE NOT EXISTS
    (SELECT 1 FROM seen_t s WHERE s.query_id = a.query_id AND s.pk = a.pk)
    UNION ALL SELECT query_id, 'sparse', pk, score FROM sparse_all a WHERE NOT EXISTS
    (SELECT 1 FROM seen_t s WHERE s.query_id = a.query_id AND s.pk = a.pk)""",
)
cte(
    "hits_t",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, pk) AS rank FROM scored_unseen)
    WHERE rank <= 80""",
)
cte("attempt_t", "SELECT * FROM (VALUES (1, 20), (2, 40), (3, 80)) v(attempt, lim)")
STRIPPED = r"length(regexp_replace(regexp_replace(c.chunk_content, '^\s+', ''), '\s+$', ''))"


def pool_sql(name: str, active: str, min_survivors: int) -> None:
    """Fusion, gates and the attempts log for one parameter set."""
    cte(
        f"{name}_pool",
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, attempt ORDER BY round(rrf, 12) DESC, first) AS fused_rank FROM
        (SELECT h.query_id, a.attempt, a.lim, h.pk, sum(1.0::DOUBLE / (60 + h.rank)) FILTER (path IN ({active})) AS rrf,
        min(CASE path WHEN 'dense' THEN 0 ELSE 1000000 END + h.rank) FILTER (path IN ({active})) AS first,
        string_agg(path, ',' ORDER BY path) FILTER (path IN ({active})) AS source_paths,
        coalesce(max(score) FILTER (path = 'dense'), 0.0) AS score_dense, coalesce(max(score) FILTER (path = 'sparse'), 0.0) AS score_sparse
        FROM hits_t h JOIN attempt_t a ON h.rank <= a.lim GROUP BY h.query_id, a.attempt, a.lim, h.pk) WHERE rrf IS NOT NULL)
        WHERE fused_rank <= greatest(20, lim)""",
    )
    cte(
        f"{name}_gated",
        f"""SELECT *, CASE WHEN NOT ok THEN 'short' WHEN place > 10 THEN 'cut' WHEN nth > 1 THEN 'duplicate' ELSE 'kept' END AS outcome FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id, attempt, sample_id, ok AND place <= 10 ORDER BY fused_rank) AS nth FROM
        (SELECT *, sum(ok::INT) OVER (PARTITION BY query_id, attempt ORDER BY fused_rank) AS place FROM
        (SELECT p.*, c.sample_id, c.counselor_id, c.term, c.chunk_content, c.chunk_seq, {STRIPPED} >= 50 AS ok
        FROM {name}_pool p JOIN corpus c ON c.pk = p.pk)))""",
    )
    cte(
        f"{name}_log",
        f"""SELECT * FROM (SELECT *, coalesce(min(CASE WHEN met THEN attempt END) OVER (PARTITION BY query_id), 3) AS final_attempt FROM
        (SELECT query_id, attempt, lim AS per_path_limit, count(*) AS fused_hit_count,
        count(*) FILTER (outcome = 'short') AS filtered_short_chunk, count(*) FILTER (outcome = 'duplicate') AS filtered_duplicate_sample,
        count(*) FILTER (outcome = 'kept') AS survivors, count(*) FILTER (outcome = 'kept') >= {min_survivors} AS met
        FROM {name}_gated GROUP BY query_id, attempt, lim)) WHERE attempt <= final_attempt""",
    )
    cte(
        f"{name}_evidence",
        f"""SELECT g.query_id, row_number() OVER (PARTITION BY g.query_id ORDER BY fused_rank) AS rank, g.pk,
        g.sample_id || '_C' || lpad(g.chunk_seq::VARCHAR, 7, '0') AS chunk_id, g.chunk_content, g.sample_id, g.counselor_id, g.term,
        g.source_paths, g.score_dense, g.score_sparse, g.rrf, g.fused_rank
        FROM {name}_gated g JOIN {name}_log l ON l.query_id = g.query_id AND l.attempt = g.attempt AND l.attempt = l.final_attempt
        WHERE g.outcome = 'kept'""",
    )


pool_sql("plain", "'dense', 'sparse'", P.min_survivors)
pool_sql("deep", "'dense', 'sparse'", DEEP.min_survivors)
pool_sql("single", "'dense'", P.min_survivors)


def hits(spark, d):
    """Both paths at the deepest attempt, probed once."""
    return rt.probe(t.vectors(spark, d), t.sparse(spark, d), t.queries(spark, d), P.max_depth, t.seen(spark, d))


def result(spark, d, p=P):
    return rt.search(t.corpus(spark, d), t.sparse(spark, d), t.queries(spark, d), t.seen(spark, d), p, dense=t.vectors(spark, d))


@query(
    "corpus_scan",
    "SELECT pk, sample_id, counselor_id, term, length(chunk_content) AS n_chars, chunk_seq::BIGINT AS chunk_seq FROM corpus",
)
def corpus_scan(spark, d):
    path = scratch_path(spark, "corpus")
    t.corpus(spark, d).write.parquet(path)
    return stores.read_corpus(spark, path).select(
        "pk", "sample_id", "counselor_id", "term", F.length("chunk_content").alias("n_chars"), "chunk_seq"
    )


@query("dim_violations", "SELECT vec_id AS pk, len(embedding)::BIGINT AS dim FROM embeddings WHERE len(embedding) <> 64 OR embedding IS NULL")
def dim_violations(spark, d):
    from ..operators.modelling import same_dimension

    return same_dimension(t.vectors(spark, d), 64)


@query(
    "embedding_lookup",
    """SELECT vec_id AS pk, len(embedding)::BIGINT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings
    WHERE vec_id IN (SELECT doc_id FROM labels)""",
)
def embedding_lookup(spark, d):
    keys = t.load(spark, d, "labels").select(F.col("doc_id").alias("pk"))
    return stores.lookup(t.vectors(spark, d), keys).select(
        "pk", F.size("dense").alias("dim"), F.aggregate("dense", F.lit(0.0), lambda s, x: s + x).alias("total")
    )


@query("missing_keys", "SELECT DISTINCT doc_id AS pk FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_keys(spark, d):
    return stores.missing_keys(t.vectors(spark, d), t.load(spark, d, "labels").select(F.col("doc_id").alias("pk")))


@query(
    "content_lookup",
    "SELECT doc_id AS pk, length(text) AS n_chars, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND text IS NOT NULL",
)
def content_lookup(spark, d):
    content = t.load(spark, d, "documents").select(F.col("doc_id").alias("pk"), F.col("text").alias("original_content"))
    keys = t.load(spark, d, "labels").select(F.col("doc_id").alias("pk"))
    return stores.content_lookup(content, keys).select(
        "pk", F.length("original_content").alias("n_chars"), F.md5("original_content").alias("digest")
    )


@query(
    "dense_topk",
    """SELECT query_id, path, pk, round(score, 6) AS score, rank FROM (SELECT query_id, 'dense' AS path, pk, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) AS rank FROM dense_all) WHERE rank <= 20""",
)
def dense_topk(spark, d):
    return rt.dense_topk(t.vectors(spark, d), t.queries(spark, d), P.per_path_limit)


SPARSE_TOPK = """SELECT query_id, path, pk, score, rank FROM (SELECT query_id, 'sparse' AS path, pk, score,
row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) AS rank FROM sparse_all) WHERE rank <= 20"""


@query("sparse_topk", SPARSE_TOPK)
def sparse_topk(spark, d):
    return rt.sparse_topk(t.sparse(spark, d), t.queries(spark, d), P.per_path_limit)


@query("sparse_topk_postings", SPARSE_TOPK)
def sparse_topk_postings(spark, d):
    return rt.sparse_topk_postings(t.postings(spark, d), t.query_postings(spark, d), P.per_path_limit)


@query("sparse_topk_sliced", SPARSE_TOPK)
def sparse_topk_sliced(spark, d):
    """As for more query postings than can be broadcast: they meet the postings by term and slice."""
    return rt.sparse_topk_postings(t.postings(spark, d), t.query_postings(spark, d), P.per_path_limit, slice_rows=500, broadcast_bytes=0)


@query("seen_exclusion", "SELECT query_id, path, pk, round(score, 6) AS score, rank FROM hits_t WHERE rank <= 20")
def seen_exclusion(spark, d):
    return rt.probe(t.vectors(spark, d), t.sparse(spark, d), t.queries(spark, d), P.per_path_limit, t.seen(spark, d))


@query("probe_only", "SELECT query_id, path, pk, round(score, 6) AS score, rank FROM hits_t")
def probe_only(spark, d):
    return hits(spark, d)


cte(
    "probe_stats_t",
    """SELECT g.query_id, g.path, g.path = 'sparse' AND g.query_id NOT IN (SELECT query_id FROM query_postings_t) AS skipped,
    coalesce(s.hit_count, 0) AS hit_count, s.score_min, s.score_max, s.score_mean, s.top3_pks,
    coalesce(x.n, 0) AS filtered_by_seen FROM (SELECT query_id, unnest(['dense', 'sparse']) AS path FROM queries_t) g
    LEFT JOIN (SELECT query_id, path, count(*) AS hit_count, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max,
      round(avg(score), 6) AS score_mean, string_agg(pk, ',' ORDER BY rank) FILTER (rank <= 3) AS top3_pks
      FROM hits_t WHERE rank <= 20 GROUP BY query_id, path) s ON s.query_id = g.query_id AND s.path = g.path
    LEFT JOIN (SELECT query_id, count(*) AS n FROM seen_t GROUP BY query_id) x ON x.query_id = g.query_id""",
)


def stats(spark, d):
    found = hits(spark, d).where(F.col("rank") <= P.per_path_limit)
    return rt.probe_stats(found, t.queries(spark, d), t.seen(spark, d))


@query("probe_stats", "SELECT * FROM probe_stats_t")
def probe_stats(spark, d):
    return stats(spark, d)


@query(
    "path_health",
    """SELECT query_id, dead AS dead_paths, CASE dead WHEN 2 THEN 'dead' WHEN 1 THEN 'single_path' ELSE 'ok' END AS status,
    CASE WHEN dead = 1 THEN live END AS only_path FROM (SELECT query_id, count(*) FILTER (skipped OR hit_count = 0) AS dead,
    max(path) FILTER (NOT (skipped OR hit_count = 0)) AS live FROM probe_stats_t GROUP BY query_id)""",
)
def path_health(spark, d):
    return rt.require_live_path(stats(spark, d))


@query(
    "depth_accounting",
    """SELECT query_id, path, 20::BIGINT AS per_path_limit, CASE WHEN skipped THEN 'skipped' WHEN hit_count = 0 AND filtered_by_seen > 0 THEN 'exhausted'
    WHEN hit_count = 0 THEN 'empty' ELSE 'new' END AS state, filtered_by_seen,
    CASE WHEN NOT skipped AND hit_count > 0 THEN filtered_by_seen + 1 END AS first_rank,
    CASE WHEN NOT skipped AND hit_count > 0 THEN filtered_by_seen + hit_count END AS last_rank FROM probe_stats_t""",
)
def depth_accounting(spark, d):
    return ratings.depth_accounting(stats(spark, d), P.per_path_limit)


@query(
    "rrf_fuse",
    """SELECT query_id, pk, round(rrf, 6) AS rrf, source_paths, round(score_dense, 6) AS score_dense, score_sparse,
    fused_rank FROM plain_pool WHERE attempt = 1""",
)
def rrf_fuse(spark, d):
    found = hits(spark, d).where(F.col("rank") <= P.per_path_limit)
    pool = rt.fuse(found, P.rrf_k, P.active_paths)
    limit = max(2 * P.top_k, P.per_path_limit)
    return pool.where(F.col("fused_rank") <= limit).select(
        "query_id", "pk", "rrf", "source_paths", "score_dense", "score_sparse", "fused_rank"
    )


@query(
    "evidence_assembly",
    """SELECT g.query_id, g.fused_rank, g.pk, g.sample_id || '_C' || lpad(g.chunk_seq::VARCHAR, 7, '0') AS chunk_id, g.sample_id,
    g.counselor_id, g.term, g.source_paths, round(g.score_dense, 6) AS score_dense, g.score_sparse FROM plain_gated g WHERE attempt = 1""",
)
def evidence_assembly(spark, d):
    pool = rt.fuse(hits(spark, d).where(F.col("rank") <= P.per_path_limit), P.rrf_k)
    pool = cut(pool.where(F.col("fused_rank") <= max(2 * P.top_k, P.per_path_limit)))
    return rt.with_fields(pool, rt.fields_of(pool, t.corpus(spark, d))).select(
        "query_id", "fused_rank", "pk", text.display_id(F.col("sample_id"), F.col("chunk_seq"), F.col("pk")).alias("chunk_id"),
        "sample_id", "counselor_id", "term", "source_paths", "score_dense", "score_sparse",
    )


@query(
    "short_chunk_gate",
    rf"SELECT pk, length(chunk_content) AS n_chars FROM corpus c WHERE {STRIPPED} >= 50",
)
def short_chunk_gate(spark, d):
    return t.corpus(spark, d).where(rt.long_enough(F.col("chunk_content"), P.min_chunk_chars)).select(
        "pk", F.length("chunk_content").alias("n_chars")
    )


def first_attempt(spark, d, p=P):
    pool = rt.fuse(hits(spark, d).where(F.col("rank") <= p.per_path_limit), p.rrf_k, p.active_paths)
    pool = cut(pool.where(F.col("fused_rank") <= max(2 * p.top_k, p.per_path_limit)))
    return rt.gate(rt.with_fields(pool, rt.fields_of(pool, t.corpus(spark, d))), p)


@query(
    "sample_dedup_gate",
    "SELECT query_id, pk, sample_id, fused_rank, outcome FROM plain_gated WHERE attempt = 1",
)
def sample_dedup_gate(spark, d):
    return first_attempt(spark, d).select("query_id", "pk", "sample_id", "fused_rank", "outcome")


@query(
    "gate_counts",
    """SELECT query_id, count(*) AS fused_hit_count, count(*) FILTER (outcome = 'short') AS filtered_short_chunk,
    count(*) FILTER (outcome = 'duplicate') AS filtered_duplicate_sample, count(*) FILTER (outcome = 'kept') AS survivors
    FROM plain_gated WHERE attempt = 1 GROUP BY query_id""",
)
def gate_counts(spark, d):
    return rt.gate_counts(first_attempt(spark, d))


EVIDENCE = """query_id, rank, pk, chunk_id, sample_id, counselor_id, term, source_paths, round(score_dense, 6) AS score_dense,
score_sparse, round(rrf, 6) AS rrf"""
EVIDENCE_COLUMNS = (
    "query_id", "rank", "pk", "chunk_id", "sample_id", "counselor_id", "term", "source_paths", "score_dense", "score_sparse", "rrf",
)


@query("hybrid_search", f"SELECT {EVIDENCE} FROM plain_evidence")
def hybrid_search(spark, d):
    return result(spark, d).evidence.select(*EVIDENCE_COLUMNS)


@query("inactive_path_search", f"SELECT {EVIDENCE} FROM single_evidence")
def inactive_path_search(spark, d):
    return result(spark, d, DENSE_ONLY).evidence.select(*EVIDENCE_COLUMNS)


@query(
    "auto_deepen",
    """SELECT query_id, attempt::BIGINT AS attempt, per_path_limit::BIGINT AS per_path_limit, fused_hit_count, filtered_short_chunk,
    filtered_duplicate_sample, survivors, met, attempt = final_attempt AS final FROM deep_log""",
)
def auto_deepen(spark, d):
    return result(spark, d, DEEP).attempts


cte(
    "candidates_t",
    """SELECT * FROM (SELECT h.query_id, h.path, h.rank AS rank_in_path, h.pk, h.score, c.sample_id, c.chunk_seq,
    row_number() OVER (PARTITION BY h.query_id, h.path, c.sample_id ORDER BY h.rank) AS nth
    FROM hits_t h JOIN corpus c ON c.pk = h.pk WHERE h.rank <= 3
    AND NOT EXISTS (SELECT 1 FROM single_evidence e WHERE e.query_id = h.query_id AND e.pk = h.pk)
    AND NOT EXISTS (SELECT 1 FROM single_evidence e WHERE e.query_id = h.query_id AND e.sample_id = c.sample_id)) WHERE nth = 1""",
)


@query(
    "path_candidates",
    """SELECT query_id, path, rank_in_path, pk, sample_id || '_C' || lpad(chunk_seq::VARCHAR, 7, '0') AS chunk_id, sample_id,
    round(score, 6) AS score FROM candidates_t""",
)
def path_candidates(spark, d):
    return result(spark, d, DENSE_ONLY).candidates.select("query_id", "path", "rank_in_path", "pk", "chunk_id", "sample_id", "score")


@query(
    "drop_previews",
    rf"""WITH pool AS (SELECT *, row_number() OVER (PARTITION BY query_id, dropped ORDER BY rank) AS fused_rank FROM
      (SELECT h.query_id, d.dropped, h.pk, h.rank FROM hits_t h JOIN (VALUES ('dense'), ('sparse')) d(dropped) ON d.dropped <> h.path
      WHERE h.rank <= 20)),
    ok AS (SELECT p.*, c.sample_id, row_number() OVER (PARTITION BY query_id, dropped, c.sample_id ORDER BY fused_rank) AS nth
      FROM pool p JOIN corpus c ON c.pk = p.pk WHERE fused_rank <= 20 AND {STRIPPED} >= 50),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, dropped ORDER BY fused_rank) AS place FROM ok WHERE nth = 1)
      WHERE place <= 10),
    side AS (SELECT k.query_id, k.dropped, list(k.pk ORDER BY place) AS preview FROM kept k GROUP BY 1, 2)
    SELECT s.query_id, s.dropped, array_to_string(preview, ',') AS preview,
    array_to_string(list_sort([x FOR x IN e.actual IF NOT list_contains(preview, x)]), ',') AS lost,
    array_to_string(list_sort([x FOR x IN preview IF NOT list_contains(e.actual, x)]), ',') AS gained
    FROM side s JOIN (SELECT query_id, list(pk ORDER BY rank) AS actual FROM plain_evidence GROUP BY query_id) e ON e.query_id = s.query_id""",
)
def drop_previews(spark, d):
    found = result(spark, d)
    return rt.drop_previews(found.hits, found.fields, P, found.evidence)


# Spans of the evidence: the first lines of a chunk; short chunks stand for failed extraction.
SPAN_SQL = "CASE WHEN length(chunk_content) < 400 THEN NULL ELSE range(0, least(len(string_split(chunk_content, chr(10))), pk % 6)) END"


def with_spans(rows):
    n = F.least(F.size(text.lines(F.col("chunk_content"))).cast("long"), F.col("pk") % 6)
    idx = F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: i < n), lambda i: i)
    return rows.withColumn("span_line_indices", F.when(F.length("chunk_content") >= 400, idx))


@query(
    "extraction_drop",
    f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, pk, array_to_string(idx, ',') AS span_line_indices
    FROM (SELECT *, {SPAN_SQL} AS idx FROM plain_evidence) WHERE idx IS NOT NULL""",
)
def extraction_drop(spark, d):
    return rt.drop_failed_spans(with_spans(result(spark, d).evidence)).select("query_id", "rank", "pk", "span_line_indices")


@query(
    "span_hist",
    f"""WITH r AS (SELECT counselor_id, {SPAN_SQL} AS idx FROM corpus),
    n AS (SELECT counselor_id, len(idx) AS span_length, count(*) AS n FROM r WHERE idx IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT counselor_id, unnest(range(0, 4)) AS span_length FROM (SELECT DISTINCT counselor_id FROM r)
      UNION SELECT counselor_id, span_length FROM n)
    SELECT g.counselor_id, g.span_length::BIGINT AS span_length, coalesce(n.n, 0) AS n, x.dropped FROM g
    LEFT JOIN n ON n.counselor_id = g.counselor_id AND n.span_length = g.span_length
    JOIN (SELECT counselor_id, count(*) FILTER (idx IS NULL) AS dropped FROM r GROUP BY 1) x ON x.counselor_id = g.counselor_id""",
)
def span_hist(spark, d):
    return rt.span_histogram(with_spans(t.corpus(spark, d)), ("counselor_id",))
