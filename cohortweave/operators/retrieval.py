"""Hybrid retrieval: per-path top-k, rank fusion, gates, candidates and previews.

Everything after the two top-k joins works on at most ``max_depth`` rows per
query and path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..params import PATHS, SearchParams
from ..session import BROADCAST_BYTES, broadcast_if_small, cut
from .blocks import MAX_BLOCK_BYTES, MAX_BLOCK_ROWS, against, matching_rows, nearest_rows

FIELDS = ("sample_id", "counselor_id", "term", "chunk_content", "chunk_seq")


def path_ord(path: Column) -> Column:
    return F.when(path == PATHS[0], 0).otherwise(1)


#: Parts in which a query's hits are ranked before the final rank, so that no task ranks what all tasks found.
RANK_PARTS = 32


def _top(scores: DataFrame, limit: int) -> DataFrame:
    best = (F.col("score").desc(), F.col("pk"))
    part = Window.partitionBy("query_id", "_part").orderBy(*best)
    parts = scores.withColumn("_part", F.pmod(F.xxhash64("pk"), F.lit(RANK_PARTS)))
    parts = parts.withColumn("_nth", F.row_number().over(part)).where(F.col("_nth") <= limit).drop("_part", "_nth")
    whole = Window.partitionBy("query_id").orderBy(*best)
    return parts.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= limit)


def unseen(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Drop what the query's session has been shown already."""
    if seen is None:
        return rows
    return rows.join(broadcast_if_small(seen.select("query_id", "pk").distinct()), ["query_id", "pk"], "left_anti")


def _with_depth(queries: DataFrame, limit: int, seen: DataFrame | None) -> DataFrame:
    if seen is None:
        return queries.withColumn("depth", F.lit(limit))
    shown = seen.groupBy("query_id").agg(F.countDistinct("pk").alias("shown"))
    return queries.join(shown, "query_id", "left").withColumn(
        "depth", (F.lit(limit) + F.coalesce("shown", F.lit(0))).cast("int")
    ).drop("shown")


def dense_topk(
    corpus: DataFrame,
    queries: DataFrame,
    limit: int,
    seen: DataFrame | None = None,
    max_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """Exact cosine top ``limit`` per query.

    Each query asks for as many extra rows as it has seen ones, so removing
    those afterwards leaves the exact unseen top.
    """
    q = _with_depth(queries.select("query_id", "dense"), limit, seen)
    types = dict(corpus.dtypes) | {"query_id": dict(q.dtypes)["query_id"]}
    near = against(
        corpus.select("pk", "dense"),
        q,
        nearest_rows,
        f"query_id {types['query_id']}, pk {types['pk']}, score double",
        block_key=["query_id"],
        max_rows=max_rows,
    )
    return _top(unseen(near, seen), limit).select("query_id", F.lit("dense").alias("path"), "pk", "score", "rank")


def sparse_topk(
    corpus: DataFrame,
    queries: DataFrame,
    limit: int,
    seen: DataFrame | None = None,
    max_rows: int = MAX_BLOCK_ROWS,
    max_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """Exact inner-product top ``limit`` per query over shared terms, map-only until the final pick.

    Both sides hold a vector per row as ``terms`` and ``weights`` lists. Queries
    without terms simply have no hits.
    """
    q = _with_depth(queries.select("query_id", "terms", "weights"), limit, seen)
    types = dict(corpus.dtypes) | {"query_id": dict(q.dtypes)["query_id"]}
    near = against(
        corpus.select("pk", "terms", "weights"),
        q,
        matching_rows,
        f"query_id {types['query_id']}, pk {types['pk']}, score double",
        block_key=["query_id"],
        max_rows=max_rows,
        max_bytes=max_bytes,
    )
    return _top(unseen(near, seen), limit).select("query_id", F.lit("sparse").alias("path"), "pk", "score", "rank")


#: Postings of one term that meet its queries in one task.
SLICE_ROWS = 200_000


def sliced_terms(postings: DataFrame, q: DataFrame, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Postings and query postings with ``slice``: a term of many postings is cut into as many slices as it needs, by key, and its
    query postings go to each of them. There are at most postings / ``slice_rows`` such terms."""
    counts = postings.groupBy("term").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("_slices")).where("_slices > 1")
    hot = broadcast_if_small(cut(counts.join(q.select("term").distinct(), "term", "left_semi")))
    slices = F.coalesce("_slices", F.lit(1))
    rows = postings.join(hot, "term", "left").withColumn("slice", F.pmod(F.xxhash64("pk"), slices).cast("int"))
    asked = q.join(hot, "term", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return rows.drop("_slices"), asked.drop("_slices")


def sparse_topk_postings(
    postings: DataFrame,
    query_postings: DataFrame,
    limit: int,
    seen: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The same from inverted postings (pk, term, weight).

    Both sides are gathered into vectors, so postings move once and no product of a query and a posting ever does. More than
    ``broadcast_bytes`` of query vectors, measured, are read as blocks of at most ``slice_rows`` queries. Postings without a term or weight match nothing.
    """
    whole = F.col("term").isNotNull() & F.col("weight").isNotNull()
    asked = sparse_vectors(query_postings.where(whole), "query_id")
    return sparse_topk(
        sparse_vectors(postings.where(whole), "pk"), asked, limit, seen, max_rows=min(slice_rows, MAX_BLOCK_ROWS), max_bytes=broadcast_bytes
    )


def sparse_vectors(postings: DataFrame, key: str) -> DataFrame:
    """Postings gathered into one (terms, weights) vector per ``key``; a text's vocabulary bounds it."""
    pairs = F.array_sort(F.collect_list(F.struct("term", "weight")))
    return postings.groupBy(key).agg(pairs.alias("_v")).select(
        key, F.col("_v.term").alias("terms"), F.col("_v.weight").alias("weights")
    )


def term_vectors(rows: DataFrame, key: str, words: Column) -> DataFrame:
    """One (terms, weights) vector per ``key`` from its list of words, which is counted where it stands; rows without words have none.

    Only where a key is repeated are words gathered by key, by a shuffle.
    """
    per_row = rows.select(key, F.explode(text.term_counts(words)).alias("_v")).select(
        key, F.col("_v.terms").alias("terms"), F.col("_v.weights").alias("weights")
    )
    if rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return per_row
    return sparse_vectors(posted(per_row, key).groupBy(key, "term").agg(F.sum("weight").alias("weight")), key)


def posted(vectors: DataFrame, key: str) -> DataFrame:
    """(terms, weights) vectors as postings: (key, term, weight)."""
    pairs = vectors.select(key, F.explode(F.arrays_zip("terms", "weights")).alias("_v"))
    return pairs.select(key, F.col("_v.terms").alias("term"), F.col("_v.weights").alias("weight"))


def probe(
    dense: DataFrame,
    sparse: DataFrame,
    queries: DataFrame,
    limit: int,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Hits of both paths, unfused: (query_id, path, pk, score, rank).

    ``dense`` is (pk, dense), ``sparse`` is (pk, terms, weights) - two
    projections of the corpus, so that each path reads only its own columns.
    """
    return dense_topk(dense, queries, limit, seen).unionByName(sparse_topk(sparse, queries, limit, seen))


def probe_stats(
    hits: DataFrame,
    queries: DataFrame,
    seen: DataFrame | None = None,
) -> DataFrame:
    """One row per (query, path), also for paths without hits; a query without terms skips the sparse path."""
    empty = F.coalesce(F.size("terms"), F.lit(0)) <= 0
    grid = queries.select("query_id", empty.alias("_e"), F.explode(F.array(*[F.lit(p) for p in PATHS])).alias("path"))
    grid = grid.withColumn("skipped", (F.col("path") == "sparse") & F.col("_e")).drop("_e")
    if seen is not None:
        shown = seen.groupBy("query_id").agg(F.countDistinct("pk").alias("filtered_by_seen"))
        grid = grid.join(shown, "query_id", "left")
    else:
        grid = grid.withColumn("filtered_by_seen", F.lit(0).cast("long"))
    stats = hits.groupBy("query_id", "path").agg(
        F.count("*").alias("hit_count"),
        F.round(F.min("score"), 6).alias("score_min"),
        F.round(F.max("score"), 6).alias("score_max"),
        F.round(F.avg("score"), 6).alias("score_mean"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "pk")))), lambda s: s["pk"]
        ).alias("top3_pks"),
    )
    return grid.join(stats, ["query_id", "path"], "left").select(
        "query_id",
        "path",
        "skipped",
        F.coalesce("hit_count", F.lit(0)).alias("hit_count"),
        "score_min",
        "score_max",
        "score_mean",
        "top3_pks",
        F.coalesce("filtered_by_seen", F.lit(0)).alias("filtered_by_seen"),
    )


def path_health(stats: DataFrame) -> DataFrame:
    """Dead paths per query: status ``dead`` (no path answers), ``single_path`` or ``ok``."""
    dead = F.col("skipped") | (F.col("hit_count") == 0)
    per = stats.groupBy("query_id").agg(
        F.count_if(dead).alias("dead_paths"),
        F.max(F.when(~dead, F.col("path"))).alias("_live"),
    )
    return per.select(
        "query_id",
        "dead_paths",
        F.when(F.col("dead_paths") >= len(PATHS), "dead")
        .when(F.col("dead_paths") == len(PATHS) - 1, "single_path")
        .otherwise("ok")
        .alias("status"),
        F.when(F.col("dead_paths") == len(PATHS) - 1, F.col("_live")).alias("only_path"),
    )


def require_live_path(stats: DataFrame) -> DataFrame:
    """``path_health`` rows, failing at run time where every path is dead."""
    health = path_health(stats)
    return health.withColumn(
        "status",
        F.when(F.col("status") != "dead", F.col("status")).otherwise(
            F.raise_error(F.lit("both retrieval paths returned no hits")).cast("string")
        ),
    )


def fuse(hits: DataFrame, rrf_k: int, active: tuple[str, ...] = PATHS, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal rank fusion per ``keys``.

    Ties go to the key seen first in (path, rank) order. Scores of inactive
    paths are kept for reading but add nothing to the fused score.
    """
    live = F.col("path").isin(*active)
    place = F.struct(path_ord(F.col("path")).alias("o"), "rank")
    per = hits.groupBy(*keys, "pk").agg(
        F.sum(F.when(live, 1.0 / (F.lit(rrf_k) + F.col("rank")))).alias("rrf"),
        F.min(F.when(live, place)).alias("_first"),
        F.array_distinct(
            F.transform(
                F.array_sort(F.collect_list(F.when(live, F.struct(path_ord(F.col("path")).alias("o"), "path")))),
                lambda s: s["path"],
            )
        ).alias("source_paths"),
        *[
            F.coalesce(F.max(F.when(F.col("path") == p, F.col("score"))), F.lit(0.0)).alias(f"score_{p}")
            for p in PATHS
        ],
    )
    w = Window.partitionBy(*keys).orderBy(F.round("rrf", 12).desc(), F.col("_first"))
    return per.where(F.col("rrf").isNotNull()).withColumn("fused_rank", F.row_number().over(w)).drop("_first")


def with_fields(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach the display columns of the corpus."""
    return rows.join(corpus.select("pk", *FIELDS), "pk")


def fields_of(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """The display columns of every hit, read from the corpus once for all later steps."""
    wanted = broadcast_if_small(hits.select("pk").distinct())
    return cut(corpus.select("pk", *FIELDS).join(wanted, "pk", "left_semi"))


def long_enough(content: Column, min_chars: int) -> Column:
    return F.length(text.strip(content)) >= min_chars


def gate(pool: DataFrame, p: SearchParams, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Mark what the gates do to fused rows, in order: short chunks, top-k cut, one chunk per sample.

    ``outcome`` is short, cut, duplicate or kept; ``rank`` numbers the kept rows.
    """
    ok = long_enough(F.col("chunk_content"), p.min_chunk_chars)
    by_rank = Window.partitionBy(*keys).orderBy("fused_rank")
    so_far = by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pool.withColumn("_ok", ok).withColumn("_place", F.sum(F.col("_ok").cast("int")).over(so_far))
    inside = placed.withColumn("_in", F.col("_ok") & (F.col("_place") <= p.top_k))
    same = Window.partitionBy(*keys, "sample_id", "_in").orderBy("fused_rank")
    judged = inside.withColumn("_nth", F.row_number().over(same)).withColumn(
        "outcome",
        F.when(~F.col("_ok"), "short")
        .when(~F.col("_in"), "cut")
        .when(F.col("_nth") > 1, "duplicate")
        .otherwise("kept"),
    )
    kept_so_far = F.sum((F.col("outcome") == "kept").cast("int")).over(so_far)
    return judged.withColumn("rank", F.when(F.col("outcome") == "kept", kept_so_far).cast("int")).drop(
        "_ok", "_place", "_in", "_nth"
    )


def gate_counts(gated: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return gated.groupBy(*keys).agg(
        F.count("*").alias("fused_hit_count"),
        F.count_if(F.col("outcome") == "short").alias("filtered_short_chunk"),
        F.count_if(F.col("outcome") == "duplicate").alias("filtered_duplicate_sample"),
        F.count_if(F.col("outcome") == "kept").alias("survivors"),
    )


def with_attempts(hits: DataFrame, p: SearchParams) -> DataFrame:
    """Each hit once per deepening attempt whose depth reaches it."""
    steps = F.array(
        *[
            F.struct(F.lit(a + 1).alias("attempt"), F.lit(p.per_path_limit * 2**a).alias("per_path_limit"))
            for a in range(p.max_attempts)
        ]
    )
    return (
        hits.withColumn("_s", F.explode(steps))
        .select("*", "_s.*")
        .drop("_s")
        .where(F.col("rank") <= F.col("per_path_limit"))
    )


@dataclass(frozen=True)
class SearchResult:
    evidence: DataFrame
    candidates: DataFrame
    attempts: DataFrame
    hits: DataFrame
    gated: DataFrame
    fields: DataFrame


def evaluate_attempts(hits: DataFrame, corpus: DataFrame, p: SearchParams) -> DataFrame:
    """Fuse and gate all deepening attempts at once, keyed by (query_id, attempt)."""
    keys = ("query_id", "attempt")
    pool = fuse(with_attempts(hits, p), p.rrf_k, p.active_paths, keys)
    limit = F.lit(p.per_path_limit) * F.pow(F.lit(2), F.col("attempt") - 1).cast("int")
    pool = pool.where(F.col("fused_rank") <= F.greatest(F.lit(2 * p.top_k), limit))
    return gate(with_fields(pool, corpus), p, keys)


def path_candidates(hits: DataFrame, evidence: DataFrame, corpus: DataFrame, best: int = SearchParams().candidates_per_path) -> DataFrame:
    """Each path's ``best`` first outside the evidence, one per sample and none of an evidence sample."""
    top = hits.where(F.col("rank") <= best).select("query_id", "path", F.col("rank").alias("rank_in_path"), "pk", "score")
    outside = with_fields(top.join(evidence.select("query_id", "pk"), ["query_id", "pk"], "left_anti"), corpus)
    fresh = outside.join(evidence.select("query_id", "sample_id").distinct(), ["query_id", "sample_id"], "left_anti")
    w = Window.partitionBy("query_id", "path", "sample_id").orderBy("rank_in_path")
    return (
        fresh.withColumn("_n", F.row_number().over(w))
        .where("_n = 1")
        .withColumn("chunk_id", text.display_id(F.col("sample_id"), F.col("chunk_seq"), F.col("pk")))
        .select(
            "query_id", "path", "rank_in_path", "pk", "chunk_id", "chunk_content", "sample_id", "counselor_id",
            "term", "score",
        )
    )


def search(
    corpus: DataFrame,
    sparse: DataFrame,
    queries: DataFrame,
    seen: DataFrame | None = None,
    p: SearchParams = SearchParams(),
    hits: DataFrame | None = None,
    dense: DataFrame | None = None,
) -> SearchResult:
    """Hybrid search with auto-deepening for many queries at once.

    Vectors are read from ``dense`` (pk, dense), or from the corpus when they stand there.

    The corpus is ranked once to the deepest attempt; ``hits`` of an earlier
    probe of that depth may be passed in instead.
    """
    if hits is None:
        hits = cut(probe(corpus if dense is None else dense, sparse, queries, p.max_depth, seen))
    fields = fields_of(hits, corpus)
    gated = cut(evaluate_attempts(hits, fields, p))
    log = attempts_log(gated, p)
    final = broadcast_if_small(log.where("final").select("query_id", "attempt"))
    kept = gated.where("outcome = 'kept'").join(final, ["query_id", "attempt"])
    evidence = kept.withColumn(
        "chunk_id", text.display_id(F.col("sample_id"), F.col("chunk_seq"), F.col("pk"))
    ).select(
        "query_id", "rank", "pk", "chunk_id", "chunk_content", "sample_id", "counselor_id", "term",
        "source_paths", "score_dense", "score_sparse", "rrf",
    )
    return SearchResult(evidence, path_candidates(hits, evidence, fields, p.candidates_per_path), log, hits, gated, fields)


def attempts_log(gated: DataFrame, p: SearchParams) -> DataFrame:
    """One row per attempt, ending at the first with enough survivors, or the last one."""
    counts = gate_counts(gated, ("query_id", "attempt"))
    met = F.col("survivors") >= p.min_survivors
    per_query = Window.partitionBy("query_id")
    limit = F.lit(p.per_path_limit) * F.pow(F.lit(2), F.col("attempt") - 1).cast("int")
    final = F.coalesce(F.min(F.when(met, F.col("attempt"))).over(per_query), F.lit(p.max_attempts))
    return (
        counts.withColumn("_final", final)
        .where(F.col("attempt") <= F.col("_final"))
        .select(
            "query_id",
            "attempt",
            limit.cast("int").alias("per_path_limit"),
            "fused_hit_count",
            "filtered_short_chunk",
            "filtered_duplicate_sample",
            "survivors",
            met.alias("met"),
            (F.col("attempt") == F.col("_final")).alias("final"),
        )
    )


def drop_previews(hits: DataFrame, corpus: DataFrame, p: SearchParams, evidence: DataFrame | None = None) -> DataFrame:
    """Fused top-k when each active path is left out, with what that loses and gains.

    Unlike the live gates, samples are made unique while filling up to top-k.
    """
    active = hits.where(F.col("path").isin(*p.active_paths) & (F.col("rank") <= p.per_path_limit))
    drops = F.array(*[F.lit(d) for d in p.active_paths]) if len(p.active_paths) > 1 else F.array().cast("array<string>")
    runs = active.withColumn("dropped", F.explode(drops)).where(F.col("path") != F.col("dropped"))
    keys = ("query_id", "dropped")
    fused_limit = max(2 * p.top_k, p.per_path_limit)
    pool = fuse(runs, p.rrf_k, p.active_paths, keys).where(F.col("fused_rank") <= fused_limit)
    rows = with_fields(pool, corpus).where(long_enough(F.col("chunk_content"), p.min_chunk_chars))
    first = Window.partitionBy(*keys, "sample_id").orderBy("fused_rank")
    fill = Window.partitionBy(*keys).orderBy("fused_rank")
    kept = (
        rows.withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .withColumn("preview_rank", F.row_number().over(fill))
        .where(F.col("preview_rank") <= p.top_k)
    )
    preview = kept.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("preview_rank", "pk"))), lambda s: s["pk"]).alias("preview")
    )
    if evidence is None:
        return preview
    actual = evidence.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "pk"))), lambda s: s["pk"]).alias("actual")
    )
    return preview.join(actual, "query_id", "left").select(
        *keys,
        "preview",
        F.array_sort(F.array_except("actual", "preview")).alias("lost"),
        F.array_sort(F.array_except("preview", "actual")).alias("gained"),
    )


def drop_failed_spans(evidence: DataFrame, span: str = "span_line_indices") -> DataFrame:
    """Remove rows whose span extraction failed (null) and renumber what is left."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return evidence.where(F.col(span).isNotNull()).withColumn("rank", F.row_number().over(w))


def span_histogram(rows: DataFrame, keys: tuple[str, ...], indices: str = "span_line_indices") -> DataFrame:
    """Span lengths per group, with the buckets 0-3 always there; ``dropped`` counts failed rows."""
    per = rows.where(F.col(indices).isNotNull()).groupBy(*keys, F.size(indices).alias("span_length")).agg(
        F.count("*").alias("n")
    )
    base = rows.groupBy(*keys).agg(F.count_if(F.col(indices).isNull()).alias("dropped"))
    seeded = base.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("span_length"))
    longer = per.where("span_length > 3").select(*keys, "span_length")
    return (
        seeded.unionByName(longer)
        .join(per, [*keys, "span_length"], "left")
        .join(base, list(keys))
        .select(*keys, "span_length", F.coalesce("n", F.lit(0)).alias("n"), "dropped")
    )
