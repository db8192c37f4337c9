"""Session-log, rating and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judging, ratings, reports
from ..params import PATHS, HarvestParams
from ..session import scratch_path
from ..sources import logs, stores
from . import tables as t
from .registry import cte, query

HP = HarvestParams()
_LOGS: dict[tuple[str, str], tuple[str, str]] = {}


def session_frame(df):
    """Log tables carry the session as text; the queries compare numbers."""
    return df.withColumn("session_id", F.col("session_id").cast("long"))


def markers(spark, d):
    state = ratings.convergence_by_turn(t.events(spark, d), HP)
    times = t.turns(spark, d).select("session_id", "turn", F.col("timestamp").alias("ts"))
    return ratings.converged_events(state, times)


def records(spark, d):
    ev = t.events(spark, d)
    rows = ev.where("kind = 'row'").withColumn("rank", F.col("pos").cast("int"))
    cands = ev.where("kind = 'candidate'").withColumn("rank_in_path", F.col("pos").cast("int")).withColumn(
        "score", F.col("score_dense")
    )
    config = F.struct(
        F.lit(60).alias("rrf_k"), F.lit(20).alias("per_path_limit"), F.lit(10).alias("top_k"), F.col("active_paths")
    )
    note = F.when(F.col("diagnose").isNotNull(), F.struct("diagnose"))
    heads = t.turns(spark, d).select(
        "session_id", "turn", "timestamp", "scope", "query", "audit_turn", config.alias("config"), note.alias("reflection")
    )
    return logs.turn_records(rows, cands, heads, ratings.turn_metrics(ev))


def details(spark, d):
    """Details lines: one per turn, a corrected second one for even turns, and a phase line."""
    heads = t.turns(spark, d)
    search = F.when(
        F.col("turn") > 1,
        F.struct(
            F.concat(F.lit("corpus_"), F.col("session_id") % 3).alias("collection"),
            F.concat(F.lit("embed_"), F.col("turn")).alias("embed_url"),
            F.when(F.col("session_id") % 3 > 0, F.concat(F.lit("model_"), F.col("session_id") % 2)).alias("embed_model_id"),
            (F.col("turn") * 10).cast("long").alias("seen_set_size"),
        ),
    )
    answer = F.struct(F.concat(F.lit("raw "), F.col("turn")).alias("raw_response"))
    base = heads.select(
        F.col("turn").cast("string").alias("turn"), "timestamp", "session_id", "query", search.alias("search"),
        answer.alias("reflection"),
    )
    again = base.where("turn % 2 = 0").withColumn(
        "reflection", F.struct(F.concat(F.lit("corrected "), F.col("turn")).alias("raw_response"))
    )
    phase = heads.where("turn = 1").select(
        F.lit("phase2").alias("turn"), F.lit("2099-01-01T00:00:00Z").alias("timestamp"), "session_id",
        F.lit(None).cast("string").alias("query"), F.lit(None).cast(base.schema["search"].dataType).alias("search"),
        F.lit(None).cast(base.schema["reflection"].dataType).alias("reflection"),
    )
    nth = [df.withColumn("nth", F.lit(i)) for i, df in enumerate((phase, base, again))]
    return nth[0].unionByName(nth[1]).unionByName(nth[2])


def log_paths(spark, d):
    """The turn log and its details sidecar, appended to JSON-lines files once."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LOGS:
        turn_log, sidecar = scratch_path(spark, "turn-log"), scratch_path(spark, "details-log")
        stores.append_log(records(spark, d), turn_log)
        stores.append_log(markers(spark, d), turn_log)
        # Corrected lines come after the first ones and carry the same timestamp: only their place tells them apart.
        stores.append_log(details(spark, d), sidecar, order=("nth", "turn"))
        _LOGS[key] = (turn_log, sidecar)
    return _LOGS[key]


def turn_log(spark, d):
    return session_frame(logs.read_turn_log(spark, log_paths(spark, d)[0], "BIGINT"))


def read_details(spark, d):
    return session_frame(logs.read_details(spark, log_paths(spark, d)[1]))


cte(
    "precision_t",
    """SELECT session_id, turn, coalesce(count(*) FILTER (kind = 'row' AND rating = 'FIT')
    / nullif(count(*) FILTER (kind = 'row' AND rating IN ('FIT', 'NOT_FIT')), 0), 0.0)::DOUBLE AS precision_at_k
    FROM events_t GROUP BY session_id, turn""",
)
cte(
    "state_t",
    """SELECT p.session_id, p.turn, p.precision_at_k,
    (SELECT count(DISTINCT pk) FROM events_t e WHERE e.session_id = p.session_id AND e.turn <= p.turn AND rating = 'FIT') AS cumulative_fit,
    (SELECT count(DISTINCT pk) FROM events_t e WHERE e.session_id = p.session_id AND e.turn <= p.turn AND rating = 'NOT_FIT') AS cumulative_not_fit
    FROM precision_t p""",
)
cte(
    "metrics_t",
    """SELECT p.session_id, p.turn, p.precision_at_k, count(*) FILTER (e.kind = 'row') AS total,
    count(*) FILTER (e.kind = 'row' AND rating = 'FIT') AS fit_count, count(*) FILTER (e.kind = 'row' AND rating = 'NOT_FIT') AS not_fit_count,
    count(*) FILTER (e.kind = 'row' AND rating = 'DISCARD') AS discard_count,
    (SELECT count(DISTINCT pk) FROM events_t x WHERE x.session_id = p.session_id AND x.turn < p.turn) AS seen_set_size
    FROM precision_t p JOIN events_t e ON e.session_id = p.session_id AND e.turn = p.turn GROUP BY 1, 2, 3""",
)


@query("session_turns", "SELECT session_id, turn::BIGINT AS turn, query, scope, timestamp, audit_turn, turn::BIGINT * 2 AS line_no FROM turns_t")
def session_turns(spark, d):
    return logs.session_turns(turn_log(spark, d)).select(
        "session_id", "turn", "query", "scope", "timestamp", "audit_turn", "line_no"
    )


@query(
    "flatten_evidence",
    """SELECT session_id, turn::BIGINT AS turn, pos AS rank, pk, chunk_id, md5(chunk_content) AS content, sample_id, counselor_id, term,
    array_to_string(source_paths, ',') AS source_paths, score_dense, score_sparse, rating,
    array_to_string(span_line_indices, ',') AS span_line_indices, md5(span_text) AS span FROM events_t WHERE kind = 'row'""",
)
def flatten_evidence(spark, d):
    rows = logs.flatten_evidence(logs.session_turns(turn_log(spark, d)))
    return rows.select(
        "session_id", "turn", "rank", "pk", "chunk_id", F.md5("chunk_content").alias("content"), "sample_id", "counselor_id",
        "term", "source_paths", "score_dense", "score_sparse", "rating", "span_line_indices", F.md5("span_text").alias("span"),
    )


@query(
    "flatten_candidates",
    """SELECT session_id, turn::BIGINT AS turn, path, pos AS rank_in_path, pk, chunk_id, rating, score_dense AS score,
    md5(span_text) AS span FROM events_t WHERE kind = 'candidate'""",
)
def flatten_candidates(spark, d):
    rows = logs.flatten_candidates(logs.session_turns(turn_log(spark, d)))
    return rows.select(
        "session_id", "turn", "path", "rank_in_path", "pk", "chunk_id", "rating", "score", F.md5("span_text").alias("span")
    )


@query(
    "legacy_guard",
    """SELECT t.session_id, count(*) FILTER (t.turn % 4 = 0) AS active_paths,
    count(*) FILTER (t.turn % 5 = 0 AND EXISTS (SELECT 1 FROM events_t e WHERE e.session_id = t.session_id AND e.turn = t.turn AND e.kind = 'row')) AS scores,
    0::BIGINT AS candidates FROM turns_t t GROUP BY t.session_id""",
)
def legacy_guard(spark, d):
    old = F.lit(logs.LEGACY_PATH)
    turns = logs.session_turns(turn_log(spark, d))
    names = F.when(F.col("turn") % 4 == 0, F.array_append("config.active_paths", old)).otherwise(F.col("config.active_paths"))
    scored = F.transform(
        "results", lambda r: r.withField("scores", F.map_concat(r["scores"], F.create_map(old, F.lit(1.0))))
    )
    aged = turns.withColumn("config", F.col("config").withField("active_paths", names)).withColumn(
        "results", F.when(F.col("turn") % 5 == 0, scored).otherwise(F.col("results"))
    )
    return logs.legacy_offences(aged)


@query(
    "search_pin",
    """SELECT session_id, 'corpus_' || (session_id % 3) AS collection, 'embed_' || min(turn) AS embed_url,
    CASE WHEN session_id % 3 > 0 THEN 'model_' || (session_id % 2) END AS embed_model_id
    FROM turns_t WHERE turn > 1 GROUP BY session_id""",
)
def search_pin(spark, d):
    return logs.search_pin(read_details(spark, d))


@query(
    "model_drift",
    """SELECT session_id, CASE WHEN session_id % 3 > 0 THEN 'model_' || (session_id % 2) END AS recorded_model_id,
    'model_1' AS current_model_id, CASE WHEN session_id % 3 = 0 THEN 'unknown' WHEN session_id % 2 = 1 THEN 'match' ELSE 'drift' END AS status
    FROM turns_t WHERE turn > 1 GROUP BY session_id""",
)
def model_drift(spark, d):
    pins = logs.search_pin(read_details(spark, d))
    current = pins.select("collection").distinct().withColumn("current_model_id", F.lit("model_1"))
    return logs.model_drift(pins, current)


@query(
    "turn_details",
    """SELECT session_id, turn::BIGINT AS turn, query, CASE WHEN turn > 1 THEN turn::BIGINT * 10 END AS seen_set_size,
    CASE WHEN diagnose IS NOT NULL THEN CASE WHEN turn % 2 = 0 THEN 'corrected ' ELSE 'raw ' END || turn END AS raw_response FROM turns_t""",
)
def turn_details(spark, d):
    return logs.turn_details(logs.session_turns(turn_log(spark, d)), read_details(spark, d))


@query(
    "turn_record",
    """SELECT m.session_id, m.turn::BIGINT AS turn, t.timestamp, m.total, m.fit_count, m.seen_set_size, round(m.precision_at_k, 6) AS precision_at_k,
    string_agg(e.pk, ',' ORDER BY e.pos) FILTER (e.kind = 'row') AS row_pks,
    string_agg(e.rating, ',' ORDER BY e.pos) FILTER (e.kind = 'row') AS row_ratings,
    string_agg(e.pk, ',' ORDER BY e.pos) FILTER (e.path = 'dense') AS dense_pks,
    string_agg(e.pk, ',' ORDER BY e.pos) FILTER (e.path = 'sparse') AS sparse_pks
    FROM metrics_t m JOIN turns_t t ON t.session_id = m.session_id AND t.turn = m.turn
    JOIN events_t e ON e.session_id = m.session_id AND e.turn = m.turn GROUP BY ALL""",
)
def turn_record(spark, d):
    def names(items, field):
        return F.array_join(F.transform(items, lambda r: r[field].cast("string")), ",")

    cands = {p: F.try_element_at("per_path_candidates", F.lit(p)) for p in PATHS}
    return records(spark, d).select(
        "session_id", "turn", "timestamp", "metrics.total", "metrics.fit_count", "metrics.seen_set_size",
        "metrics.precision_at_k", names(F.col("results"), "pk").alias("row_pks"),
        names(F.col("results"), "rating").alias("row_ratings"),
        names(cands["dense"], "pk").alias("dense_pks"), names(cands["sparse"], "pk").alias("sparse_pks"),
    )


CONVERGED = f"precision_at_k >= {HP.precision_at_k} AND cumulative_fit >= {HP.min_fit} AND cumulative_not_fit >= {HP.min_not_fit}"


@query(
    "converged_events",
    f"""SELECT s.session_id, 'converged' AS event, s.turn::BIGINT AS turn, t.timestamp AS ts FROM state_t s
    JOIN turns_t t ON t.session_id = s.session_id AND t.turn = s.turn WHERE {CONVERGED}""",
)
def converged_events(spark, d):
    return markers(spark, d)


@query(
    "rated_events",
    "SELECT session_id, turn::BIGINT AS turn, kind, path, pos, pk, rating FROM events_t",
)
def rated_events(spark, d):
    turns = logs.session_turns(turn_log(spark, d))
    both = ratings.rated_events(logs.flatten_evidence(turns), logs.flatten_candidates(turns))
    return both.select("session_id", "turn", "kind", "path", "pos", "pk", "rating")


@query("precision_at_k", "SELECT session_id, turn::BIGINT AS turn, round(precision_at_k, 6) AS precision_at_k FROM precision_t")
def precision_at_k(spark, d):
    return ratings.precision_at_k(t.events(spark, d))


@query(
    "turn_metrics",
    """SELECT session_id, turn::BIGINT AS turn, total, fit_count, not_fit_count, discard_count,
    round(precision_at_k, 6) AS precision_at_k, seen_set_size FROM metrics_t""",
)
def turn_metrics(spark, d):
    return ratings.turn_metrics(t.events(spark, d))


def breakdown_sql(keys: str) -> str:
    on = " AND ".join(f"r.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"g.{k.strip()}" + ("::BIGINT AS turn" if k.strip() == "turn" else "") for k in keys.split(","))
    return f"""SELECT {cols}, g.bucket, count(r.pk) AS total, count(*) FILTER (rating = 'FIT') AS fit,
    count(*) FILTER (rating = 'NOT_FIT') AS not_fit, count(*) FILTER (rating = 'DISCARD') AS discard
    FROM (SELECT DISTINCT {keys}, unnest(['dense_only', 'sparse_only', 'multi_path']) AS bucket FROM events_t WHERE kind = 'row') g
    LEFT JOIN (SELECT *, CASE WHEN len(source_paths) = 1 THEN source_paths[1] || '_only' ELSE 'multi_path' END AS bucket
      FROM events_t WHERE kind = 'row') r ON r.bucket = g.bucket AND {on} GROUP BY ALL"""


@query("breakdown", breakdown_sql("session_id, turn"))
def breakdown(spark, d):
    return ratings.breakdown(t.events(spark, d))


@query("breakdown_cumulative", breakdown_sql("session_id"))
def breakdown_cumulative(spark, d):
    return ratings.breakdown(t.events(spark, d), ("session_id",))


cte(
    "cumulative_t",
    """SELECT session_id, count(DISTINCT pk) FILTER (rating = 'FIT') AS cumulative_fit, count(DISTINCT pk) FILTER (rating = 'NOT_FIT') AS cumulative_not_fit,
    count(DISTINCT pk) FILTER (rating = 'DISCARD') AS cumulative_discard FROM events_t GROUP BY session_id""",
)


@query("cumulative_ratings", "SELECT * FROM cumulative_t")
def cumulative_ratings(spark, d):
    return ratings.cumulative_ratings(t.events(spark, d))


@query(
    "convergence_gate",
    f"""SELECT *, {CONVERGED.replace('precision_at_k', 'latest_precision')} AS converged FROM
    (SELECT l.session_id, l.last_turn, round(l.latest_precision, 6) AS latest_precision, c.cumulative_fit, c.cumulative_not_fit, c.cumulative_discard
    FROM (SELECT session_id, max(turn)::BIGINT AS last_turn, max_by(precision_at_k, turn) AS latest_precision FROM precision_t GROUP BY session_id) l
    JOIN cumulative_t c ON c.session_id = l.session_id)""",
)
def convergence_gate(spark, d):
    return ratings.convergence(t.events(spark, d), HP)


# Refine policy: NOT_FIT counts wherever it was given.
cte(
    "final_refine",
    """SELECT session_id, pk, max_by(rating, seq) AS rating, min(seq) FILTER (rating = 'FIT') AS fit_seq,
    max(seq) FILTER (rating = 'FIT') AS last_fit_seq, min(seq) FILTER (rating = 'NOT_FIT') AS not_fit_seq,
    max(seq) FILTER (rating = 'NOT_FIT') AS last_not_fit_seq FROM events_t WHERE rating IN ('FIT', 'NOT_FIT') GROUP BY session_id, pk""",
)
cte(
    "fit_exemplars_t",
    """SELECT f.session_id, f.pk, e.chunk_id, e.span_text, row_number() OVER (PARTITION BY f.session_id ORDER BY f.fit_seq) AS fit_ord
    FROM final_refine f JOIN events_t e ON e.session_id = f.session_id AND e.seq = f.last_fit_seq
    WHERE f.rating = 'FIT' AND length(e.span_text) > 0 AND len(e.span_line_indices) > 0""",
)
cte(
    "not_fit_exemplars_t",
    """SELECT f.session_id, f.pk, e.chunk_id, e.chunk_content, row_number() OVER (PARTITION BY f.session_id ORDER BY f.not_fit_seq) AS not_fit_ord
    FROM final_refine f JOIN events_t e ON e.session_id = f.session_id AND e.seq = f.last_not_fit_seq
    WHERE f.rating = 'NOT_FIT' AND length(e.chunk_content) > 0""",
)


@query("fit_exemplars", "SELECT session_id, pk, chunk_id, md5(span_text) AS span, fit_ord FROM fit_exemplars_t")
def fit_exemplars(spark, d):
    return ratings.fit_exemplars(t.events(spark, d)).select(
        "session_id", "pk", "chunk_id", F.md5("span_text").alias("span"), "fit_ord"
    )


@query("anchor_fits", "SELECT session_id, pk, chunk_id, md5(span_text) AS span, fit_ord FROM anchor_fits_t")
def anchor_fits(spark, d):
    return ratings.fit_exemplars(t.events(spark, d), "anchor").select(
        "session_id", "pk", "chunk_id", F.md5("span_text").alias("span"), "fit_ord"
    )


@query("not_fit_exemplars", "SELECT session_id, pk, chunk_id, md5(chunk_content) AS content, not_fit_ord FROM not_fit_exemplars_t")
def not_fit_exemplars(spark, d):
    return ratings.not_fit_exemplars(t.events(spark, d)).select(
        "session_id", "pk", "chunk_id", F.md5("chunk_content").alias("content"), "not_fit_ord"
    )


@query(
    "usable_fits",
    """SELECT f.session_id, count(*) AS n_fit, count(*) FILTER (length(e.span_text) > 0 AND len(e.span_line_indices) > 0) AS n_usable,
    count(*) FILTER (length(e.span_text) > 0 AND len(e.span_line_indices) > 0) >= 2 AS enough
    FROM final_anchor f JOIN events_t e ON e.session_id = f.session_id AND e.seq = f.last_fit_seq WHERE f.rating = 'FIT' GROUP BY f.session_id""",
)
def usable_fits(spark, d):
    return ratings.usable_fits(t.events(spark, d))


@query("rating_flips", "SELECT session_id, pk, rating FROM final_anchor WHERE last_not_fit_seq > fit_seq")
def rating_flips(spark, d):
    return ratings.rating_flips(t.events(spark, d))


cte(
    "excluded_t",
    """SELECT session_id, pk FROM fit_exemplars_t UNION SELECT session_id, pk FROM not_fit_exemplars_t
    UNION SELECT session_id, pk FROM events_t WHERE rating = 'DISCARD'""",
)


@query("rated_exclusion", "SELECT * FROM excluded_t")
def rated_exclusion(spark, d):
    return ratings.rated_exclusion(t.events(spark, d))


@query(
    "precision_trend",
    """SELECT session_id, turn::BIGINT AS turn, round(precision_at_k, 6) AS precision_at_k, round(previous, 6) AS previous,
    round(precision_at_k - previous, 6) AS delta, CASE WHEN previous IS NULL THEN 'first' WHEN precision_at_k - previous > 0.005 THEN 'improved'
    WHEN precision_at_k - previous < -0.005 THEN 'degraded' ELSE 'unchanged' END AS direction
    FROM (SELECT *, lag(precision_at_k) OVER (PARTITION BY session_id ORDER BY turn) AS previous FROM precision_t)""",
)
def precision_trend(spark, d):
    return ratings.precision_trend(t.events(spark, d))


# Finer-grained turns stand for long sessions.
@query(
    "turn_window",
    """SELECT session_id, turn, count(*) OVER (PARTITION BY session_id) + 1 <= 8
    OR row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 5 AS in_full FROM
    (SELECT DISTINCT session_id * 2 + CASE WHEN counselor_id = 'en' THEN 1 ELSE 0 END AS session_id,
    turn * 10 + len(source_paths) AS turn FROM events_t)""",
)
def turn_window(spark, d):
    turns = t.events(spark, d).select(
        (F.col("session_id") * 2 + F.when(F.col("counselor_id") == "en", 1).otherwise(0)).alias("session_id"),
        (F.col("turn") * 10 + F.size("source_paths")).cast("long").alias("turn"),
    )
    return ratings.turn_window(turns.distinct())


@query(
    "prior_spans",
    """SELECT session_id, seq, pk, md5(span_text) AS span FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back
    FROM events_t WHERE rating = 'FIT' AND length(span_text) > 0) WHERE back <= 5""",
)
def prior_spans(spark, d):
    return ratings.prior_spans(t.events(spark, d)).select("session_id", "seq", "pk", F.md5("span_text").alias("span"))


cte(
    "shown_t",
    """SELECT e.* REPLACE (CASE WHEN e.label = 4 THEN NULL ELSE e.rating END AS rating), t.audit_turn, t.active_paths
    FROM events_t e JOIN turns_t t ON t.session_id = e.session_id AND t.turn = e.turn""",
)


def shown(spark, d):
    """Shown rows, some of them not rated yet, with their turn's header."""
    ev = t.events(spark, d).withColumn("rating", F.when(F.col("label") != 4, F.col("rating")))
    return ev.join(t.turns(spark, d).select("session_id", "turn", "audit_turn", "active_paths"), ["session_id", "turn"])


@query(
    "all_rated",
    """SELECT session_id, turn::BIGINT AS turn, coalesce(bool_and(rating IS NOT NULL) FILTER (kind = 'row' OR audit_turn), true) AS all_rated,
    count(*) FILTER ((kind = 'row' OR audit_turn) AND rating IS NULL) AS unrated FROM shown_t GROUP BY session_id, turn""",
)
def all_rated(spark, d):
    return ratings.all_rated(shown(spark, d))


@query(
    "candidate_summary",
    """SELECT session_id, turn::BIGINT AS turn, path, count(*) FILTER (rating = 'FIT') AS fit, count(*) AS total,
    count(*) FILTER (rating IS NULL OR rating = 'DISCARD') AS unrated, bool_or(NOT list_contains(active_paths, path)) AS inactive
    FROM shown_t WHERE kind = 'candidate' GROUP BY session_id, turn, path""",
)
def candidate_summary(spark, d):
    return ratings.candidate_summary(shown(spark, d))


def guard_sql(rule_b: bool) -> str:
    b = "" if rule_b else "AND false"
    return f"""SELECT session_id, turn::BIGINT AS turn, path, reason IS NULL AS allowed, reason, sole_fit, candidate_fit, candidate_rated FROM
    (SELECT g.*, CASE WHEN NOT list_contains(active_paths, path) THEN 'not_active' WHEN len(active_paths) <= 1 THEN 'last_active_path'
      WHEN sole_fit > 0 {b} THEN 'sole_source_fit' WHEN candidate_fit > 0 {b} THEN 'candidate_fit' END AS reason FROM
    (SELECT t.session_id, t.turn, t.active_paths, p.path,
      count(e.pk) FILTER (e.kind = 'row' AND e.rating = 'FIT' AND e.source_paths = [p.path]) AS sole_fit,
      count(e.pk) FILTER (e.kind = 'candidate' AND e.path = p.path AND e.rating = 'FIT') AS candidate_fit,
      count(e.pk) FILTER (e.kind = 'candidate' AND e.path = p.path) AS candidate_rated
      FROM turns_t t CROSS JOIN (VALUES ('dense'), ('sparse')) p(path)
      LEFT JOIN events_t e ON e.session_id = t.session_id AND e.turn = t.turn GROUP BY 1, 2, 3, 4) g)"""


@query("path_drop_guard", guard_sql(True))
def path_drop_guard(spark, d):
    return ratings.path_drop_guard(t.events(spark, d), t.turns(spark, d))


@query("recommended_drop", guard_sql(False))
def recommended_drop(spark, d):
    return ratings.path_drop_guard(t.events(spark, d), t.turns(spark, d), rule_b=False)


@query(
    "diagnoses",
    r"""SELECT session_id, string_agg(d, ',' ORDER BY turn) AS diagnoses FROM
    (SELECT session_id, turn, regexp_replace(regexp_replace(diagnose, '^\s+', ''), '\s+$', '') AS d FROM turns_t) WHERE length(d) > 0 GROUP BY session_id""",
)
def diagnoses(spark, d):
    turns = logs.session_turns(turn_log(spark, d)).select("session_id", "turn", F.col("reflection.diagnose").alias("diagnose"))
    return reports.diagnoses(turns)


@query(
    "span_drift",
    """SELECT session_id, pk, chunk_id, counselor_id = 'fr' AS text_drift, counselor_id = 'de' AS index_drift FROM events_t
    WHERE rating = 'FIT' AND counselor_id IN ('fr', 'de')""",
)
def span_drift(spark, d):
    fits = t.events(spark, d).where("rating = 'FIT'")
    cache = t.corpus(spark, d).join(
        fits.select("pk", "chunk_id", "span_text", "span_line_indices").dropDuplicates(["pk"]), "pk"
    ).select(
        "chunk_id",
        F.when(F.col("counselor_id") == "fr", F.concat("span_text", F.lit("~"))).otherwise(F.col("span_text")).alias("span_text"),
        F.when(F.col("counselor_id") == "de", F.array_append("span_line_indices", F.lit(99))).otherwise(F.col("span_line_indices")).alias("span_line_indices"),
    )
    return judging.span_drift(fits, cache)


# Which phase files each session has written; later sessions got further.
ARTIFACTS = (
    ("phase2.meta", 1, 8), ("phase3.rubric", 2, 9), ("phase3.evidence", 2, 10), ("phase3.meta", 3, 11),
    ("phase4.eval", 4, 12), ("phase4.labels", 5, 13), ("phase4.meta", 5, 14),
)
cte("sessions_t", f"SELECT DISTINCT doc_id // {t.SESSION_SIZE} AS session_id FROM documents")
cte(
    "artifacts_t",
    " UNION ALL ".join(
        f"""SELECT session_id, '{name}' AS artifact, {t.stamp_sql('session_id', str(turn))} AS ts,
        CASE WHEN '{name}' = 'phase3.meta' THEN CASE WHEN session_id % 6 = 3 THEN 'abort' ELSE 'agree' END END AS operator_decision
        FROM sessions_t WHERE session_id % 6 >= {least}"""
        for name, least, turn in ARTIFACTS
    ),
)
cte(
    "log_t",
    f"""SELECT session_id, turn::BIGINT * 2 AS line_no, NULL AS event, query, scope, timestamp AS ts FROM turns_t
    UNION ALL SELECT session_id, turn::BIGINT * 2 + 1, 'converged', NULL, NULL, {t.stamp_sql('session_id', 'turn')} FROM state_t WHERE {CONVERGED}""",
)


def artifacts(spark, d):
    sessions = t.load(spark, d, "documents").select(F.floor(F.col("doc_id") / t.SESSION_SIZE).alias("session_id")).distinct()
    listed = F.array(
        *[
            F.struct(F.lit(name).alias("artifact"), F.lit(least).alias("least"), F.lit(turn).alias("at"))
            for name, least, turn in ARTIFACTS
        ]
    )
    rows = sessions.select("session_id", F.explode(listed).alias("a")).select("session_id", "a.*")
    decision = F.when(
        F.col("artifact") == "phase3.meta", F.when(F.col("session_id") % 6 == 3, "abort").otherwise("agree")
    )
    return rows.where(F.col("session_id") % 6 >= F.col("least")).select(
        "session_id", "artifact", t.iso_time(F.col("session_id"), F.col("at")).alias("ts"), decision.alias("operator_decision")
    )


def log_lines(spark, d):
    return turn_log(spark, d).select(
        "session_id", "line_no", "event", "query", "scope", F.coalesce("timestamp", "ts").alias("ts")
    )


cte(
    "stage_t",
    """SELECT l.session_id, CASE WHEN agreed AND NOT labelled THEN 'APPLY_PENDING' WHEN agreed THEN 'DONE_VIEW' WHEN judged THEN 'POST_RUBRIC'
    WHEN harvested THEN 'POST_HARVEST' WHEN last_event = 'converged' THEN 'POST_TUNING' END AS stage FROM
    (SELECT coalesce(a.session_id, g.session_id) AS session_id, coalesce(agreed, false) AS agreed, coalesce(labelled, false) AS labelled,
      coalesce(judged, false) AS judged, coalesce(harvested, false) AS harvested, last_event FROM
      (SELECT session_id, bool_or(artifact = 'phase3.meta' AND operator_decision = 'agree') AS agreed, bool_or(artifact = 'phase4.labels') AS labelled,
       bool_or(artifact = 'phase3.rubric') AND bool_or(artifact = 'phase3.evidence') AS judged, bool_or(artifact = 'phase2.meta') AS harvested
       FROM artifacts_t GROUP BY session_id) a
      FULL JOIN (SELECT session_id, arg_max(coalesce(event, ''), line_no) AS last_event FROM log_t GROUP BY session_id) g ON g.session_id = a.session_id) l""",
)


@query("session_stage", "SELECT session_id, stage FROM stage_t")
def session_stage(spark, d):
    return reports.session_stage(artifacts(spark, d), log_lines(spark, d))


@query(
    "session_catalogue",
    """SELECT s.session_id, coalesce(l.query, '') AS query, l.scope, s.stage, coalesce(l.n_turns, 0) AS n_turns,
    greatest(l.ts, a.ts) AS last_modified FROM stage_t s
    LEFT JOIN (SELECT session_id, min_by(query, line_no) AS query, min_by(scope, line_no) AS scope, count(*) AS n_turns, max(ts) AS ts
      FROM log_t WHERE event IS NULL GROUP BY session_id) l ON l.session_id = s.session_id
    LEFT JOIN (SELECT session_id, max(ts) AS ts FROM artifacts_t GROUP BY session_id) a ON a.session_id = s.session_id
    WHERE s.stage IS NOT NULL""",
)
def session_catalogue(spark, d):
    log, files = log_lines(spark, d), artifacts(spark, d)
    return reports.session_catalogue(log, files, reports.session_stage(files, log))


cte(
    "timing_t",
    """SELECT coalesce(f.session_id, a.session_id) AS session_id, harvest AS started, coalesce(applied, eval) AS ended,
    coalesce(first_ts, harvest) AS session_start, applied AS session_end FROM
    (SELECT session_id, min_by(ts, line_no) AS first_ts FROM log_t WHERE event IS NULL GROUP BY session_id) f FULL JOIN
    (SELECT session_id, max(ts) FILTER (artifact = 'phase2.meta') AS harvest, max(ts) FILTER (artifact = 'phase4.meta') AS applied,
    max(ts) FILTER (artifact = 'phase4.eval') AS eval FROM artifacts_t GROUP BY session_id) a ON a.session_id = f.session_id""",
)


def timing(spark, d):
    return reports.session_timing(
        artifacts(spark, d), t.turns(spark, d).select("session_id", "turn", F.col("timestamp").alias("ts"))
    )


@query("session_timing", "SELECT * FROM timing_t")
def session_timing(spark, d):
    return timing(spark, d)
