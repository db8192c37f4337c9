"""Rated events, convergence and the reports over rating turns.

An event is one rated row or candidate of one turn of one session:
(session_id, turn, kind, path, pos, pk, rating, ...). ``pos`` is the rank of a
row or the rank in its path of a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import PATHS, HarvestParams, RatingParams
from .retrieval import path_ord

BUCKETS = ("dense_only", "sparse_only", "multi_path")
SHOWN = RatingParams()


def sequence_no() -> Column:
    """Position of an event in its session: turn, rows before candidates, path, position."""
    kind = F.when(F.col("kind") == "row", 0).otherwise(1)
    place = kind * 10_000_000 + F.coalesce(path_ord(F.col("path")), F.lit(0)) * 1_000_000 + F.col("pos")
    return F.col("turn").cast("long") * 100_000_000 + F.when(F.col("kind") == "row", F.col("pos")).otherwise(place)


def rated_events(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows and candidates of all turns as one table of rated events."""
    left = rows.withColumn("kind", F.lit("row")).withColumn("path", F.lit(None).cast("string")).withColumnRenamed(
        "rank", "pos"
    )
    right = candidates.withColumn("kind", F.lit("candidate")).withColumnRenamed("rank_in_path", "pos")
    both = left.unionByName(right, allowMissingColumns=True)
    return both.where(F.col("rating").isNotNull())


def rows_only(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") == "row")


def _count(rating: str) -> Column:
    return F.count_if(F.col("rating") == rating)


def turn_metrics(events: DataFrame) -> DataFrame:
    """Per turn: totals by rating over fused rows, precision@k, and the seen-set size before the turn."""
    per = rows_only(events).groupBy("session_id", "turn").agg(
        F.count("*").alias("total"),
        _count("FIT").alias("fit_count"),
        _count("NOT_FIT").alias("not_fit_count"),
        _count("DISCARD").alias("discard_count"),
    )
    first_shown = events.groupBy("session_id", "pk").agg(F.min("turn").alias("turn"))
    new = first_shown.groupBy("session_id", "turn").agg(F.count("*").alias("new_pks"))
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = events.select("session_id", "turn").distinct().join(new, ["session_id", "turn"], "left").withColumn(
        "seen_set_size", F.coalesce(F.sum("new_pks").over(w), F.lit(0))
    )
    counts = ("total", "fit_count", "not_fit_count", "discard_count")
    filled = turns.drop("new_pks").join(per, ["session_id", "turn"], "left").fillna(0, list(counts))
    verdicts = F.col("fit_count") + F.col("not_fit_count")
    return filled.select(
        "session_id",
        "turn",
        *counts,
        F.coalesce(F.try_divide("fit_count", verdicts), F.lit(0.0)).alias("precision_at_k"),
        "seen_set_size",
    )


def precision_at_k(events: DataFrame) -> DataFrame:
    """FIT / (FIT + NOT_FIT) over fused rows of each turn; 0 without verdicts."""
    per = events.groupBy("session_id", "turn").agg(
        F.count_if((F.col("kind") == "row") & (F.col("rating") == "FIT")).alias("_fit"),
        F.count_if((F.col("kind") == "row") & F.col("rating").isin("FIT", "NOT_FIT")).alias("_all"),
    )
    return per.select(
        "session_id", "turn", F.coalesce(F.try_divide("_fit", "_all"), F.lit(0.0)).alias("precision_at_k")
    )


def breakdown(events: DataFrame, keys: tuple[str, ...] = ("session_id", "turn")) -> DataFrame:
    """Counts by source bucket, every bucket present; no single source means multi_path."""
    rows = rows_only(events)
    bucket = F.when(
        F.size("source_paths") == 1, F.concat(F.element_at("source_paths", 1), F.lit("_only"))
    ).otherwise("multi_path")
    per = rows.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count("*").alias("total"),
        _count("FIT").alias("fit"),
        _count("NOT_FIT").alias("not_fit"),
        _count("DISCARD").alias("discard"),
    )
    grid = rows.select(*keys).distinct().withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in BUCKETS])))
    return grid.join(per, [*keys, "bucket"], "left").fillna(0, ["total", "fit", "not_fit", "discard"])


def cumulative_ratings(events: DataFrame) -> DataFrame:
    """Distinct keys ever given each rating, without last-write-wins."""
    once = events.select("session_id", "pk", "rating").distinct()
    return once.groupBy("session_id").agg(
        _count("FIT").alias("cumulative_fit"),
        _count("NOT_FIT").alias("cumulative_not_fit"),
        _count("DISCARD").alias("cumulative_discard"),
    )


def convergence(events: DataFrame, p: HarvestParams = HarvestParams()) -> DataFrame:
    """The triple gate per session: latest precision, distinct FIT, distinct NOT_FIT."""
    latest = precision_at_k(events).groupBy("session_id").agg(
        F.max("turn").alias("last_turn"), F.max_by("precision_at_k", "turn").alias("latest_precision")
    )
    ok = (
        (F.col("latest_precision") >= p.precision_at_k)
        & (F.col("cumulative_fit") >= p.min_fit)
        & (F.col("cumulative_not_fit") >= p.min_not_fit)
    )
    return latest.join(cumulative_ratings(events), "session_id").withColumn("converged", ok)


def convergence_by_turn(events: DataFrame, p: HarvestParams = HarvestParams()) -> DataFrame:
    """The gate as it stood after every turn."""
    first = events.groupBy("session_id", "pk", "rating").agg(F.min("turn").alias("turn"))
    new = first.groupBy("session_id", "turn").agg(_count("FIT").alias("_fit"), _count("NOT_FIT").alias("_not"))
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = (
        precision_at_k(events)
        .join(new, ["session_id", "turn"], "left")
        .withColumn("cumulative_fit", F.coalesce(F.sum("_fit").over(w), F.lit(0)))
        .withColumn("cumulative_not_fit", F.coalesce(F.sum("_not").over(w), F.lit(0)))
        .drop("_fit", "_not")
    )
    ok = (
        (F.col("precision_at_k") >= p.precision_at_k)
        & (F.col("cumulative_fit") >= p.min_fit)
        & (F.col("cumulative_not_fit") >= p.min_not_fit)
    )
    return state.withColumn("converged", ok)


def converged_events(state: DataFrame, times: DataFrame) -> DataFrame:
    """A ``converged`` marker for every turn after which the gate holds."""
    return (
        state.where("converged")
        .join(times.select("session_id", "turn", "ts"), ["session_id", "turn"])
        .select("session_id", F.lit("converged").alias("event"), "turn", "ts")
    )


_PAYLOAD = ("chunk_id", "chunk_content", "span_text", "span_line_indices")


def latest_ratings(events: DataFrame, policy: str = "refine") -> DataFrame:
    """Last-write-wins rating per (session, pk) among FIT and NOT_FIT.

    ``policy='anchor'`` disregards NOT_FIT given to candidates. The payloads
    are those of the last FIT and last NOT_FIT event; ``fit_seq`` orders
    anchors by their first FIT event.
    """
    verdicts = events.where(F.col("rating").isin("FIT", "NOT_FIT"))
    if policy == "anchor":
        verdicts = verdicts.where((F.col("rating") == "FIT") | (F.col("kind") == "row"))
    seq = verdicts.withColumn("seq", sequence_no())
    fit, not_fit = F.col("rating") == "FIT", F.col("rating") == "NOT_FIT"
    payload = F.struct(*_PAYLOAD)
    return seq.groupBy("session_id", "pk").agg(
        F.max_by("rating", "seq").alias("rating"),
        F.min(F.when(fit, F.col("seq"))).alias("fit_seq"),
        F.min(F.when(not_fit, F.col("seq"))).alias("not_fit_seq"),
        F.max(F.when(not_fit, F.col("seq"))).alias("last_not_fit_seq"),
        F.max_by(F.when(fit, payload), F.when(fit, F.col("seq"))).alias("fit_payload"),
        F.max_by(F.when(not_fit, payload), F.when(not_fit, F.col("seq"))).alias("not_fit_payload"),
    )


def usable_span(text: Column, indices: Column) -> Column:
    return (F.coalesce(F.length(text), F.lit(0)) > 0) & (F.coalesce(F.size(indices), F.lit(0)) > 0)


def fit_exemplars(events: DataFrame, policy: str = "refine") -> DataFrame:
    """Chunks whose final rating is FIT, with a usable span, ordered by ``fit_ord``."""
    final = latest_ratings(events, policy).where("rating = 'FIT'")
    usable = final.select("session_id", "pk", "fit_seq", "fit_payload.*").where(
        usable_span(F.col("span_text"), F.col("span_line_indices"))
    )
    w = Window.partitionBy("session_id").orderBy("fit_seq")
    return usable.withColumn("fit_ord", F.row_number().over(w)).drop("fit_seq")


def not_fit_exemplars(events: DataFrame) -> DataFrame:
    """Chunks whose final rating is NOT_FIT and whose text was logged."""
    final = latest_ratings(events, "refine").where("rating = 'NOT_FIT'")
    usable = final.select("session_id", "pk", "not_fit_seq", "not_fit_payload.*").where(F.length("chunk_content") > 0)
    w = Window.partitionBy("session_id").orderBy("not_fit_seq")
    return usable.withColumn("not_fit_ord", F.row_number().over(w)).drop("not_fit_seq")


def usable_fits(events: DataFrame, policy: str = "anchor") -> DataFrame:
    """Per session: final FITs, those with a usable span, and whether two are left to calibrate with."""
    final = latest_ratings(events, policy).where("rating = 'FIT'")
    ok = usable_span(F.col("fit_payload.span_text"), F.col("fit_payload.span_line_indices"))
    return final.groupBy("session_id").agg(
        F.count("*").alias("n_fit"), F.count_if(ok).alias("n_usable"), (F.count_if(ok) >= 2).alias("enough")
    )


def rating_flips(events: DataFrame) -> DataFrame:
    """Keys that changed between FIT and NOT_FIT after having been FIT."""
    final = latest_ratings(events, "anchor")
    return final.where(F.col("last_not_fit_seq") > F.col("fit_seq")).select("session_id", "pk", "rating")


def discarded(events: DataFrame) -> DataFrame:
    return events.where("rating = 'DISCARD'").select("session_id", "pk").distinct()


def rated_exclusion(events: DataFrame) -> DataFrame:
    """Keys the refine sample must avoid: usable FIT, NOT_FIT with text, and every DISCARD."""
    parts = (
        fit_exemplars(events).select("session_id", "pk"),
        not_fit_exemplars(events).select("session_id", "pk"),
        discarded(events),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def precision_trend(events: DataFrame) -> DataFrame:
    """Precision per turn with its change from the turn before."""
    w = Window.partitionBy("session_id").orderBy("turn")
    step = F.col("precision_at_k") - F.col("previous")
    return (
        precision_at_k(events)
        .withColumn("previous", F.lag("precision_at_k").over(w))
        .withColumn("delta", step)
        .withColumn(
            "direction",
            F.when(F.col("previous").isNull(), "first")
            .when(step > SHOWN.trend_band, "improved")
            .when(step < -SHOWN.trend_band, "degraded")
            .otherwise("unchanged"),
        )
    )


def turn_window(turns: DataFrame) -> DataFrame:
    """Which past turns a long session shows in full: all, or the last five once there are many."""
    newest = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    all_turns = Window.partitionBy("session_id")
    few = F.count("*").over(all_turns) + 1 <= SHOWN.compress_above
    return turns.select(
        "session_id", "turn", (few | (F.row_number().over(newest) <= SHOWN.recent_turns)).alias("in_full")
    )


def prior_spans(events: DataFrame, cap: int = SHOWN.prior_spans) -> DataFrame:
    """The last non-empty FIT spans of each session, in session order."""
    spans = events.where((F.col("rating") == "FIT") & (F.length("span_text") > 0)).withColumn("seq", sequence_no())
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    return spans.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= cap).select(
        "session_id", "seq", "pk", "span_text"
    )


def all_rated(shown: DataFrame) -> DataFrame:
    """Whether every row (and, on audit turns, every candidate) of a turn carries a rating."""
    relevant = (F.col("kind") == "row") | F.col("audit_turn")
    return shown.groupBy("session_id", "turn").agg(
        F.coalesce(F.bool_and(F.when(relevant, F.col("rating").isNotNull())), F.lit(True)).alias("all_rated"),
        F.count_if(relevant & F.col("rating").isNull()).alias("unrated"),
    )


def path_drop_guard(events: DataFrame, active: DataFrame, rule_b: bool = True) -> DataFrame:
    """May a path be dropped after each turn?

    It must be active and not the last one; with ``rule_b`` it must not be the
    only source of a FIT row, nor have a FIT candidate.
    """
    grid = active.select(
        "session_id", "turn", "active_paths", F.explode(F.array(*[F.lit(x) for x in PATHS])).alias("path")
    )
    fits = events.where("rating = 'FIT'")
    sole = rows_only(fits).where(F.size("source_paths") == 1).groupBy(
        "session_id", "turn", F.element_at("source_paths", 1).alias("path")
    ).agg(F.count("*").alias("sole_fit"))
    cand = events.where("kind = 'candidate'").groupBy("session_id", "turn", "path").agg(
        _count("FIT").alias("candidate_fit"), F.count("*").alias("candidate_rated")
    )
    full = (
        grid.join(sole, ["session_id", "turn", "path"], "left")
        .join(cand, ["session_id", "turn", "path"], "left")
        .fillna(0, ["sole_fit", "candidate_fit", "candidate_rated"])
    )
    reason = (
        F.when(~F.array_contains("active_paths", F.col("path")), "not_active")
        .when(F.size("active_paths") <= 1, "last_active_path")
        .when(F.lit(rule_b) & (F.col("sole_fit") > 0), "sole_source_fit")
        .when(F.lit(rule_b) & (F.col("candidate_fit") > 0), "candidate_fit")
    )
    return full.select(
        "session_id", "turn", "path", reason.isNull().alias("allowed"), reason.alias("reason"),
        "sole_fit", "candidate_fit", "candidate_rated",
    )


def candidate_summary(shown: DataFrame) -> DataFrame:
    """Per turn and path: how its candidates were rated, and whether the path was active."""
    cands = shown.where("kind = 'candidate'")
    verdict = F.coalesce(F.col("rating").isin("FIT", "NOT_FIT"), F.lit(False))
    return cands.groupBy("session_id", "turn", "path").agg(
        _count("FIT").alias("fit"),
        F.count("*").alias("total"),
        F.count_if(~verdict).alias("unrated"),
        F.bool_or(~F.array_contains("active_paths", F.col("path"))).alias("inactive"),
    )


def depth_accounting(stats: DataFrame, per_path_limit: int) -> DataFrame:
    """What each path's probe reached after seen rows were taken out."""
    none = F.col("hit_count") == 0
    return stats.select(
        "query_id",
        "path",
        F.lit(per_path_limit).alias("per_path_limit"),
        F.when(F.col("skipped"), "skipped")
        .when(none & (F.col("filtered_by_seen") > 0), "exhausted")
        .when(none, "empty")
        .otherwise("new")
        .alias("state"),
        "filtered_by_seen",
        F.when(~F.col("skipped") & ~none, F.col("filtered_by_seen") + 1).alias("first_rank"),
        F.when(~F.col("skipped") & ~none, F.col("filtered_by_seen") + F.col("hit_count")).alias("last_rank"),
    )
