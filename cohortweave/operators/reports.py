"""Verdict reports, session catalogue, exports and nested meta records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import broadcast_if_small, narrowed
from .judging import AUTO_DROP
from .ordering import prefix
from .sampling import bin_sizes

SID = "session_id"


def _decided() -> Column:
    return (F.col("verdict") != "ERROR") & ~F.col("failed_check").eqNullSafe(AUTO_DROP)


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """KEEP / DROP / ERROR / auto_drop; an ERROR is an error before it is anything else."""
    return verdicts.groupBy(SID).agg(
        F.count_if(_decided() & (F.col("verdict") == "KEEP")).alias("keep"),
        F.count_if(_decided() & (F.col("verdict") == "DROP")).alias("drop"),
        F.count_if(F.col("verdict") == "ERROR").alias("error"),
        F.count_if((F.col("verdict") != "ERROR") & F.col("failed_check").eqNullSafe(AUTO_DROP)).alias("auto_drop"),
    )


def decile_keep_rate(verdicts: DataFrame, n_bins: int = 10) -> DataFrame:
    """Keep rate per decile over judged rows; null where nothing was decided."""
    per = verdicts.groupBy(SID, "decile").agg(
        F.count_if(_decided() & (F.col("verdict") == "KEEP")).alias("keep"),
        F.count_if(_decided() & F.col("verdict").isin("KEEP", "DROP")).alias("decided"),
    )
    grid = verdicts.select(SID).distinct().withColumn("decile", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return grid.join(per, [SID, "decile"], "left").select(
        SID,
        "decile",
        F.coalesce("keep", F.lit(0)).alias("keep"),
        F.coalesce("decided", F.lit(0)).alias("decided"),
        F.try_divide("keep", "decided").alias("keep_rate"),
    )


def failed_check_histogram(verdicts: DataFrame) -> DataFrame:
    hit = (F.col("verdict") == "DROP") & F.col("failed_check").isNotNull() & (F.col("failed_check") != AUTO_DROP)
    return verdicts.where(hit).groupBy(SID, "failed_check").agg(F.count("*").alias("n"))


def latency_summary(verdicts: DataFrame) -> DataFrame:
    """p50 / p90 / p99 by nearest rank (half to even), and the maximum, over rows that did not fail."""
    rows = verdicts.where((F.col("verdict") != "ERROR") & F.col("latency_ms").isNotNull())
    ranked = prefix(
        rows.select(SID, "pk", "latency_ms"), [SID], [F.col("latency_ms").asc(), F.col("pk").asc()], rank="_place"
    )
    sizes = rows.groupBy(SID).agg(F.count("*").alias("n"))
    at = ranked.join(broadcast_if_small(sizes), SID)

    def pick(q: float) -> Column:
        return F.max(F.when(F.col("_place") - 1 == F.bround(F.lit(q) * (F.col("n") - 1), 0), F.col("latency_ms")))

    return at.groupBy(SID).agg(
        F.max("n").alias("count"),
        pick(0.5).alias("p50_ms"),
        pick(0.9).alias("p90_ms"),
        pick(0.99).alias("p99_ms"),
        F.max("latency_ms").alias("max_ms"),
    )


def decile_breakdown(verdicts: DataFrame) -> DataFrame:
    """Counts per decile with errors; auto-drops count as drops here."""
    return verdicts.groupBy(SID, "decile").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("verdict") == "KEEP").alias("keep"),
        F.count_if(F.col("verdict") == "DROP").alias("drop"),
        F.count_if(~F.col("verdict").isin("KEEP", "DROP")).alias("error"),
    )


def projected_total(
    verdicts: DataFrame, binned: DataFrame | None, edges: DataFrame, n_bins: int = 10, sizes: DataFrame | None = None
) -> DataFrame:
    """Sample keep rates carried over to the bins' populations, with the bins' distance ranges; ``sizes`` in place of ``binned`` where the cohort is not written."""
    population = (bin_sizes(binned) if sizes is None else sizes).withColumnRenamed("n", "population")
    lo = edges.select(SID, F.col("edge").alias("decile"), F.col("value").alias("distance_min"))
    hi = edges.select(SID, (F.col("edge") - 1).alias("decile"), F.col("value").alias("distance_max"))
    rows = (
        decile_keep_rate(verdicts, n_bins)
        .join(population, [SID, "decile"], "left")
        .join(lo, [SID, "decile"], "left")
        .join(hi, [SID, "decile"], "left")
        .withColumn("population", F.coalesce("population", F.lit(0)))
    )
    keep = F.coalesce(F.bround(F.col("keep_rate") * F.col("population"), 0), F.lit(0.0)).cast("long")
    w = Window.partitionBy(SID)
    return rows.withColumn("projected_keep", keep).select(
        SID,
        "decile",
        "distance_min",
        "distance_max",
        "population",
        "keep_rate",
        "projected_keep",
        F.when(F.col("keep_rate").isNull(), 0).otherwise(F.col("population") - F.col("projected_keep")).alias(
            "projected_drop"
        ),
        F.sum("projected_keep").over(w).alias("estimated_total"),
    )


def labelled_export(labels: DataFrame, content: DataFrame) -> DataFrame:
    """Export rows: ids read from the key, original text ("" when missing), label."""
    texts = narrowed(content.where("original_content IS NOT NULL"), labels)
    return labels.join(texts, "pk", "left").select(SID, *export_columns())


def export_columns() -> list[Column]:
    """The columns of an export row, of a key (``pk``), its text (``original_content``, null when missing) and its ``verdict``."""
    key = F.col("pk").cast("string")
    return [
        F.col("pk"),
        text.key_user(key).alias("user_id"),
        text.key_counselor(key).alias("counselor_id"),
        F.coalesce("original_content", F.lit("")).alias("original_content"),
        F.col("verdict").alias("label"),
        F.col("original_content").isNull().alias("missing"),
    ]


def export_metadata(export: DataFrame, timing: DataFrame, metrics: DataFrame) -> DataFrame:
    per = export.groupBy(SID).agg(
        F.count("*").alias("n_chunks_total"),
        F.count_if(F.col("label") == "KEEP").alias("n_keep"),
        F.count_if(F.col("label") == "DROP").alias("n_drop"),
        F.count_if("missing").alias("n_missing_content"),
    )
    return per.join(timing, SID, "left").join(metrics, SID, "left").select(
        SID,
        F.coalesce("session_start", F.lit("")).alias("session_start"),
        F.coalesce("session_end", F.lit("")).alias("session_end"),
        "n_chunks_total",
        "n_keep",
        "n_drop",
        "threshold",
        "precision_at_threshold",
        "n_missing_content",
    )


def session_timing(artifacts: DataFrame, turns: DataFrame) -> DataFrame:
    """Start and end per session.

    ``started`` / ``ended`` come from the harvest and apply records (falling
    back to the evaluation record); the export's start prefers the first turn.
    """
    ts = artifacts.groupBy(SID).agg(
        F.max(F.when(F.col("artifact") == "phase2.meta", F.col("ts"))).alias("_harvest"),
        F.max(F.when(F.col("artifact") == "phase4.meta", F.col("ts"))).alias("_apply"),
        F.max(F.when(F.col("artifact") == "phase4.eval", F.col("ts"))).alias("_eval"),
    )
    first = turns.groupBy(SID).agg(F.min_by("ts", "turn").alias("_first"))
    return first.join(ts, SID, "full_outer").select(
        SID,
        F.col("_harvest").alias("started"),
        F.coalesce("_apply", "_eval").alias("ended"),
        F.coalesce("_first", "_harvest").alias("session_start"),
        F.col("_apply").alias("session_end"),
    )


def session_stage(artifacts: DataFrame, log: DataFrame, apply_enabled: bool = True) -> DataFrame:
    """Where each session resumes: DONE_VIEW, APPLY_PENDING, POST_RUBRIC, POST_HARVEST, POST_TUNING or null.

    ``log`` has (session_id, line_no, event); the last line decides POST_TUNING.
    """

    def has(name: str) -> Column:
        return F.coalesce(F.bool_or(F.col("artifact") == name), F.lit(False))

    per = artifacts.groupBy(SID).agg(
        F.coalesce(
            F.bool_or((F.col("artifact") == "phase3.meta") & F.col("operator_decision").eqNullSafe("agree")), F.lit(False)
        ).alias("agreed"),
        has("phase4.labels").alias("labelled"),
        (has("phase3.rubric") & has("phase3.evidence")).alias("judged"),
        has("phase2.meta").alias("harvested"),
    )
    last = log.groupBy(SID).agg(F.max_by(F.struct("event"), "line_no").alias("last"))
    both = last.join(per, SID, "full_outer")
    stage = (
        F.when(F.col("agreed") & ~F.col("labelled") & F.lit(apply_enabled), "APPLY_PENDING")
        .when(F.col("agreed"), "DONE_VIEW")
        .when(F.col("judged"), "POST_RUBRIC")
        .when(F.col("harvested"), "POST_HARVEST")
        .when(F.col("last.event") == "converged", "POST_TUNING")
    )
    return both.select(SID, stage.alias("stage"))


def session_catalogue(log: DataFrame, artifacts: DataFrame, stages: DataFrame) -> DataFrame:
    """Resumable sessions, newest first: first turn's query and scope, turns, last change."""
    turns = log.where("event IS NULL")
    per = turns.groupBy(SID).agg(
        F.min_by("query", "line_no").alias("query"),
        F.min_by("scope", "line_no").alias("scope"),
        F.count("*").alias("n_turns"),
        F.max("ts").alias("_log_ts"),
    )
    touched = artifacts.groupBy(SID).agg(F.max("ts").alias("_file_ts"))
    return (
        stages.where("stage IS NOT NULL")
        .join(per, SID, "left")
        .join(touched, SID, "left")
        .select(
            SID,
            F.coalesce("query", F.lit("")).alias("query"),
            "scope",
            "stage",
            F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
            F.greatest("_log_ts", "_file_ts").alias("last_modified"),
        )
        .orderBy(F.col("last_modified").desc(), SID)
    )


def diagnoses(turns: DataFrame, column: str = "diagnose") -> DataFrame:
    """Non-empty trimmed diagnose notes per session, in turn order."""
    kept = turns.withColumn("_d", text.strip(F.col(column))).where(F.length("_d") > 0)
    return kept.groupBy(SID).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "_d"))), lambda s: s["_d"]).alias("diagnoses")
    )


def harvest_meta(
    calibration: DataFrame,
    gate: DataFrame,
    recovery: DataFrame,
    verdict: DataFrame,
    cohort: DataFrame,
    summary: DataFrame,
    intruders: DataFrame,
    consistency: DataFrame,
    distances: DataFrame,
    discard_total: DataFrame,
) -> DataFrame:
    """One nested record per session; per-anchor lists follow anchor order."""

    def ordered(value: str, places: int = 6) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct("fit_ord", F.round(value, places).alias("v"))))
        return F.transform(pairs, lambda s: s["v"])

    cal = calibration.groupBy(SID).agg(
        F.max("n_fit").alias("n_fit"),
        F.struct(
            F.round(F.max("T"), 6).alias("T"),
            ordered("delta").alias("deltas"),
            ordered("T_prime").alias("T_primes"),
            F.round(F.max("T_prime_out"), 6).alias("T_prime_out"),
            ordered("nearest_distance").alias("span_loo_distances"),
        ).alias("calibration"),
    )
    qg = gate.groupBy(SID).agg(
        F.struct(
            F.round(F.max("T"), 6).alias("T_pre_drop"),
            F.round(F.max("median_delta"), 6).alias("median_delta_pre_drop"),
            F.round(F.max("cutoff"), 6).alias("multiplier_cutoff"),
            F.bool_or("floor_applied").alias("median_floor_applied"),
            F.array_sort(F.collect_list(F.when(F.col("dropped"), F.struct("fit_pk", F.round("delta", 6).alias("delta"), "reasons")))).alias("dropped"),
        ).alias("quality_gate")
    )
    loo = verdict.select(SID, F.struct("recovered", "total", "verdict").alias("loo_recovery"))
    missed = recovery.groupBy(SID).agg(
        F.array_sort(F.collect_list(F.when(~F.col("recovered"), F.col("fit_pk")))).alias("missed_fits")
    )
    own = consistency.groupBy(SID).agg(F.count_if(~F.col("own_chunk_retained")).alias("own_chunks_missing"))
    intr = intruders.groupBy(SID).agg(F.array_sort(F.collect_list("pk")).alias("intruder_pks"))
    size = cohort.groupBy(SID).agg(F.count("*").alias("output_count"))
    dist = distances.select(SID, F.struct(*[F.round(c, 6).alias(c) for c in ("min", "p25", "median", "p75", "max")]).alias("distance_distribution"))
    freq = summary.select(
        SID, F.struct("kept", "dropped", "count_min", "count_median", "count_max").alias("frequency_gate")
    )
    out = cal
    for part in (qg, loo, missed, own, intr, size, dist, freq, discard_total):
        out = out.join(part, SID, "left")
    return out.withColumn("intruder_pks", F.coalesce("intruder_pks", F.array().cast(dict(out.dtypes)["intruder_pks"])))


def per_anchor_detail(calibration: DataFrame, recovery: DataFrame, budget: DataFrame) -> DataFrame:
    return (
        calibration.select(SID, "fit_pk", "chunk_id", "fit_ord", F.col("delta").alias("span_to_own_chunk_distance"), "T_prime")
        .join(
            recovery.select(SID, "fit_pk", "recovered", "recalibrated_T", "rank_of_own_pk", "distance_of_own_pk"),
            [SID, "fit_pk"],
            "left",
        )
        .join(budget.select(SID, "fit_pk", F.col("kept").alias("total_hits"), "budget_exhausted"), [SID, "fit_pk"], "left")
        .withColumn("recovered", F.coalesce("recovered", F.lit(False)))
    )


def refine_meta(
    verdicts: DataFrame, binned: DataFrame | None, edges: DataFrame, n_bins: int = 10, sizes: DataFrame | None = None
) -> DataFrame:
    """One nested record per session about the judged sample; ``sizes`` of the bins in place of ``binned`` where the cohort is not written."""
    rates = decile_keep_rate(verdicts, n_bins).groupBy(SID).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("decile", F.round("keep_rate", 6).alias("r")))), lambda s: s["r"]
        ).alias("per_decile_keep_rate")
    )
    sizes = (bin_sizes(binned) if sizes is None else sizes).groupBy(SID).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("decile", "n"))), lambda s: s["n"]).alias("per_decile_count")
    )
    bounds = edges.groupBy(SID).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("edge", F.round("value", 6).alias("v")))), lambda s: s["v"]
        ).alias("decile_boundaries")
    )
    checks = failed_check_histogram(verdicts).groupBy(SID).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("failed_check", "n")))).alias("failed_check_histogram")
    )
    out = verdict_counts(verdicts).select(SID, F.struct("keep", "drop", "error", "auto_drop").alias("verdict_counts"))
    latency = latency_summary(verdicts).select(
        SID, F.struct("count", "p50_ms", "p90_ms", "p99_ms", "max_ms").alias("latency_summary")
    )
    for part in (rates, sizes, bounds, checks, latency):
        out = out.join(part, SID, "left")
    return out


def apply_meta(cohort: DataFrame, labels: DataFrame, frame: DataFrame, metrics: DataFrame, models: DataFrame) -> DataFrame:
    """One record per session about the final labels, with what went missing on the way."""
    total = cohort.groupBy(SID).agg(F.count("*").alias("cohort_total_input"))
    out = labels.groupBy(SID).agg(
        F.count("*").alias("labelled"),
        F.count_if(F.col("verdict") == "KEEP").alias("keep"),
        F.count_if(F.col("verdict") == "DROP").alias("drop"),
    )
    train_n = frame.groupBy(SID).agg(F.count("*").alias("training_n"))
    return (
        total.join(out, SID, "left")
        .join(train_n, SID, "left")
        .join(metrics, SID, "left")
        .join(models.select(SID, "n_keep", "n_drop"), SID, "left")
        .withColumn(
            "cohort_dropped_for_missing_embedding", F.col("cohort_total_input") - F.coalesce("labelled", F.lit(0))
        )
    )
