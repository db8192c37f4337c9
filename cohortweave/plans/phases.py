"""Harvest, refine and apply, each for all sessions at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, harvest as hv, judging, modelling, ratings, reports, sampling, strata as st, training
from ..params import ApplyParams, HarvestParams, RefineParams
from ..session import BROADCAST_BYTES, broadcast_if_small, cut

SID = "session_id"


def anchor_inputs(
    events: DataFrame,
    spans: DataFrame,
    corpus: DataFrame,
    p: HarvestParams = HarvestParams(),
    allow_unconverged: bool = False,
) -> DataFrame:
    """Anchors of the (converged) sessions: usable FITs with their span and chunk vectors.

    ``spans`` is (session_id, pk, span). FITs missing from the corpus are left out.
    """
    fits = ratings.fit_exemplars(events, "anchor").select(SID, "pk", "fit_ord", "chunk_id")
    if not allow_unconverged:
        ready = ratings.convergence(events, p).where("converged").select(SID)
        fits = fits.join(ready, SID, "left_semi")
    fits = cut(fits)
    vectors = corpus.select("pk", F.col("dense").cast("array<double>").alias("chunk")).join(
        broadcast_if_small(fits.select("pk").distinct()), "pk", "left_semi"
    )
    return fits.join(vectors, "pk").join(spans, [SID, "pk"]).select(
        SID, F.col("pk").alias("fit_pk"), "fit_ord", "chunk_id", "span", "chunk"
    )


@dataclass(frozen=True)
class Harvest:
    cohort: DataFrame
    anchors: DataFrame
    calibration: DataFrame
    gate: DataFrame
    recovery: DataFrame
    verdict: DataFrame
    attributed: DataFrame
    summary: DataFrame
    consistency: DataFrame
    budget: DataFrame
    intruders: DataFrame


def attributed_pass(anchors: DataFrame, corpus: DataFrame, max_k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Attributed admissions and per-anchor budgets, from one pass over the corpus.

    A caller who sets ``max_k`` gets the capped form (ranked hits, then regrouped)
    where some anchor admits more.
    """
    rows = cut(hv.cohort_pass(anchors, corpus))
    hits = rows.select(SID, "pk", F.explode("qualifying_fit_pks").alias("fit_pk"))
    budget = cut(hv.anchor_budget(hits, anchors, max_k))
    if max_k is None or budget.where(F.col("admitted") > max_k).isEmpty():
        return rows, budget
    return cut(hv.attribute(hv.closest_join(anchors, corpus, max_k), anchors)), budget


def _passed(recovery: DataFrame, p: HarvestParams) -> DataFrame:
    """The verdicts on a recovery check; one that FAILED is an error."""
    verdict = cut(hv.loo_verdict(recovery, p))
    failed = [r[SID] for r in verdict.where("verdict = 'FAILED'").select(SID).limit(5).collect()]
    if failed:
        raise ValueError(f"leave-one-out recovery failed for sessions {failed}")
    return verdict


def admitting_anchors(anchors: DataFrame, corpus: DataFrame, p: HarvestParams = HarvestParams()) -> DataFrame:
    """The anchors by which ``run_harvest`` admits rows, with their radius, after the same gate and recovery check.

    For what needs no written cohort (``operators/strata.py``). The check needs no ranks, so no vector of the corpus is read.
    """
    anchors = cut(anchors)
    gate = hv.quality_gate(cut(hv.calibrate(anchors, p)), p)
    kept = cut(hv.survivors(anchors, gate, p))
    nearest = cut(hv.anchor_nearest(kept))
    _passed(hv.held_out(kept, corpus, p, nearest), p)
    return cut(hv.with_radius(kept, hv.calibrate(kept, p, nearest), p))


def admitted_cohort(anchors: DataFrame, corpus: DataFrame, discard: DataFrame, p: HarvestParams = HarvestParams()) -> DataFrame:
    """The cohort of ``run_harvest`` without its reports: ``anchors`` as ``admitting_anchors`` gives them, the attributed rows written once.

    The ranks of left-out anchors and the budgets, which go into reports only, cost more than the cohort and are not computed.
    """
    rows = cut(hv.frequency_gate(hv.cohort_pass(anchors, corpus).where("NOT is_anchor"), p.anchor_frequency_gate))
    return hv.drop_discarded(rows, cut(discard.select(SID, "pk").distinct())).drop("is_anchor")


def run_harvest(
    anchors: DataFrame,
    corpus: DataFrame,
    not_fit: DataFrame,
    discard: DataFrame,
    p: HarvestParams = HarvestParams(),
    dry_run: bool = False,
) -> Harvest:
    """Calibrate, gate the anchors, check recovery, collect the cohort and gate it.

    A session whose recovery check FAILS stops the run with an error.
    """
    anchors = cut(anchors)
    first = cut(hv.calibrate(anchors, p))
    gate = cut(hv.quality_gate(first, p))
    kept = cut(hv.survivors(anchors, gate, p))
    nearest = cut(hv.anchor_nearest(kept))
    calibration = cut(hv.calibrate(kept, p, nearest))
    recovery = cut(hv.loo_recovery(kept, corpus, p, nearest))
    verdict = _passed(recovery, p)
    placed = hv.with_radius(kept, calibration, p)
    scan = corpus.limit(0) if dry_run else corpus
    attributed, budget = attributed_pass(placed, scan, p.max_k)
    candidates = attributed.where("NOT is_anchor")
    discard = cut(discard.select(SID, "pk").distinct())
    gated = hv.frequency_gate(candidates, p.anchor_frequency_gate)
    cohort = hv.drop_discarded(gated, discard).drop("is_anchor")
    return Harvest(
        cohort=cohort,
        anchors=kept,
        calibration=calibration,
        gate=gate,
        recovery=recovery,
        verdict=verdict,
        attributed=attributed,
        summary=hv.frequency_summary(candidates, p.anchor_frequency_gate),
        consistency=hv.cohort_consistency(attributed, kept, p.anchor_frequency_gate),
        budget=budget,
        intruders=hv.intrusions(cohort, not_fit),
    )


def harvest_record(h: Harvest, discard: DataFrame) -> DataFrame:
    total = discard.select(SID, "pk").distinct().groupBy(SID).agg(F.count("*").alias("discard_total"))
    return reports.harvest_meta(
        h.calibration, h.gate, h.recovery, h.verdict, h.cohort, h.summary, h.intruders, h.consistency,
        hv.distance_summary(h.cohort), total,
    )


@dataclass(frozen=True)
class Refine:
    sample: DataFrame
    sizes: DataFrame
    edges: DataFrame
    exemplars: DataFrame
    verdicts: DataFrame
    meta: DataFrame


def run_refine(
    cohort: DataFrame,
    exclude: DataFrame,
    intruders: DataFrame,
    content: DataFrame,
    checks: Sequence[str],
    answerer: judging.Answerer,
    rubrics: DataFrame,
    fits: DataFrame,
    not_fits: DataFrame,
    p: RefineParams = RefineParams(),
) -> Refine:
    """Draw a distance-stratified sample, have it judged by each session's rubric, and report on it.

    ``rubrics`` are (session_id, rubric_version, rubric_text, prompt_sha256); ``fits`` and ``not_fits`` are rated examples (session_id, ord,
    vec, span_text), of which the judge sees a diverse few. Verdicts are written before they are reported on, so
    report and rows are of the same answers.
    """
    sample, binned = sampling.stratified_sample(cohort, exclude, intruders, p)
    strata = st.Strata(cut(sample), cut(sampling.decile_edges(binned, p.n_bins)), cut(sampling.bin_sizes(binned)))
    return judged_strata(strata, content, checks, answerer, rubrics, fits, not_fits, p)


def judged_strata(
    strata: st.Strata,
    content: DataFrame,
    checks: Sequence[str],
    answerer: judging.Answerer,
    rubrics: DataFrame,
    fits: DataFrame,
    not_fits: DataFrame,
    p: RefineParams = RefineParams(),
) -> Refine:
    """``run_refine`` from a drawn sample on, of which ``drawn`` has an ``arm`` (``sampling.auto_drop_split``)."""
    sample = strata.drawn
    kinds = (("FIT", fits, p.max_fit_examples), ("NOT_FIT", not_fits, p.max_not_fit_examples))
    chosen = [
        sampling.exemplar_cap(rows, most).select(SID, F.lit(kind).alias("kind"), "ord", "span_text") for kind, rows, most in kinds
    ]
    exemplars = cut(chosen[0].unionByName(chosen[1]))
    context = judging.judge_context(rubrics, exemplars)
    judged = judging.judge(sample, content, checks, answerer, p.max_retries, context=context)
    verdicts = cut(judging.pinned(judged, rubrics))
    shown = exemplars.groupBy(SID).agg(
        F.count_if(F.col("kind") == "FIT").alias("fit_examples"), F.count_if(F.col("kind") == "NOT_FIT").alias("not_fit_examples")
    )
    meta = reports.refine_meta(verdicts, None, strata.edges, p.n_bins, strata.sizes).join(broadcast_if_small(shown), SID, "left")
    meta = meta.fillna(0, ["fit_examples", "not_fit_examples"]).join(rubrics.select(SID, "rubric_version", "prompt_sha256"), SID)
    return Refine(sample, strata.sizes, strata.edges, exemplars, verdicts, meta)


@dataclass(frozen=True)
class Applied:
    frame: DataFrame
    scaler: DataFrame
    models: DataFrame
    pool: DataFrame
    metrics: DataFrame


def apply_train(verdicts: DataFrame, corpus: DataFrame, p: ApplyParams = ApplyParams()) -> Applied:
    """Scaler, classifier on all labelled rows, and the k-fold pool that evaluates it."""
    rows = modelling.with_embeddings(modelling.labelled(verdicts), corpus)
    rows = cut(rows.select(SID, "pk", "label", "decile", "nearest_fit_distance", "dense"))
    scaler = cut(modelling.fit_scaler(rows))
    frame = cut(modelling.feature_frame(rows, scaler))
    thin = modelling.require_balance(frame, p.n_splits).where("NOT enough").select(SID).limit(5).collect()
    if thin:
        raise ValueError(f"too few rows of one class for {p.n_splits} folds: sessions {[r[SID] for r in thin]}")
    models = cut(training.train(frame, p).join(broadcast_if_small(scaler), SID))
    pool = cut(training.kfold_pool(frame, p))
    metrics = evaluation.evaluate(pool, p.confidence_threshold, p.min_precision)
    return Applied(frame, scaler, models, pool, metrics)


def score_cohort(
    cohort: DataFrame, corpus: DataFrame, models: DataFrame, tau: float | None, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Scores and verdicts of a stored cohort; its vectors are not moved (``modelling.with_embeddings``)."""
    rows = modelling.with_embeddings(cohort, corpus, limit)
    frame = modelling.feature_frame(rows, models.select(SID, "scaler_mean", "scaler_scale"))
    return modelling.score(frame, models, tau)


def apply_calibrate(scored: DataFrame, tau: float, p: ApplyParams = ApplyParams()) -> tuple[DataFrame, DataFrame]:
    """Projection and borderline rows at ``tau`` over an already scored cohort."""
    binned = cut(sampling.decile_bins(scored, p.n_bins))
    return (
        evaluation.project(binned, tau, p.n_bins),
        sampling.borderline(binned, tau, p.band, p.borderline_k, p.seed),
    )


def apply_finalize(
    applied: Applied,
    scored: DataFrame,
    tau: float,
    p: ApplyParams = ApplyParams(),
    allow_low_precision: bool = False,
    carried: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Labels at ``tau`` (with the ``carried`` columns of ``scored``) and the operator decision; precision below the bar needs the override."""
    taus = applied.models.select(SID, F.lit(tau).alias("threshold"))
    decision = modelling.precision_bar(
        evaluation.final_metrics(applied.pool, taus), p.min_precision, allow_low_precision
    )
    refused = [r[SID] for r in decision.where("operator_decision = 'refused'").select(SID).limit(5).collect()]
    if refused:
        raise ValueError(f"precision below {p.min_precision} for sessions {refused}")
    labels = scored.withColumn("verdict", modelling.verdict_at(F.col("p_keep"), F.lit(tau)))
    return labels.select(SID, "pk", "verdict", "p_keep", *carried), decision


def apply_reuse(
    cohort: DataFrame,
    corpus: DataFrame,
    models: DataFrame,
    pins: DataFrame,
    p: ApplyParams = ApplyParams(),
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Labels from stored classifiers; a classifier of another rubric is an error."""
    return score_cohort(cohort, corpus, reusable(models, pins, p), None, limit)


def reuse_pass(
    anchors: DataFrame, corpus: DataFrame, models: DataFrame, pins: DataFrame, f: int, discard: DataFrame, p: ApplyParams = ApplyParams()
) -> DataFrame:
    """``apply_reuse`` of the rows that at least ``f`` anchors admit, scored where their vectors are read; no cohort is written or moved."""
    checked = cut(reusable(models, pins, p).select(SID, "coef", "intercept", "scaler_mean", "scaler_scale", "threshold"))
    rows = hv.score_pass(anchors, checked, corpus, f, discard=discard).join(broadcast_if_small(checked.select(SID, "threshold")), SID)
    return rows.select(SID, "pk", "nearest_fit_distance", "p_keep", modelling.verdict_at(F.col("p_keep"), F.col("threshold")).alias("verdict"))


def reusable(models: DataFrame, pins: DataFrame, p: ApplyParams = ApplyParams()) -> DataFrame:
    """Stored classifiers whose threshold is an error where they are of another rubric."""
    guard = modelling.pin_guard(models, pins)
    checked = modelling.checked_models(models, p.embedding_dim).join(guard, SID)
    threshold = F.when(F.col("accepted"), F.col("threshold")).otherwise(
        F.raise_error(F.concat(F.lit("stored classifier does not match the rubric: "), F.col("mismatch"))).cast("double")
    )
    return checked.withColumn("threshold", threshold)


