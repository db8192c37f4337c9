"""Radius calibration, the anchor gates, the radius pass and its reports.

Anchor tables are (session_id, fit_pk, fit_ord, chunk_id, span, chunk); every
operator works on all sessions at once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import cosine_distance
from ..params import HarvestParams
from ..session import broadcast_if_small, cut, narrowed
from .blocks import (
    MAX_BLOCK_ROWS,
    against,
    closer_rows,
    closest_rows,
    cohort_rows,
    dealt,
    held_out_quantiles,
    member_rows,
    nearest_anchors,
    own_distances,
    radius_rows,
    scored_rows,
)
from .ordering import five_number, prefix

SID, FIT = "session_id", "fit_pk"


def _types(anchors: DataFrame, corpus: DataFrame | None = None) -> tuple[str, str, str]:
    kinds = dict(anchors.dtypes)
    return kinds[SID], kinds[FIT], dict(corpus.dtypes)["pk"] if corpus is not None else kinds[FIT]


def _within_sessions(rows: DataFrame, others: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` over the rows of a session and the others of the same session: an equi-join, one rater's work per group."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    fresh = others.select(*[F.col(c).alias(c) for c in others.columns])  # so that a table can meet itself

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return out.empty_table()
        return pa.Table.from_batches(list(kernel(right, out)(iter(left.to_batches()))), out)

    return rows.groupBy(SID).cogroup(fresh.groupBy(SID)).applyInArrow(pair, schema)


def anchor_nearest(anchors: DataFrame) -> DataFrame:
    """Distance of each anchor's span to its closest and second closest other span."""
    sid, fit, _ = _types(anchors)
    side = anchors.select(SID, FIT, "fit_ord", "span")
    near = _within_sessions(side, side, nearest_anchors, f"{SID} {sid}, {FIT} {fit}, other_pk {fit}, other_ord long, d double")
    two = near.groupBy(SID, FIT).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("d", "other_ord", "other_pk"))), 1, 2).alias("near")
    )
    inf = F.lit(float("inf"))
    return two.select(
        SID,
        FIT,
        F.col("near")[0]["other_pk"].alias("nearest_pk"),
        F.col("near")[0]["d"].alias("d1"),
        F.coalesce(F.get("near", F.lit(1))["d"], inf).alias("d2"),
    )


def calibrate(anchors: DataFrame, p: HarvestParams = HarvestParams(), nearest: DataFrame | None = None) -> DataFrame:
    """T (quantile of nearest-span distances), delta and radius per anchor.

    Sessions with fewer than two anchors fail at run time.
    """
    nearest = anchor_nearest(anchors) if nearest is None else nearest
    per = anchors.select(
        SID, FIT, "fit_ord", "chunk_id", cosine_distance(F.col("span"), F.col("chunk")).alias("delta")
    ).join(nearest.select(SID, FIT, F.col("d1").alias("nearest_distance")), [SID, FIT], "left")
    session = per.groupBy(SID).agg(
        F.percentile("nearest_distance", F.lit(p.t_quantile)).alias("T"),
        F.min("delta").alias("_min_delta"),
        F.count("*").alias("n_fit"),
    )
    t = F.when(F.col("n_fit") >= 2, F.col("T")).otherwise(
        F.raise_error(F.lit("calibration needs at least two anchors per session")).cast("double")
    )
    return per.join(broadcast_if_small(session.withColumn("T", t)), SID).select(
        SID,
        FIT,
        "fit_ord",
        "chunk_id",
        "nearest_distance",
        "delta",
        "T",
        (F.col("T") + F.col("delta")).alias("T_prime"),
        (F.col("T") + F.col("_min_delta")).alias("T_prime_out"),
        "n_fit",
    )


def quality_gate(calibration: DataFrame, p: HarvestParams = HarvestParams()) -> DataFrame:
    """Which anchors sit too far from their own chunk, and why.

    Reasons: ``exceeds_T`` and ``exceeds_median_multiple`` (of the floored median delta).
    """
    session = calibration.groupBy(SID).agg(
        F.percentile("delta", F.lit(0.5)).alias("median_delta"), F.max("delta").alias("_max_delta")
    )
    cutoff = F.lit(p.s2c_outlier_multiple) * F.greatest(F.col("median_delta"), F.lit(p.median_floor))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("delta") > F.col("T"), "exceeds_T"),
            F.when(F.col("delta") > F.col("cutoff"), "exceeds_median_multiple"),
        )
    )
    judged = (
        calibration.join(broadcast_if_small(session), SID)
        .withColumn("cutoff", cutoff)
        .withColumn("reasons", reasons)
        .withColumn("dropped", F.size("reasons") > 0)
    )
    per_session = Window.partitionBy(SID)
    survivors = F.sum((~F.col("dropped")).cast("int")).over(per_session)
    return judged.select(
        SID,
        FIT,
        "chunk_id",
        "delta",
        "T",
        "median_delta",
        "cutoff",
        (F.col("median_delta") < p.median_floor).alias("floor_applied"),
        ((F.col("median_delta") < p.median_epsilon) & (F.col("_max_delta") > p.median_epsilon)).alias("bimodal"),
        "reasons",
        "dropped",
        survivors.alias("survivors"),
        (F.max("dropped").over(per_session) & (survivors < p.min_fit)).alias("thin"),
    )


def survivors(anchors: DataFrame, gate: DataFrame, p: HarvestParams = HarvestParams()) -> DataFrame:
    """Anchors the quality gate keeps.

    Fails at run time when a session keeps fewer than the structural floor or
    fewer than the anchor-frequency gate asks for.
    """
    kept = gate.where("NOT dropped").select(
        SID,
        F.when(F.col("survivors") < p.survivor_floor, F.raise_error(F.lit("too few anchors survive the quality gate")).cast(dict(anchors.dtypes)[FIT]))
        .when(
            F.col("survivors") < p.anchor_frequency_gate,
            F.raise_error(F.lit("anchor_frequency_gate exceeds the surviving anchors")).cast(dict(anchors.dtypes)[FIT]),
        )
        .otherwise(F.col(FIT))
        .alias(FIT),
    )
    return anchors.join(kept, [SID, FIT], "left_semi")


def with_radius(anchors: DataFrame, calibration: DataFrame, p: HarvestParams = HarvestParams()) -> DataFrame:
    radius = "T_prime" if p.radius_scheme == "per_fit" else "T_prime_out"
    return anchors.join(
        calibration.select(SID, FIT, F.col(radius).alias("radius"), "delta"), [SID, FIT]
    )


def radius_join(anchors: DataFrame, corpus: DataFrame, max_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """All (session, anchor, row) with the row inside the anchor's radius, and the distance."""
    sid, fit, pk = _types(anchors, corpus)
    return against(
        dealt(corpus.select("pk", "dense")),
        anchors.select(SID, FIT, "fit_ord", "span", "radius"),
        radius_rows,
        f"{SID} {sid}, {FIT} {fit}, pk {pk}, d double",
        block_key=[SID, FIT],
        max_rows=max_rows,
    )


def closest_join(anchors: DataFrame, corpus: DataFrame, max_k: int, max_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """The ``max_k`` closest rows inside each anchor's radius, as ``cap_hits`` of the whole radius join, which is never written."""
    sid, fit, pk = _types(anchors, corpus)
    near = against(
        dealt(corpus.select("pk", "dense")),
        anchors.select(SID, FIT, "fit_ord", "span", "radius"),
        closest_rows(max_k),
        f"{SID} {sid}, {FIT} {fit}, pk {pk}, d double",
        block_key=[SID, FIT],
        max_rows=max_rows,
    )
    return cap_hits(cut(near), max_k)


def cohort_pass(anchors: DataFrame, corpus: DataFrame, max_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """Radius join and attribution in one map-only pass over the corpus.

    Fragments of one session stay together, so rows come out whole in the
    fragmented form too.
    """
    sid, fit, pk = _types(anchors, corpus)
    return against(
        dealt(corpus.select("pk", "dense")),
        anchors.select(SID, FIT, "fit_ord", "chunk_id", "span", "radius"),
        cohort_rows,
        f"{SID} {sid}, pk {pk}, nearest_fit_pk {fit}, nearest_fit_label string, nearest_fit_distance double, "
        f"threshold_T_prime double, qualifying_fit_count int, qualifying_fit_pks array<{fit}>, is_anchor boolean",
        block_key=[SID],
        max_rows=max_rows,
    )


def with_skip(anchors: DataFrame, skip: DataFrame | None) -> DataFrame:
    """The anchors, the first of each session with the keys ``skip`` (session_id, pk) that its passes leave out (one person's ratings)."""
    kind = dict(anchors.dtypes)[FIT]
    if skip is None:
        return anchors.withColumn("skip", F.array().cast(f"array<{kind}>"))
    per = skip.groupBy(SID).agg(F.collect_set(F.col("pk").cast(kind)).alias("_skip"))
    return on_first(anchors.join(broadcast_if_small(per), SID, "left"), {"skip": f"array<{kind}>"})


def on_first(side: DataFrame, lists: dict[str, str]) -> DataFrame:
    """Columns ``_name`` as ``name``, empty on all but a session's first anchor."""
    first = F.row_number().over(Window.partitionBy(SID).orderBy("fit_ord", FIT)) == 1
    return side.withColumns(
        {name: F.coalesce(F.when(first, F.col(f"_{name}")), F.array().cast(kind)) for name, kind in lists.items()}
    ).drop(*[f"_{name}" for name in lists])


def member_pass(
    anchors: DataFrame, corpus: DataFrame, f: int, discard: DataFrame | None = None, carried: tuple[str, ...] = ("pk",), max_rows: int = MAX_BLOCK_ROWS // 2
) -> DataFrame:
    """Session, distance and the ``carried`` columns of every row that at least ``f`` anchors admit, map-only and never written.

    The rows of the gated cohort without those in ``discard``; what a row's key leads to is joined to the corpus before, once, and not to every member.
    """
    kinds = dict(corpus.dtypes)
    side = with_skip(anchors.select(SID, FIT, "fit_ord", "span", "radius"), discard)
    return against(
        dealt(corpus.select("pk", "dense", *[c for c in carried if c != "pk"])),
        cut(side),
        member_rows(f, list(carried)),
        ", ".join([f"{SID} {dict(anchors.dtypes)[SID]}, nearest_fit_distance double", *[f"{c} {kinds[c]}" for c in carried]]),
        block_key=[SID],
        max_rows=max_rows,
    )


def intrusion_pass(anchors: DataFrame, corpus: DataFrame, f: int, not_fit: DataFrame, discard: DataFrame | None = None) -> DataFrame:
    """``intrusions`` of a cohort that is not written: only the rated rows of a session meet its anchors."""
    sid, _, pk = _types(anchors, corpus)
    rated = not_fit.select(SID, "pk").distinct()
    if discard is not None:
        rated = drop_discarded(rated, discard)
    rows = rated.join(corpus.select("pk", "dense"), "pk")
    return _within_sessions(rows, anchors.select(SID, FIT, "fit_ord", "span", "radius"), member_rows(f, ["pk"]), f"{SID} {sid}, nearest_fit_distance double, pk {pk}").select(SID, "pk")


def score_pass(
    anchors: DataFrame,
    models: DataFrame,
    corpus: DataFrame,
    f: int,
    max_rows: int = MAX_BLOCK_ROWS // 2,
    discard: DataFrame | None = None,
    twice: bool = False,
) -> DataFrame:
    """Distance and ``p_keep`` of every row at least ``f`` anchors admit, map-only.

    The same rows as joining the gated cohort (without ``discard``) back to its vectors and scoring
    it, without moving a vector; also fits a stream of new chunks. ``twice`` adds ``own``, the score computed row by row.
    """
    sid, fit, pk = _types(anchors, corpus)
    side = anchors.select(SID, FIT, "fit_ord", "span", "radius")
    side = (side if discard is None else with_skip(side, discard)).join(
        broadcast_if_small(models.select(SID, "coef", "intercept", "scaler_mean", "scaler_scale")), SID
    )
    return against(
        dealt(corpus.select("pk", "dense")),
        cut(side),
        scored_rows(f, twice),
        f"{SID} {sid}, pk {pk}, nearest_fit_distance double, p_keep double" + ", own double" * twice,
        block_key=[SID],
        max_rows=max_rows,
    )


def attribute(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """Nearest anchor (raw distance, earliest on ties) and the admitting set of each row."""
    named = hits.join(
        broadcast_if_small(anchors.select(SID, FIT, "fit_ord", "chunk_id", "radius")), [SID, FIT]
    )
    own = anchors.select(SID, F.col(FIT).alias("pk"), F.lit(True).alias("is_anchor"))
    nearest = F.min(F.struct("d", "fit_ord", FIT, "chunk_id", "radius"))
    return (
        named.groupBy(SID, "pk")
        .agg(nearest.alias("n"), F.array_sort(F.collect_set(FIT)).alias("qualifying_fit_pks"))
        .join(broadcast_if_small(own), [SID, "pk"], "left")
        .select(
            SID,
            "pk",
            F.col(f"n.{FIT}").alias("nearest_fit_pk"),
            F.col("n.chunk_id").alias("nearest_fit_label"),
            F.col("n.d").alias("nearest_fit_distance"),
            F.col("n.radius").alias("threshold_T_prime"),
            F.size("qualifying_fit_pks").alias("qualifying_fit_count"),
            "qualifying_fit_pks",
            F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"),
        )
    )


def anchor_budget(hits: DataFrame, anchors: DataFrame, max_k: int | None = None) -> DataFrame:
    """Admitted rows per anchor and, where there is a budget, whether it ran out."""
    admitted = F.coalesce("admitted", F.lit(0))
    per = hits.groupBy(SID, FIT).agg(F.count("*").alias("admitted"))
    return anchors.select(SID, FIT).join(per, [SID, FIT], "left").select(
        SID,
        FIT,
        (admitted if max_k is None else F.least(admitted, F.lit(max_k))).alias("kept"),
        admitted.alias("admitted"),
        (F.lit(False) if max_k is None else admitted >= max_k).alias("budget_exhausted"),
    )


def cap_hits(hits: DataFrame, max_k: int) -> DataFrame:
    """The ``max_k`` closest admitted rows of each anchor; untouched where no anchor has more."""
    over = hits.groupBy(SID, FIT).agg(F.count("*").alias("n")).where(F.col("n") > max_k)
    if over.isEmpty():
        return hits
    ranked = prefix(hits, [SID, FIT], [F.col("d").asc(), F.col("pk").asc()], rank="_place")
    return ranked.where(F.col("_place") <= max_k).drop("_place")


def frequency_gate(cohort: DataFrame, f: int) -> DataFrame:
    return cohort.where(F.col("qualifying_fit_count") >= f)


def frequency_summary(cohort: DataFrame, f: int) -> DataFrame:
    """Kept and dropped rows, and min / integer median / max of the kept admission counts."""
    hist = cohort.groupBy(SID, "qualifying_fit_count").agg(F.count("*").alias("n"))
    kept = F.col("qualifying_fit_count") >= f
    w = Window.partitionBy(SID).orderBy("qualifying_fit_count")
    placed = hist.withColumn("_n", F.when(kept, F.col("n")).otherwise(0)).withColumn("_upto", F.sum("_n").over(w))
    total = placed.withColumn("_kept", F.sum("_n").over(Window.partitionBy(SID)))
    lo, hi = F.floor((F.col("_kept") + 1) / 2), F.floor(F.col("_kept") / 2) + 1
    q = F.col("qualifying_fit_count")
    return total.groupBy(SID).agg(
        F.sum("_n").alias("kept"),
        F.sum(F.when(~kept, F.col("n")).otherwise(0)).alias("dropped"),
        F.coalesce(F.min(F.when(kept, q)), F.lit(0)).alias("count_min"),
        F.coalesce(
            F.floor((F.min(F.when(kept & (F.col("_upto") >= lo), q)) + F.min(F.when(kept & (F.col("_upto") >= hi), q))) / 2),
            F.lit(0),
        ).alias("count_median"),
        F.coalesce(F.max(F.when(kept, q)), F.lit(0)).alias("count_max"),
        F.sum(F.when(q == f, F.col("n")).otherwise(0)).alias("at_f"),
        F.sum(F.when(q > f, F.col("n")).otherwise(0)).alias("above_f"),
    )


def cohort_consistency(attributed: DataFrame, anchors: DataFrame, f: int) -> DataFrame:
    """Does each anchor's own chunk reach the gate (anchor rows included)?"""
    own = attributed.where("is_anchor").select(SID, F.col("pk").alias(FIT), "qualifying_fit_count")
    return anchors.select(SID, FIT, "chunk_id").join(own, [SID, FIT], "left").select(
        SID,
        FIT,
        F.col("chunk_id").alias("fit_chunk_id"),
        (F.coalesce("qualifying_fit_count", F.lit(0)) >= f).alias("own_chunk_retained"),
    )


def drop_discarded(cohort: DataFrame, discard: DataFrame) -> DataFrame:
    return cohort.join(broadcast_if_small(discard.select(SID, "pk").distinct()), [SID, "pk"], "left_anti")


def intrusions(cohort: DataFrame, not_fit: DataFrame) -> DataFrame:
    """Retained rows that had been rated NOT_FIT."""
    return cohort.join(broadcast_if_small(not_fit.select(SID, "pk").distinct()), [SID, "pk"], "left_semi").select(
        SID, "pk"
    )


def _own_distances(anchors: DataFrame, held: DataFrame) -> DataFrame:
    """Each held-out anchor's own chunk against the other anchors' recalibrated radii."""
    sid, fit, _ = _types(anchors)
    found = _within_sessions(
        held.select(SID, FIT, "chunk", "t_rest"),
        anchors.select(SID, FIT, "span", "delta"),
        own_distances,
        f"{SID} {sid}, {FIT} {fit}, own_distance double",
    )
    return found.groupBy(SID, FIT).agg(F.min("own_distance").alias("own_distance"))


def held_out(
    anchors: DataFrame, corpus: DataFrame, p: HarvestParams = HarvestParams(), nearest: DataFrame | None = None
) -> DataFrame:
    """Leave-one-out without ranks: each anchor with the rest's recalibrated radius and the distance at which the rest admits
    its own chunk (``own_distance``, null where it does not). Only the corpus's keys are read."""
    sid, fit, _ = _types(anchors)
    nearest = anchor_nearest(anchors) if nearest is None else nearest
    t_rest = _within_sessions(
        anchors.select(SID, FIT), nearest, held_out_quantiles(p.t_quantile), f"{SID} {sid}, {FIT} {fit}, t_rest double"
    )
    side = cut(
        anchors.select(
            SID, FIT, "fit_ord", "chunk_id", "span", "chunk",
            cosine_distance(F.col("span"), F.col("chunk")).alias("delta"),
        ).join(t_rest, [SID, FIT])
    )
    present = narrowed(corpus.select(F.col("pk").alias(FIT)), side, FIT)
    own = _own_distances(side, side.join(present, FIT, "left_semi"))
    full = side.join(own, [SID, FIT], "left")
    return full.withColumn("recovered", F.col("own_distance").isNotNull())


def loo_recovery(
    anchors: DataFrame,
    corpus: DataFrame,
    p: HarvestParams = HarvestParams(),
    nearest: DataFrame | None = None,
    max_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """Leave-one-out: does the rest of a session still admit each anchor's own chunk, and at what rank?

    The corpus is read once. No candidate list is built per held-out anchor:
    every task only counts the rows that come before the own chunk.
    """
    sid, fit, _ = _types(anchors)
    full = cut(held_out(anchors, corpus, p, nearest))
    counted = against(
        dealt(corpus.select("pk", "dense")),
        full.select(SID, FIT, "fit_ord", "span", "delta", "t_rest", "own_distance"),
        closer_rows,
        f"{SID} {sid}, {FIT} {fit}, closer long",
        block_key=[SID],
        max_rows=max_rows,
    )
    ranks = counted.groupBy(SID, FIT).agg(F.sum("closer").alias("closer"))
    return full.join(ranks, [SID, FIT], "left").select(
        SID,
        FIT,
        F.col("chunk_id").alias("fit_chunk_id"),
        "recovered",
        F.col("t_rest").alias("recalibrated_T"),
        F.when(F.col("recovered"), F.coalesce("closer", F.lit(0)) + 1).alias("rank_of_own_pk"),
        F.col("own_distance").alias("distance_of_own_pk"),
    )


def loo_verdict(recovery: DataFrame, p: HarvestParams = HarvestParams()) -> DataFrame:
    per = recovery.groupBy(SID).agg(F.count_if("recovered").alias("recovered"), F.count("*").alias("total"))
    share = F.col("recovered") / F.col("total")
    return per.withColumn(
        "verdict",
        F.when(share >= p.healthy_share, "HEALTHY").when(share < p.failed_share, "FAILED").otherwise("FLAGGED"),
    )


def distance_summary(cohort: DataFrame, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    return five_number(cohort, "nearest_fit_distance", keys)
