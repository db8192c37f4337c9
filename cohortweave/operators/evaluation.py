"""Precision, recall, thresholds and projections over scored rows.

``pool`` tables are (session_id, pk, label, p_keep[, rep]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .ordering import prefix

SID = "session_id"
HIST_BINS = 25


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(pool: DataFrame, tau: Column | float, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    keep = F.col("p_keep") >= (tau if isinstance(tau, Column) else F.lit(tau))
    true = F.col("label") == 1
    return pool.groupBy(*keys).agg(
        F.count_if(keep & true).alias("tp"),
        F.count_if(keep & ~true).alias("fp"),
        F.count_if(~keep & true).alias("fn"),
        F.count_if(~keep & ~true).alias("tn"),
    )


def precision_recall_at(pool: DataFrame, tau: Column | float, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    """Precision and recall at ``p_keep >= tau``; 0 where undefined."""
    return confusion(pool, tau, keys).select(
        *keys,
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )


def confusion_from_rates(rates: DataFrame) -> DataFrame:
    """Counts recovered from precision, recall and class sizes (keep_n, drop_n)."""
    tp = F.floor(F.col("recall") * F.col("keep_n") + 0.5)
    fp = F.when(
        F.col("precision") > 0, F.greatest(F.lit(0), F.floor(F.col("tp") / F.col("precision") + 0.5) - F.col("tp"))
    ).otherwise(0)
    return (
        rates.where("keep_n > 0")
        .withColumn("tp", tp)
        .withColumn("fn", F.col("keep_n") - F.col("tp"))
        .withColumn("fp", fp)
        .withColumn("tn", F.greatest(F.lit(0), F.col("drop_n") - F.col("fp")))
    )


def full_curve(pool: DataFrame, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    """Precision and recall at every distinct score, with its position in ascending order."""
    per = pool.groupBy(*keys, F.col("p_keep").alias("threshold")).agg(
        F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos")
    )
    placed = prefix(per, keys, [F.col("threshold").asc()], sums={"upto_n": "n", "upto_pos": "pos"}, rank="position")
    totals = per.groupBy(*keys).agg(
        F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"), F.count("*").alias("points")
    )
    at_n = F.col("all_n") - F.col("upto_n") + F.col("n")
    at_pos = F.col("all_pos") - F.col("upto_pos") + F.col("pos")
    return placed.join(broadcast_if_small(totals), list(keys)).select(
        *keys,
        (F.col("position") - 1).alias("position"),
        "points",
        "threshold",
        (at_pos / at_n).alias("precision"),
        F.coalesce(F.try_divide(at_pos, F.col("all_pos")), F.lit(1.0)).alias("recall"),
    )


def pr_curve(pool: DataFrame, max_points: int | None = None, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    """The curve; for plots, thinned to about ``max_points``, its last point always staying."""
    full = full_curve(pool, keys)
    if max_points is None:
        return full.drop("points")
    step = F.greatest(F.lit(1), F.floor(F.col("points") / max_points))
    thin = (F.col("points") <= max_points) | (F.col("position") % step == 0) | (F.col("position") == F.col("points") - 1)
    return full.where(thin).drop("points")


def select_threshold(pool: DataFrame, bar: float, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    """Lowest score whose pooled precision reaches ``bar``; null when none does."""
    return full_curve(pool, keys).groupBy(*keys).agg(
        F.min(F.when(F.col("precision") >= bar, F.col("threshold"))).alias("threshold")
    )


def threshold_suggestions(curve: DataFrame, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    """Best F1, and the first points reaching precision 0.90 and 0.95 (else the last point)."""
    p, r, pos = F.col("precision"), F.col("recall"), F.col("position")
    f1 = _ratio(2 * p * r, p + r)
    point = F.struct(F.col("threshold"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))

    def first_at(level: float) -> Column:
        return F.coalesce(F.min_by(point, F.when(p >= level, pos)), F.max_by(point, pos))

    wide = curve.groupBy(*keys).agg(
        F.array(
            F.struct(F.lit("max_f1").alias("label"), F.max_by(point, F.struct(f1, -pos)).alias("at")),
            F.struct(F.lit("p90").alias("label"), first_at(0.90).alias("at")),
            F.struct(F.lit("p95").alias("label"), first_at(0.95).alias("at")),
        ).alias("s")
    )
    tau = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.floor(F.col("s.at.threshold") * 100 + 0.5) / 100))
    return wide.select(*keys, F.explode("s").alias("s")).select(
        *keys, "s.label", tau.alias("tau"), "s.at.precision", "s.at.recall", "s.at.f1"
    )


def cv_precision(pool: DataFrame, tau: DataFrame, default: float, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    """Mean and population deviation of the per-repeat precision at the chosen threshold."""
    at = pool.join(broadcast_if_small(tau.select(*keys, F.col("threshold").alias("_t"))), list(keys), "left")
    per = precision_recall_at(at, F.coalesce(F.col("_t"), F.lit(default)), (*keys, "rep"))
    return per.groupBy(*keys).agg(
        F.avg("precision").alias("cv_precision_mean"), F.stddev_pop("precision").alias("cv_precision_std")
    )


def per_row_p(rows: DataFrame, pool: DataFrame, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    """Mean held-out score of every row; rows never held out get the pooled mean."""
    mean = pool.groupBy(*keys, "pk").agg(F.avg("p_keep").alias("_mean"))
    fill = pool.groupBy(*keys).agg(F.avg("p_keep").alias("_fill"))
    return (
        rows.join(mean, [*keys, "pk"], "left")
        .join(broadcast_if_small(fill), list(keys), "left")
        .withColumn("p_keep", F.coalesce("_mean", "_fill"))
        .drop("_mean", "_fill")
    )


def project(scored: DataFrame, tau: float, n_bins: int = 10, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    """KEEP and DROP counts at ``tau`` and the keep rate of every decile (null when empty)."""
    keep = F.col("p_keep") >= tau
    return projected(scored.groupBy(*keys, "decile").agg(F.count("*").alias("n"), F.count_if(keep).alias("kept")), n_bins, keys)


def projected(per: DataFrame, n_bins: int = 10, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    """``project`` from the rows ``n`` and kept rows ``kept`` of every decile."""
    total = per.groupBy(*keys).agg(F.sum("kept").alias("keep"), F.sum("n").alias("total"))
    grid = total.withColumn("decile", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return grid.join(per, [*keys, "decile"], "left").select(
        *keys,
        "decile",
        F.round(F.try_divide("kept", "n"), 6).alias("keep_rate"),
        "keep",
        (F.col("total") - F.col("keep")).alias("drop"),
        "total",
    )


def score_histogram(pool: DataFrame, bins: int = HIST_BINS, keys: tuple[str, ...] = (SID,)) -> DataFrame:
    """Counts of positive and negative rows in equal score bins, empty bins included."""
    slot = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("p_keep") * bins))).cast("int")
    per = pool.groupBy(*keys, slot.alias("bin")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    grid = pool.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(per, [*keys, "bin"], "left").fillna(0, ["pos", "neg"])


def evaluate(pool: DataFrame, tau: float, bar: float) -> DataFrame:
    """Headline metrics of a k-fold pool per session."""
    chosen = select_threshold(pool, bar)
    return (
        precision_recall_at(pool, tau)
        .join(chosen.withColumnRenamed("threshold", "threshold_selected_by_cv"), SID)
        .join(cv_precision(pool, chosen, tau), SID)
    )


def final_metrics(pool: DataFrame, taus: DataFrame) -> DataFrame:
    """Precision and recall of the pool recomputed at each session's chosen threshold."""
    at = pool.join(broadcast_if_small(taus.select(SID, F.col("threshold").alias("_t"))), SID)
    counts = at.groupBy(SID, F.col("_t").alias("threshold")).agg(
        F.count_if((F.col("p_keep") >= F.col("_t")) & (F.col("label") == 1)).alias("tp"),
        F.count_if(F.col("p_keep") >= F.col("_t")).alias("kept"),
        F.count_if(F.col("label") == 1).alias("pos"),
    )
    return counts.select(
        SID,
        "threshold",
        _ratio(F.col("tp"), F.col("kept")).alias("precision"),
        _ratio(F.col("tp"), F.col("pos")).alias("recall"),
    )


