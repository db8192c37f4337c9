"""Features of labelled and cohort rows, scoring with a classifier, and the checks around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import BROADCAST_BYTES, broadcast_if_small, laid_out, lies_by, measured, narrowed, planned_bytes

SID = "session_id"


def fit_scaler(frame: DataFrame) -> DataFrame:
    """Mean and floored population deviation of the distance, per session."""
    return frame.groupBy(SID).agg(
        F.avg("nearest_fit_distance").alias("scaler_mean"),
        F.greatest(F.stddev_pop("nearest_fit_distance"), F.lit(1e-12)).alias("scaler_scale"),
    )


def labelled(verdicts: DataFrame) -> DataFrame:
    """KEEP/DROP rows (auto-drops included) as labels 1/0; ERROR rows leave."""
    return verdicts.where(F.col("verdict").isin("KEEP", "DROP")).withColumn(
        "label", (F.col("verdict") == "KEEP").cast("int")
    )


def with_embeddings(rows: DataFrame, corpus: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows that have a vector; the others are dropped (see ``missing_embeddings``).

    The vectors stay where they are. Up to ``limit`` bytes, measured, the rows are broadcast to them. Beyond it the corpus is
    used by key (``session.laid_out``), and the rows go to its buckets. The smaller side is hashed there: rows that take less room than the
    vectors, else the vectors, of which a bucket holds a bounded part, so cohorts of any size stream past. A corpus that is
    not stored by key yet is laid out first; callers who score more than once pass one that is.
    """
    columns = [F.col(c) for c in rows.columns]
    size = measured(rows)[1]
    if size <= limit:
        met = F.broadcast(rows).join(corpus.select("pk", "dense"), "pk")
    else:
        by_key = (corpus if lies_by(corpus, "pk") else laid_out(corpus.select("pk", "dense"), "pk")).select("pk", "dense")
        fewer = size <= planned_bytes(by_key)
        met = rows.hint("shuffle_hash").join(by_key, "pk") if fewer else rows.join(by_key.hint("shuffle_hash"), "pk")
    return met.select(*columns, F.col("dense").cast("array<double>").alias("dense"))


def missing_embeddings(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    return rows.join(narrowed(corpus.select("pk"), rows), "pk", "left_anti")


def feature_frame(rows: DataFrame, scaler: DataFrame) -> DataFrame:
    """``features`` = vector followed by the scaled distance."""
    scaled = vectors.scale(F.col("nearest_fit_distance"), F.col("scaler_mean"), F.col("scaler_scale"))
    return (
        rows.join(broadcast_if_small(scaler), SID)
        .withColumn("features", vectors.stack(F.col("dense"), scaled))
        .drop("dense", "scaler_mean", "scaler_scale")
    )


def require_balance(frame: DataFrame, n_splits: int) -> DataFrame:
    """Class counts per session; ``enough`` means each class reaches the number of folds."""
    per = frame.groupBy(SID).agg(
        F.count_if(F.col("label") == 1).alias("keep"), F.count_if(F.col("label") == 0).alias("drop")
    )
    return per.withColumn("enough", F.least("keep", "drop") >= n_splits)


def verdict_at(p_keep: Column, tau: Column) -> Column:
    return F.when(p_keep >= tau, "KEEP").otherwise("DROP")


def score(frame: DataFrame, models: DataFrame, tau: float | None = None) -> DataFrame:
    """``p_keep`` and the verdict for every feature row, as one column expression.

    The threshold is ``tau``, or the one stored with the model.
    """
    limit = F.lit(tau) if tau is not None else F.col("threshold")
    wanted = [SID, "coef", "intercept"] + ([] if tau is not None else ["threshold"])
    joined = frame.join(broadcast_if_small(models.select(*wanted)), SID)
    return (
        joined.withColumn("p_keep", vectors.logistic(F.col("features"), F.col("coef"), F.col("intercept")))
        .withColumn("verdict", verdict_at(F.col("p_keep"), limit))
        .drop("features", *wanted[1:])
    )


def checked_models(models: DataFrame, dim: int) -> DataFrame:
    """Stored classifiers, failing at run time on a wrong shape: coef length, classes, scale."""
    ok = (
        (F.size("coef") == dim + 1)
        & (F.col("classes") == F.array(F.lit(0), F.lit(1)))
        & (F.col("scaler_scale") > 0)
    )
    return models.withColumn(
        "intercept",
        F.when(ok, F.col("intercept")).otherwise(F.raise_error(F.lit("stored classifier is malformed")).cast("double")),
    )


def pin_guard(models: DataFrame, pins: DataFrame) -> DataFrame:
    """Whether a stored classifier was trained under the session's rubric: text hash first, then version."""
    got = pins.select(SID, F.col("prompt_sha256").alias("_sha"), F.col("rubric_version").alias("_version"))
    reason = (
        F.when(~F.col("prompt_sha256").eqNullSafe(F.col("_sha")), "prompt_sha256")
        .when(~F.col("rubric_version").eqNullSafe(F.col("_version")), "rubric_version")
    )
    return models.join(got, SID, "left").select(SID, reason.isNull().alias("accepted"), reason.alias("mismatch"))


def precision_bar(metrics: DataFrame, min_precision: float, allow: bool = False) -> DataFrame:
    """Operator decision per session: agree, override_low_precision or refused."""
    met = F.col("precision") >= min_precision
    return metrics.withColumn(
        "operator_decision", F.when(met, "agree").otherwise("override_low_precision" if allow else "refused")
    )


def same_dimension(rows: DataFrame, dim: int, vector: str = "dense") -> DataFrame:
    """Rows whose vector has another dimension than configured (all rows are looked at)."""
    return rows.where(F.coalesce(F.size(vector), F.lit(0)) != dim).select("pk", F.size(vector).alias("dim"))

