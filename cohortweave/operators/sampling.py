"""Distance-stratified draws, borderline rows and diverse exemplars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded_order
from ..functions.vectors import cosine_similarity, l2_normalise
from ..params import RefineParams
from ..session import broadcast_if_small, cut
from .ordering import bin_edges, equal_count_bins, prefix

SID = "session_id"


def by_distance() -> list[Column]:
    return [F.col("nearest_fit_distance").asc(), F.col("pk").cast("string").asc()]


def decile_bins(cohort: DataFrame, n_bins: int = 10) -> DataFrame:
    return equal_count_bins(cohort, [SID], by_distance(), n_bins)


def decile_edges(binned: DataFrame, n_bins: int = 10) -> DataFrame:
    return bin_edges(binned, [SID], "nearest_fit_distance", n_bins)


def bin_sizes(binned: DataFrame) -> DataFrame:
    return binned.groupBy(SID, "decile").agg(F.count("*").alias("n"))


def eligible(cohort: DataFrame, exclude: DataFrame | None) -> DataFrame:
    if exclude is None:
        return cohort
    return cohort.join(broadcast_if_small(exclude.select(SID, "pk").distinct()), [SID, "pk"], "left_anti")


def draw(binned: DataFrame, p: RefineParams) -> DataFrame:
    """``per_bin`` seeded rows of every bin.

    Fails at run time where a session has too few rows or a bin too few members.
    """
    sizes = bin_sizes(binned).withColumnRenamed("n", "_n")
    total = sizes.groupBy(SID).agg(
        F.sum("_n").alias("_total"), F.min("_n").alias("_smallest"), F.count("*").alias("_bins")
    )
    short = (
        (F.col("_total") < p.sample_size) | (F.col("_smallest") < p.per_bin) | (F.col("_bins") < p.n_bins)
    )
    checked = total.select(
        SID,
        F.when(~short, F.lit(p.per_bin))
        .otherwise(F.raise_error(F.lit("cohort too small for the requested sample")).cast("int"))
        .alias("_take"),
    )
    w = Window.partitionBy(SID, "decile").orderBy(seeded_order(p.seed, F.col("pk")), F.col("pk").cast("string"))
    drawn = binned.withColumn("_draw", F.row_number().over(w)).where(F.col("_draw") <= p.per_bin)
    return drawn.join(broadcast_if_small(checked), SID).where(F.col("_draw") <= F.col("_take")).drop("_draw", "_take")


def auto_drop_split(drawn: DataFrame, intruders: DataFrame | None, p: RefineParams = RefineParams()) -> DataFrame:
    """``arm``: known intruders are dropped without judging, the rest is selected."""
    if intruders is None or not p.auto_drop_known_intruders:
        return drawn.withColumn("arm", F.lit("selected"))
    known = intruders.select(SID, "pk").distinct().withColumn("_known", F.lit(True))
    return (
        drawn.join(broadcast_if_small(known), [SID, "pk"], "left")
        .withColumn("arm", F.when(F.col("_known"), "auto_drop").otherwise("selected"))
        .drop("_known")
    )


def stratified_sample(
    cohort: DataFrame,
    exclude: DataFrame | None,
    intruders: DataFrame | None,
    p: RefineParams = RefineParams(),
) -> tuple[DataFrame, DataFrame]:
    """The drawn sample and the binned eligible cohort it came from."""
    binned = cut(decile_bins(eligible(cohort, exclude), p.n_bins))
    return auto_drop_split(draw(binned, p), intruders, p), binned


def borderline(
    scored: DataFrame,
    tau: float,
    band: float = 0.05,
    k: int = 10,
    seed: int = 0,
    keys: tuple[str, ...] = (SID,),
) -> DataFrame:
    """Up to ``k`` rows near the threshold: all of them if few, else drawn from the nearer half."""
    near = scored.where(F.col("p_keep").between(tau - band, tau + band))
    gap = F.abs(F.col("p_keep") - tau)
    placed = prefix(near, keys, [gap.asc(), F.col("pk").asc()], rank="_place")
    sizes = near.groupBy(*keys).agg(F.count("*").alias("_n"))
    pool = F.greatest(F.lit(3 * k), F.floor(F.col("_n") / 2))
    inside = placed.join(broadcast_if_small(sizes), list(keys)).where(
        (F.col("_n") <= k) | (F.col("_place") <= pool)
    )
    w = Window.partitionBy(*keys).orderBy(seeded_order(seed, F.col("pk")), F.col("pk"))
    return inside.withColumn("_d", F.row_number().over(w)).where(F.col("_d") <= k).drop("_place", "_n", "_d")


def diverse(items: DataFrame, k: int, group: str = SID, ord_col: str = "ord", vector: str = "vec") -> DataFrame:
    """Farthest-first choice of ``k`` items per group, starting at the lowest ``ord``.

    ``k`` is small: each step is one aggregation that carries the picks so far, one
    row per group, so a hot group is pre-aggregated where its items are read.
    Groups of at most ``k`` items come back whole.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    unit = items.select(group, ord_col, l2_normalise(F.col(vector)).alias("_u"))
    picks = unit.groupBy(group).agg(
        F.array(F.struct(F.min(ord_col).alias("o"), F.min_by("_u", ord_col).alias("u"))).alias("picks"),
    )
    for _ in range(k - 1):
        gap = F.array_min(F.transform("picks", lambda q: 1.0 - cosine_similarity(q["u"], F.col("_u"))))
        open_ = ~F.exists("picks", lambda q: q["o"] == F.col(ord_col))
        weight = F.struct(F.round(gap, 12).alias("d"), (-F.col(ord_col)).alias("o"))
        grown = (
            unit.join(picks, group)
            .groupBy(group)
            .agg(
                F.any_value("picks").alias("picks"),
                F.max_by(F.struct(F.col(ord_col).alias("o"), F.col("_u").alias("u")), F.when(open_, weight)).alias("_new"),
            )
        )
        more = F.when(F.col("_new").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("_new")))
        picks = cut(grown.select(group, more.alias("picks")))
    chosen = picks.select(group, F.posexplode("picks").alias("_i", "_q")).select(
        group, F.col("_q.o").alias(ord_col), (F.col("_i") + 1).alias("pick")
    )
    return items.join(chosen, [group, ord_col])


def exemplar_cap(items: DataFrame, cap: int, group: str = SID, ord_col: str = "ord", vector: str = "vec") -> DataFrame:
    """Groups above ``cap`` keep a diverse subset, the others all their items."""
    sizes = items.groupBy(group).agg(F.count("*").alias("_n"))
    sized = items.join(broadcast_if_small(sizes), group)
    small = sized.where(F.col("_n") <= cap).drop("_n")
    large = diverse(sized.where(F.col("_n") > cap).drop("_n"), cap, group, ord_col, vector).drop("pick")
    return small.unionByName(large)
