"""Exact order statistics per group that never sort a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

# A group up to this size is ordered by one window task.
SMALL_GROUP = 250_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")) if keys else df.agg(F.count("*").alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, str] | None = None,
    rank: str = "rn",
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Add the position of each row within its group, and running sums of ``sums``.

    ``order`` must be total within a group. Small groups use one window. Larger ones are range
    partitioned on the order, so a hot group spreads over many tasks; positions
    are then local positions plus the sizes of the group's earlier ranges.
    """
    sums = sums or {}
    if largest_group(df, keys) <= small_group:
        part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        w = part.orderBy(*order)
        running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            F.row_number().over(w).cast("long").alias(rank),
            *[F.sum(src).over(running).alias(out) for out, src in sums.items()],
        )

    ranges = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p", *keys).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranges.select(
        "*",
        F.row_number().over(w).cast("long").alias("_rn"),
        *[F.sum(src).over(running).alias(f"_run_{out}") for out, src in sums.items()],
    )
    totals = ranges.groupBy("_p", *keys).agg(
        F.count("*").alias("_n"), *[F.sum(src).alias(f"_tot_{out}") for out, src in sums.items()]
    )
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        "_p",
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_tot_{out}").over(before), F.lit(0)).alias(f"_off_{out}") for out in sums],
    )
    joined = local.join(broadcast_if_small(cut(offsets)), ["_p", *keys])
    return joined.select(
        *df.columns,
        (F.col("_rn") + F.col("_off")).alias(rank),
        *[(F.col(f"_run_{out}") + F.col(f"_off_{out}")).alias(out) for out in sums],
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: dict[str, float],
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Linear-interpolation quantiles per group, plus the group size ``n``."""
    if largest_group(df, keys) <= small_group:
        return df.groupBy(*keys).agg(
            *[F.percentile(value, F.lit(q)).alias(name) for name, q in points.items()], F.count(value).alias("n")
        )
    # The tie column lets a run of equal values spread over several ranges.
    present = df.where(F.col(value).isNotNull()).select(*keys, value, F.monotonically_increasing_id().alias("_tie"))
    ranked = prefix(present, keys, [F.col(value).asc(), F.col("_tie").asc()], small_group=small_group)
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    marks = sizes.select(
        *keys,
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("name"),
                        (F.floor(F.lit(q) * (F.col("n") - 1)) + 1).alias("lo"),
                        (F.ceil(F.lit(q) * (F.col("n") - 1)) + 1).alias("hi"),
                        (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))).alias("frac"),
                    )
                    for name, q in points.items()
                ]
            )
        ).alias("m"),
    )
    at = F.broadcast(marks.select(*keys, "n", "m.*")) if not keys else broadcast_if_small(marks.select(*keys, "n", "m.*"))
    hit = ranked.join(at, list(keys) or F.lit(True)).where((F.col("rn") == F.col("lo")) | (F.col("rn") == F.col("hi")))
    per = hit.groupBy(*keys, "n", "name", "frac").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    wide = per.groupBy(*keys, "n").pivot("name", list(points)).agg(
        F.first(F.col("a") + (F.col("b") - F.col("a")) * F.col("frac"))
    )
    return wide.select(*keys, *points, "n")


def five_number(df: DataFrame, value: str, keys: Sequence[str] = (), small_group: int = SMALL_GROUP) -> DataFrame:
    """min / p25 / median / p75 / max per group; zeros when there is nothing."""
    points = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0}
    out = quantiles(df, keys, value, points, small_group)
    return out.select(*keys, *[F.coalesce(F.col(p), F.lit(0.0)).alias(p) for p in points], "n")


def equal_count_bins(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n_bins: int,
    out: str = "decile",
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Equal-count bins along ``order``; the last bin takes the remainder."""
    ranked = prefix(df, keys, order, rank="_place", small_group=small_group)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_total"))
    joined = ranked.join(broadcast_if_small(sizes), list(keys))
    base = F.floor(F.col("_total") / n_bins)
    bin_no = F.when(base == 0, n_bins - 1).otherwise(
        F.least(F.floor((F.col("_place") - 1) / F.greatest(base, F.lit(1))), F.lit(n_bins - 1))
    )
    return joined.withColumn(out, bin_no.cast("int")).drop("_place", "_total")


def bin_edges(binned: DataFrame, keys: Sequence[str], value: str, n_bins: int, bin_col: str = "decile") -> DataFrame:
    """``n_bins + 1`` edges: the minimum of every bin (carried over empty ones), then the maximum."""
    per = binned.groupBy(*keys, bin_col).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n")
    )
    wide = per.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(bin_col, "_lo"))).alias("_lows"),
        F.min("_lo").alias("_min"),
        F.max("_hi").alias("_max"),
    )
    edge = wide.select(
        *keys, "_lows", "_min", "_max", F.explode(F.sequence(F.lit(0), F.lit(n_bins))).alias("edge")
    )
    w = Window.partitionBy(*keys).orderBy("edge")
    low = F.when(F.col("edge") == 0, F.col("_min")).otherwise(F.col("_lows")[F.col("edge")])
    carried = F.last(low, ignorenulls=True).over(w)
    return edge.select(
        *keys, "edge", F.when(F.col("edge") == n_bins, F.col("_max")).otherwise(carried).alias("value")
    )
