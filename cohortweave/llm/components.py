"""Connected components of a link table, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, shuffled


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour or the node itself. Summed up before the shuffle, so a hub is one row of each task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(shuffled(_least(both)), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), with root the smallest node of its component, itself left out.

    Every round writes its links to the shared folder; the number of rounds grows with the logarithm of the longest chain.
    """
    current = save(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "links")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = state(current)
    while before[0]:
        current = save(_small_star(_large_star(current)), "links")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
