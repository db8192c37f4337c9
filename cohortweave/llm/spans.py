"""Places of pattern matches in texts, with native expressions.

A scan keeps, per text and pattern, the lengths of the gaps between matches and of the matches; only texts with
matches go on. Places are running sums over those lengths, taken by a window over one text's matches, so the work is
in proportion to the number of matches however many one text has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A kind of match. ``value``: the group whose length is bounded; ``needles``: lower-case literals one of which a
    match contains (a cheap test before the pattern runs)."""

    kind: str
    regex: str
    value: int = 0
    least: int = 1
    most: int | None = None
    needles: tuple[str, ...] = ()
    context: int = 0  # code points kept from the gaps to either side of a match


def _may_match(text: Column, p: Pattern) -> Column:
    if not p.needles:
        return text.rlike(p.regex)
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(n) for n in p.needles]) & text.rlike(p.regex)


def scanned(df: DataFrame, text: Column, patterns: tuple[Pattern, ...]) -> DataFrame:
    """``df`` with a column ``m_<kind>`` per pattern: null, or the gaps, matches and values of one text."""
    out = df.withColumn("scan_", F.coalesce(text, F.lit("")))
    for p in patterns:
        body = F.col("scan_")
        beside = lambda g, n=p.context: F.struct(
            F.length(g).alias("n"), F.right(g, F.lit(n)).alias("before"), F.left(g, F.lit(n)).alias("after")
        )
        found = F.struct(
            F.transform(F.split(body, p.regex, -1), beside).alias("gaps"),
            F.regexp_extract_all(body, F.lit(p.regex), F.lit(0)).alias("hits"),
            F.transform(F.regexp_extract_all(body, F.lit(p.regex), F.lit(p.value)), lambda v: F.length(v)).alias("sizes"),
        )
        out = out.withColumn(f"m_{p.kind}", F.when(_may_match(body, p), found))
    return out.drop("scan_")


def placed(scan: DataFrame, patterns: tuple[Pattern, ...], rid: str = "rid") -> DataFrame:
    """Rows (rid, kind, ord, start, end, hit, before, after): every match of every pattern; places in code points, end exclusive."""
    parts = []
    for i, p in enumerate(patterns):
        m = F.col(f"m_{p.kind}")
        parts.append(
            scan.filter(m.isNotNull()).select(
                rid,
                F.lit(p.kind).alias("kind"),
                F.lit(i).alias("ord"),
                F.lit(p.least).alias("least_"),
                F.lit(p.most if p.most is not None else 2**31 - 1).alias("most_"),
                F.posexplode(
                    F.arrays_zip(m["gaps"].alias("gap"), m["hits"].alias("hit"), m["sizes"].alias("size"), F.slice(m["gaps"], 2, F.size(m["hits"])).alias("next"))
                ).alias("i_", "x"),
            )
        )
    rows = reduce(DataFrame.unionByName, parts).filter(F.col("x.hit").isNotNull())
    rows = rows.select(rid, "kind", "ord", "least_", "most_", "i_", F.col("x.gap").alias("gap_"), F.col("x.hit").alias("hit"), F.col("x.size").alias("size_"), F.col("x.next.after").alias("after"))
    so_far = Window.partitionBy(rid, "ord").orderBy("i_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap_.n") + F.length("hit")).over(so_far))
    return rows.filter(F.col("size_").between(F.col("least_"), F.col("most_"))).select(
        rid, "kind", "ord", (F.col("end") - F.length("hit")).cast("long").alias("start"), F.col("end").cast("long").alias("end"), "hit", F.col("gap_.before").alias("before"), "after"
    )


def summed_up(spans: DataFrame, base: tuple[str, ...], rid: str = "rid") -> DataFrame:
    """Per text with spans: a count per base kind, the base spans and all spans as text, by start and kind."""
    spell = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    grouped = spans.groupBy(rid).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base],
        F.sort_array(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("all_"),
    )
    return grouped.select(
        rid,
        *[f"n_{k}" for k in base],
        F.array_join(F.transform(F.filter("all_", lambda s: s["kind"].isin(*base)), spell), ",").alias("base_spans"),
        F.array_join(F.transform("all_", spell), ",").alias("spans"),
    )


def merged(spans: DataFrame, rid: str = "rid") -> DataFrame:
    """Per text: its covered stretches, disjoint and in order, as an array of (start, end)."""
    before = Window.partitionBy(rid).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(rid).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.coalesce(F.max("end").over(before) < F.col("start"), F.lit(True))
    runs = spans.select(rid, "start", "end", first.cast("int").alias("first_")).withColumn("run_", F.sum("first_").over(upto))
    runs = runs.groupBy(rid, "run_").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(rid).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("covered_"))


def masked(text: Column, covered: Column, mask: str) -> Column:
    """``text`` with every covered stretch replaced."""
    pieces = F.transform(
        covered,
        lambda s, i: F.concat(
            F.substring(text, (F.when(i == 0, F.lit(0)).otherwise(F.get(covered, i - 1)["end"]) + 1).cast("int"), (s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(covered, i - 1)["end"])).cast("int")),
            F.lit(mask),
        ),
    )
    last = F.element_at(covered, -1)["end"]
    rest = F.substring(text, (last + 1).cast("int"), F.length(text))
    return F.when(covered.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest))
