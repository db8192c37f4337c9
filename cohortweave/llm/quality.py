"""Quality rules per document and per host (native expressions only).

Each document is measured once. Failures are counted per host (``source``), the hosts' failure rates
are shrunk towards the mean of all hosts with a beta prior fitted to them by moments, and the verdicts on
the hosts are joined back: in a condemned host a document stays only if it fails no rule at all.

Defined cases: no text (null, empty, blank) has no words and fails ``n_words < MIN_WORDS``; a null host is the
host ``''``; rows that repeat are judged each for itself; an empty table gives an empty result; all columns
of the caller are carried in a struct, so any name may occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_measured, packed, save, unpacked, words_of

WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits as whole percentages, so that no rounding decides."""

    min_words: int = 20
    max_repeated: int = 30  # percent of the words
    max_symbols: int = 10  # symbols per hundred words
    max_dup_lines: int = 30  # percent of the lines
    host_rate: float = 0.5  # shrunk failure rate above which a host is condemned
    default_strength: float = 10.0  # of the prior, where the hosts do not tell one


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row_`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col("row_").getField(text), F.lit(""))
    base = packed(docs).select("row_", body.alias("body_"), words_of(body).alias("words_"))
    has_word = lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""
    base = base.select(
        "row_",
        "body_",
        "words_",
        F.size("words_").alias("n_words"),
        F.transform("words_", lambda w: F.xxhash64(w)).alias("hashes_"),
        F.filter(F.split("body_", "\n"), has_word).alias("lines_"),
    )
    # Hashes of windows tell which texts repeat one (and never miss any); those few are compared by their words.
    base = base.withColumn(
        "windows_",
        F.when(
            F.col("n_words") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.col("n_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes_", i, WINDOW))),
        ),
    )
    base = base.withColumn("repeats_", F.coalesce(F.size(F.array_distinct("windows_")) < F.size("windows_"), F.lit(False)))
    base = base.withColumn(
        "sorted_",
        F.when(
            F.col("repeats_"),
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(1), F.col("n_words") - WINDOW + 1),
                    lambda i: F.struct(F.array_join(F.slice("words_", i, WINDOW), " ").alias("g"), i.alias("p")),
                )
            ),
        ),
    )
    same = lambda x, j: F.coalesce(F.get("sorted_", j).getField("g") == x.getField("g"), F.lit(False))
    starts = F.sort_array(
        F.transform(F.filter("sorted_", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.getField("p"))
    )
    base = base.withColumn("starts_", starts)
    covered = F.aggregate(
        F.transform("starts_", lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("starts_", i - 1)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return base.select(
        "row_",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body_", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeated * F.col("n_words"))


def any_failed(rules: Rules) -> Column:
    return (
        base_failed(rules)
        | (100 * F.col("n_symbols") > rules.max_symbols * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > rules.max_dup_lines * F.col("n_lines"))
    )


def host_rates(scored: DataFrame, rules: Rules) -> DataFrame:
    """Per host: documents, failing documents and the shrunk failure rate.

    Counts are summed before they are shuffled, so a host with a third of all rows is one row of each task.
    """
    counts = save(
        scored.groupBy("host_").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed_").cast("long")).alias("k")), "hosts"
    )
    rate = F.col("k") / F.col("n")
    m, v = counts.agg(F.avg(rate), F.var_pop(rate)).first()
    if m is None:
        m, v = 0.0, 0.0
    # Moments of a beta distribution: mean m, variance v = m (1 - m) / (strength + 1).
    strength = m * (1 - m) / v - 1 if v and v > 0 else rules.default_strength
    if strength <= 0:
        strength = rules.default_strength
    return counts.withColumn("rate", (F.col("k") + F.lit(m * strength)) / (F.col("n") + F.lit(strength)))


def judged(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``row_`` (the caller's columns) with the measures, ``base_failed``, ``host_rate`` and ``kept``.

    Only what the caller selects in ``docs`` is written between the two passes; select few columns
    when the texts are not needed afterwards (``keep_columns``).
    """
    return _judged(measured(docs, text), docs.columns, host, rules)


def measures_only(docs: DataFrame, keep: list[str], text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """As ``judged``, carrying only the columns ``keep`` and never the texts."""
    wanted = list(dict.fromkeys([*keep, host]))
    narrow = measured(docs, text).withColumn("row_", F.struct(*[F.col("row_").getField(c).alias(c) for c in wanted]))
    return _judged(narrow, wanted, host, rules)


def _judged(scored: DataFrame, columns: list[str], host: str, rules: Rules) -> DataFrame:
    scored = save(
        scored.select(
            "*",
            F.coalesce(F.col("row_").getField(host).cast("string"), F.lit("")).alias("host_"),
            base_failed(rules).alias("base_failed"),
            any_failed(rules).alias("failed_"),
        ),
        "measured",
    )
    condemned = host_rates(scored, rules).filter(F.col("rate") > rules.host_rate).select("host_", "rate")
    joined = scored.join(broadcast_measured(condemned), "host_", "left")
    return joined.select(
        "row_",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.col("rate").alias("host_rate"),
        (~F.col("base_failed") & ~(F.col("rate").isNotNull() & F.col("failed_"))).alias("kept"),
    )


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    return unpacked(judged(docs, text, host, rules).filter("kept"), docs.columns)
