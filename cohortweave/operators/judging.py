"""Judging and span extraction with a caller-supplied function.

The function gets a list of texts and returns one raw answer (or None for a
failed call) per text. It runs inside Arrow batches; parsing, validation and
retry bookkeeping are native columns.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..session import broadcast_if_small, cut, narrowed

Answerer = Callable[[list[str]], list[str | None]]
AUTO_DROP = "auto_drop_known_intruder"
#: Between what a judge is told and the text that it judges.
TEXT_FOLLOWS = "\n--- text ---\n"


def parse_verdicts(raw: DataFrame, checks: Column, answer: str = "raw", content: str = "chunk_content") -> DataFrame:
    """Add the parsed verdict fields and ``breach`` (null when the verdict is acceptable)."""
    rows = raw.withColumn("_body", text.json_body(F.col(answer)))
    rows = rows.withColumn("_p", text.verdict_fields(text.strict_object(F.col("_body"))))
    breach = F.when(F.coalesce(F.length("_body"), F.lit(0)) == 0, "no_json").otherwise(
        text.contract_breach(F.col("_p"), F.col("_body"), F.col(content), checks)
    )
    return rows.withColumn("breach", breach).select("*", "_p.*").drop("_p", "_body", "odd")


#: Prompts of one call; a call that fails is repeated prompt by prompt.
PROMPTS_PER_CALL = 32


def answers_of(prompts: list[str], answerer: Answerer) -> tuple[list[str | None], list[str | None], list[float]]:
    """Answers, error texts and milliseconds per prompt; a failing service is data, not a failed job."""
    answers: list[str | None] = []
    errors: list[str | None] = []
    spent: list[float] = []
    for at in range(0, len(prompts), PROMPTS_PER_CALL):
        part, start = prompts[at : at + PROMPTS_PER_CALL], time.perf_counter()
        try:
            found, failed = list(answerer(part)), [None] * len(part)
            if len(found) != len(part):
                raise ValueError(f"{len(found)} answers to {len(part)} prompts")
        except Exception as whole:
            found, failed = [], []
            for prompt in part:
                try:
                    found.append(answerer([prompt])[0] if len(part) > 1 else None)
                    failed.append(None if len(part) > 1 else str(whole))
                except Exception as single:
                    found.append(None)
                    failed.append(str(single))
        answers += found
        errors += failed
        spent += [(time.perf_counter() - start) * 1000.0 / len(part)] * len(part)
    return answers, errors, spent


def ask(rows: DataFrame, prompt: str, answerer: Answerer) -> DataFrame:
    """Add ``raw``, ``call_error`` and ``call_ms`` by calling ``answerer`` on slices of prompts."""
    added = (T.StructField("raw", T.StringType()), T.StructField("call_error", T.StringType()), T.StructField("call_ms", T.DoubleType()))
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors, spent = answers_of(pdf[prompt].tolist(), answerer)
            yield pdf.assign(raw=answers, call_error=errors, call_ms=spent)

    return rows.mapInPandas(run, schema)


def judge(
    sample: DataFrame,
    content: DataFrame,
    checks: Sequence[str],
    answerer: Answerer,
    max_retries: int = 2,
    callers: int = 16,
    context: DataFrame | None = None,
) -> DataFrame:
    """A verdict per sampled row; unusable answers become ERROR rows, never failures.

    The prompt is the text with numbered lines, behind the session's ``context`` (session_id, context) and ``TEXT_FOLLOWS`` if one is given.

    Rows whose answer is rejected are asked again, up to ``max_retries`` times.
    Each round is written out before it is used, so no answer is asked for twice.
    ``callers`` is how many tasks call the judge side by side.
    """
    known = F.array(*[F.lit(c) for c in checks])
    texts = narrowed(content, sample).select("pk", F.col("original_content").alias("chunk_content"))
    rows = sample.join(texts, "pk", "left")
    rows = rows.withColumn("chunk_content", F.coalesce("chunk_content", F.lit("")))
    blank = [
        F.lit(None).cast("array<int>").alias("evidence_line_indices"),
        F.lit(None).cast("string").alias("failed_check"),
    ]
    auto = rows.where("arm = 'auto_drop'").select(
        *rows.columns,
        F.lit("DROP").alias("verdict"),
        F.lit(None).cast("array<int>").alias("evidence_line_indices"),
        F.lit(AUTO_DROP).alias("failed_check"),
        F.lit(AUTO_DROP).alias("reason"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("double").alias("latency_ms"),
        F.lit(None).cast("string").alias("error_kind"),
    )
    empty = rows.where("arm = 'selected' AND chunk_content = ''").select(
        *rows.columns,
        F.lit("ERROR").alias("verdict"),
        *blank,
        F.lit("empty_chunk_content").alias("reason"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("double").alias("latency_ms"),
        F.lit("api").alias("error_kind"),
    )
    pending = rows.where("arm = 'selected' AND chunk_content <> ''")
    prompt = text.number_lines(F.col("chunk_content"), 1)
    if context is not None:
        pending = pending.join(broadcast_if_small(context.select("session_id", "context")), "session_id", "left")
        prompt = F.concat(F.coalesce("context", F.lit("")), F.lit(TEXT_FOLLOWS), prompt)
    pending = pending.withColumn("prompt", prompt).withColumn("spent_ms", F.lit(0.0))
    done = [auto, empty]
    for attempt in range(1, max_retries + 2):
        answered = cut(parse_verdicts(ask(pending.repartition(callers), "prompt", answerer), known))
        answered = answered.withColumn("spent_ms", F.col("spent_ms") + F.col("call_ms"))
        ok = answered.where("breach IS NULL")
        good = ok.select(
            *rows.columns, "verdict", "evidence_line_indices", "failed_check", "reason",
            F.lit(attempt).alias("attempts"), F.round("spent_ms", 2).alias("latency_ms"),
            F.lit(None).cast("string").alias("error_kind"),
        )
        done.append(good)
        failed = answered.where("breach IS NOT NULL")
        if attempt == max_retries + 1:
            api = F.col("raw").isNull()
            done.append(
                failed.select(
                    *rows.columns,
                    F.lit("ERROR").alias("verdict"),
                    *blank,
                    F.when(api, F.coalesce("call_error", F.lit("api_error"))).otherwise(F.concat(F.lit("schema_validation_failed: "), "breach")).alias("reason"),
                    F.lit(attempt).alias("attempts"),
                    F.round("spent_ms", 2).alias("latency_ms"),
                    F.when(api, "api").otherwise("parse").alias("error_kind"),
                )
            )
        else:
            if failed.isEmpty():
                break
            pending = failed.select(*rows.columns, "prompt", "spent_ms")
    return reduce(lambda a, b: a.unionByName(b), done)


def keyword_judge(checks: dict[str, str]) -> Answerer:
    """Deterministic judge: the first check whose keyword is missing fails the text."""

    def answer(prompts: list[str]) -> list[str | None]:
        out = []
        for prompt in prompts:
            low = prompt.rpartition(TEXT_FOLLOWS)[2].lower()
            failed = next((c for c, word in checks.items() if word not in low), None)
            out.append(
                json.dumps(
                    {
                        "verdict": "DROP" if failed else "KEEP",
                        "evidence_line_indices": [1],
                        "failed_check": failed,
                        "reason": "keyword",
                    }
                )
            )
        return out

    return answer


def judge_context(rubrics: DataFrame, exemplars: DataFrame) -> DataFrame:
    """(session_id, context): the rubric's text, then the session's exemplars (kind, ord, span_text), fitting ones first."""
    shown = exemplars.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("kind", "ord", "span_text"))).alias("e"))
    listed = F.transform("e", lambda x: F.concat(x.kind, F.lit(": "), F.coalesce(x.span_text, F.lit(""))))
    return rubrics.join(broadcast_if_small(shown), "session_id", "left").select(
        "session_id", F.array_join(F.concat(F.array("rubric_text"), F.coalesce(listed, F.array().cast("array<string>"))), "\n").alias("context")
    )


def pinned(verdicts: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Verdicts with the version and text hash of their session's rubric; a session without one is an error."""
    pins = rubrics.select("session_id", "rubric_version", "prompt_sha256")
    missing = F.raise_error(F.concat(F.lit("no rubric for session "), F.col("session_id").cast("string"))).cast("string")
    joined = verdicts.join(broadcast_if_small(pins), "session_id", "left")
    return joined.withColumn("prompt_sha256", F.coalesce("prompt_sha256", missing))


def judge_errors(verdicts: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    return verdicts.groupBy(*keys).agg(
        F.count_if(F.col("error_kind") == "parse").alias("parse_error_count"),
        F.count_if(F.col("error_kind") == "api").alias("api_error_count"),
        F.sum("attempts").alias("attempts"),
    )


#: Gets prompts as {"query", "prior_spans", "text"}, answers each with a JSON list of 0-based line numbers.
Extractor = Callable[[list[dict]], list[str | None]]


def extract_spans(
    rows: DataFrame,
    cache: DataFrame,
    extractor: Extractor,
    model: str,
    prompt_version: str,
    prior: DataFrame | None = None,
    attempts: int = 2,
    callers: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """Span line indices per row, from the cache or from the extractor.

    ``rows`` are (session_id, pk, query, chunk_content). The extractor sees the query and the session's last FIT spans, ``prior`` as
    ``ratings.prior_spans`` gives them, oldest first; what it has seen is not part of the cache key. Rows with the same key are asked once,
    for the first of their sessions. Rows that fail ``attempts`` times are left out. Returns the rows and the entries to append to the cache.
    """
    keyed = rows.withColumn(
        "cache_key", text.cache_key(F.lit(model), F.lit(prompt_version), F.col("query"), F.col("chunk_content"))
    )
    known = cache.select("cache_key", "span_line_indices")
    missing = keyed.join(known.select("cache_key"), "cache_key", "left_anti").groupBy("cache_key").agg(
        F.min_by(F.struct("session_id", "query", "chunk_content"), F.struct("session_id", "pk")).alias("r")
    )
    missing = missing.select("cache_key", "r.session_id", "r.query", "r.chunk_content")
    none = F.array().cast("array<string>")
    if prior is None:
        missing = missing.withColumn("prior_spans", none)
    else:
        spans = prior.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "span_text"))), lambda x: x.span_text).alias("prior_spans"))
        missing = missing.join(broadcast_if_small(spans), "session_id", "left").withColumn("prior_spans", F.coalesce("prior_spans", none))
    prompt = F.to_json(F.struct("query", "prior_spans", F.col("chunk_content").alias("text")))
    pending, found = missing.select("cache_key", "chunk_content", prompt.alias("prompt")), []

    def answer(prompts: list[str]) -> list[str | None]:
        return extractor([json.loads(p) for p in prompts])

    for attempt in range(attempts):
        asked = cut(ask(pending.repartition(callers), "prompt", answer))
        idx = F.from_json("raw", "array<int>")
        ok = F.coalesce(text.span_is_valid(idx, F.col("chunk_content")), F.lit(False))
        asked = asked.withColumn("span_line_indices", idx).withColumn("_ok", ok)
        found.append(asked.where("_ok").select("cache_key", "span_line_indices", "chunk_content"))
        pending = asked.where("NOT _ok").select("cache_key", "chunk_content", "prompt")
        if attempt + 1 < attempts and pending.isEmpty():
            break
    fresh = reduce(lambda a, b: a.unionByName(b), found)
    new_cache = fresh.select(
        "cache_key", "span_line_indices", text.span_text(F.col("chunk_content"), F.col("span_line_indices")).alias("span_text")
    )
    spans = known.unionByName(fresh.select("cache_key", "span_line_indices"))
    out = keyed.join(spans, "cache_key").withColumn(
        "span_text", text.span_text(F.col("chunk_content"), F.col("span_line_indices"), strict=True)
    )
    return out, new_cache


def merged_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with new entries; of two entries with one key that which is there already stays, of new ones the smallest."""
    columns = ["cache_key", "span_line_indices", "span_text"]
    one = fresh.groupBy("cache_key").agg(F.min(F.struct(*columns[1:])).alias("e")).select("cache_key", "e.*")
    new = one.join(cache.select("cache_key"), "cache_key", "left_anti")
    return cache.select(*columns).unionByName(new.select(*columns))


def span_drift(fits: DataFrame, cache: DataFrame) -> DataFrame:
    """Logged spans that differ from the cache (the log wins)."""
    cached = cache.select("chunk_id", F.col("span_text").alias("cached_text"), F.col("span_line_indices").alias("cached_idx"))
    return (
        fits.join(cached, "chunk_id")
        .select(
            "session_id",
            "pk",
            "chunk_id",
            (~F.col("span_text").eqNullSafe(F.col("cached_text"))).alias("text_drift"),
            (F.coalesce("span_line_indices", F.array().cast("array<int>")) != F.coalesce("cached_idx", F.array().cast("array<int>"))).alias("index_drift"),
        )
        .where("text_drift OR index_drift")
    )


def rubric_integrity(examples: DataFrame, checks: DataFrame) -> DataFrame:
    """Examples that cite unknown checks, and check ids declared twice."""
    cited = examples.select("rubric_id", "pk", F.explode("fails").alias("check_id"))
    unknown = cited.join(checks.select("rubric_id", "check_id").distinct(), ["rubric_id", "check_id"], "left_anti")
    twice = checks.groupBy("rubric_id", "check_id").agg(F.count("*").alias("n")).where("n > 1")
    return unknown.select("rubric_id", "check_id", F.col("pk").cast("string").alias("pk"), F.lit("unknown_check").alias("problem")).unionByName(
        twice.select("rubric_id", "check_id", F.lit(None).cast("string").alias("pk"), F.lit("duplicate_check").alias("problem"))
    )


def annotate_not_fits(not_fits: DataFrame, annotations: DataFrame, checks: DataFrame) -> DataFrame:
    """NOT_FIT examples with their failed checks; without an annotation the first check stands in."""
    first = checks.groupBy("rubric_id").agg(F.min_by("check_id", "check_ord").alias("first_check"))
    return (
        not_fits.join(annotations.select("rubric_id", "pk", "fails"), ["rubric_id", "pk"], "left")
        .join(broadcast_if_small(first), "rubric_id")
        .select(
            "rubric_id",
            "pk",
            text.first_lines(F.col("chunk_content")).alias("span_text"),
            F.coalesce("fails", F.array("first_check")).alias("fails"),
        )
    )
