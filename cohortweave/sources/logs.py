"""Session logs: turn records, details sidecars and what is read out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import PATHS
from .schemas import DETAILS_LOG, KEY, turn_log

LEGACY_PATH = "bm25"


def fail(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of all files below ``path`` with ``place``, their position as written: file, block of the file, line in the block.

    Lines without a session id take it from their file's name. Files of one session are in order of their names, as numbered batches are.
    """
    raw = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.details)?\.jsonl$", 1)
    # Within a block lines are numbered in the order in which the reader meets them.
    at = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    return raw.select(*[c for c in raw.columns if c != "session_id"], F.coalesce("session_id", name).alias("session_id"), at.alias("place"))


def read_turn_log(spark: SparkSession, path: str, key: str = KEY) -> DataFrame:
    """All lines of the turn logs; malformed lines fail, blank ones are skipped.

    The log is append-only with growing turns and markers after their turn, so
    ``line_no`` restores the written order.
    """
    return with_line_no(_lines(spark, path, turn_log(key)))


def with_line_no(log: DataFrame) -> DataFrame:
    return log.withColumn("line_no", F.col("turn").cast("long") * 2 + F.col("event").isNotNull().cast("long"))


def read_details(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, DETAILS_LOG)


def session_turns(log: DataFrame) -> DataFrame:
    """Turn lines only; a turn line without a number is an error."""
    turns = log.where("event IS NULL")
    return turns.withColumn("turn", F.coalesce("turn", fail("turn record without an integer turn", "int")))


def _legacy() -> dict[str, Column]:
    """Where a turn still names the removed retrieval path."""
    no = F.lit(False)
    scored = F.exists("results", lambda r: F.coalesce(F.map_contains_key(r["scores"], LEGACY_PATH), no))
    return {
        "active_paths": F.coalesce(F.array_contains("config.active_paths", LEGACY_PATH), no),
        "scores": F.coalesce(scored, no),
        "candidates": F.coalesce(F.map_contains_key("per_path_candidates", LEGACY_PATH), no),
    }


def legacy_offences(turns: DataFrame) -> DataFrame:
    """Turns per session that still name the removed retrieval path, by place."""
    return turns.groupBy("session_id").agg(*[F.count_if(hit).alias(name) for name, hit in _legacy().items()])


def reject_legacy(turns: DataFrame) -> DataFrame:
    """The turns again; one that names the removed retrieval path is an error."""
    places = _legacy()
    bad = places["active_paths"] | places["scores"] | places["candidates"]
    return turns.withColumn("turn", F.when(~bad, F.col("turn")).otherwise(fail("legacy retrieval path in log", "int")))


def _content(column: str) -> Column:
    return F.coalesce(column, fail("logged row without chunk_content", "string"))


def _text(column: str) -> Column:
    return F.coalesce(column, F.lit("")).alias(column.split(".")[-1])


def flatten_evidence(turns: DataFrame) -> DataFrame:
    """One row per logged result, with defaults for what older logs lack."""
    rows = turns.select("session_id", "turn", F.explode("results").alias("r"))
    none = F.array().cast("array<int>")
    return rows.select(
        "session_id",
        "turn",
        "r.rank",
        "r.pk",
        _text("r.chunk_id"),
        _content("r.chunk_content").alias("chunk_content"),
        _text("r.sample_id"),
        _text("r.counselor_id"),
        _text("r.term"),
        F.coalesce("r.source_paths", F.array().cast("array<string>")).alias("source_paths"),
        *[F.coalesce(F.try_element_at("r.scores", F.lit(x)), F.lit(0.0)).alias(f"score_{x}") for x in PATHS],
        "r.rating",
        F.coalesce("r.span_line_indices", none).alias("span_line_indices"),
        _text("r.span_text"),
    )


def flatten_candidates(turns: DataFrame) -> DataFrame:
    """One row per logged candidate of the known paths."""
    per_path = turns.select("session_id", "turn", F.explode("per_path_candidates").alias("path", "_list"))
    rows = per_path.where(F.col("path").isin(*PATHS)).select("session_id", "turn", "path", F.explode("_list").alias("r"))
    none = F.array().cast("array<int>")
    return rows.select(
        "session_id",
        "turn",
        "path",
        "r.rank_in_path",
        "r.pk",
        _text("r.chunk_id"),
        _content("r.chunk_content").alias("chunk_content"),
        _text("r.sample_id"),
        _text("r.counselor_id"),
        _text("r.term"),
        F.coalesce("r.score", F.lit(0.0)).alias("score"),
        "r.rating",
        F.coalesce("r.span_line_indices", none).alias("span_line_indices"),
        _text("r.span_text"),
    )


def search_pin(details: DataFrame) -> DataFrame:
    """Each session's first search block as written: collection, service and model it used; no collection is an error."""
    per = details.where("search IS NOT NULL").groupBy("session_id").agg(
        F.min_by("search", "place").alias("s")
    )
    return per.select(
        "session_id",
        F.when(F.length("s.collection") > 0, F.col("s.collection"))
        .otherwise(fail("search block without a collection", "string"))
        .alias("collection"),
        F.col("s.embed_url").alias("embed_url"),
        F.col("s.embed_model_id").alias("embed_model_id"),
    )


def turn_details(turns: DataFrame, details: DataFrame) -> DataFrame:
    """Turns with the last details line, as written, of the same turn number; phase lines never match."""
    numbered = details.withColumn("turn", F.expr("try_cast(turn AS INT)")).where("turn IS NOT NULL")
    last = numbered.groupBy("session_id", "turn").agg(
        F.max_by(F.struct("search", "reflection"), "place").alias("_d")
    )
    return turns.join(last, ["session_id", "turn"], "left").select(
        "session_id",
        "turn",
        "query",
        F.col("_d.search.seen_set_size").alias("seen_set_size"),
        F.when(F.col("reflection").isNotNull(), F.col("_d.reflection.raw_response")).alias("raw_response"),
    )


def model_drift(pins: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded against current embedding model; unknown on either side is skipped."""
    recorded = F.col("embed_model_id")
    known = (F.coalesce(F.length(recorded), F.lit(0)) > 0) & (F.coalesce(F.length("current_model_id"), F.lit(0)) > 0)
    return pins.join(current, "collection", "left").select(
        "session_id",
        recorded.alias("recorded_model_id"),
        "current_model_id",
        F.when(~known, "unknown").when(recorded == F.col("current_model_id"), "match").otherwise("drift").alias("status"),
    )


def require_no_drift(drift: DataFrame) -> DataFrame:
    """``model_drift`` rows; one whose model has changed is an error."""
    what = F.concat_ws(" ", F.lit("embedding model of session"), F.col("session_id").cast("string"), F.lit("changed from"), "recorded_model_id", F.lit("to"), "current_model_id")
    return drift.withColumn("status", F.when(F.col("status") == "drift", F.raise_error(what).cast("string")).otherwise(F.col("status")))


def turn_records(rows: DataFrame, candidates: DataFrame, turns: DataFrame, metrics: DataFrame) -> DataFrame:
    """One nested record per turn, ready to be appended to the log."""
    score_map = F.create_map(F.lit("dense"), F.col("score_dense"), F.lit("sparse"), F.col("score_sparse"))
    common = ("pk", "chunk_id", "chunk_content", "sample_id", "counselor_id", "term", "rating", "span_line_indices", "span_text")
    res = rows.groupBy("session_id", "turn").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", *common, "source_paths", score_map.alias("scores"))),
            lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0),
        ).alias("results")
    )
    cand = (
        candidates.groupBy("session_id", "turn", "path")
        .agg(F.array_sort(F.collect_list(F.struct("rank_in_path", *common, "score"))).alias("_list"))
        .groupBy("session_id", "turn")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "_list")))).alias("per_path_candidates"))
    )
    packed = metrics.select(
        "session_id",
        "turn",
        F.struct("total", "fit_count", "not_fit_count", "discard_count", "precision_at_k", "seen_set_size").alias("metrics"),
    )
    return turns.join(res, ["session_id", "turn"], "left").join(cand, ["session_id", "turn"], "left").join(
        packed, ["session_id", "turn"], "left"
    )


def intruder_list(meta: DataFrame, key: str = KEY) -> DataFrame:
    """Known intruders out of harvest meta records given as JSON text; absent or corrupt gives none."""
    parsed = F.from_json("meta", f"not_fit_intrusion STRUCT<intruder_pks: ARRAY<{key}>>")
    return meta.select("session_id", F.explode(parsed["not_fit_intrusion"]["intruder_pks"]).alias("pk"))


