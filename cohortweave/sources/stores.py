"""Corpora, original content and phase outputs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import round6
from ..session import broadcast_if_small, narrowed
from . import batches, schemas
from .schemas import CLASSIFIER_FIELDS, KEY

CORPUS_FIELDS = ("pk", "sample_id", "counselor_id", "term", "chunk_content", "chunk_seq")


def read_corpus(spark: SparkSession, path: str, fields: tuple[str, ...] = CORPUS_FIELDS) -> DataFrame:
    """Only the named columns leave the files."""
    return spark.read.parquet(path).select(*fields)


def key_ranges(keys: DataFrame, key: str, parts: int, sample_rows: int = 10_000) -> list[str]:
    """SQL conditions that split a table into ``parts`` ranges of ``key`` (number or text); every row, also one without a key, meets one.

    The bounds are quantiles of at most ``sample_rows`` keys chosen by hash, which only decides how even the ranges are.
    """
    chosen = keys.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(sample_rows)
    values = sorted(r[0] for r in chosen.collect())
    bounds = sorted({values[len(values) * i // parts] for i in range(1, parts)}) if values else []
    quoted = ["'" + b.replace("'", "''") + "'" if isinstance(b, str) else str(b) for b in bounds]
    if not quoted:
        return ["1 = 1"]
    between = [f"{key} >= {low} AND {key} < {high}" for low, high in zip(quoted[:-1], quoted[1:])]
    return [f"{key} < {quoted[0]} OR {key} IS NULL", *between, f"{key} >= {quoted[-1]}"]


def read_content_jdbc(spark: SparkSession, url: str, table: str, key: str = "pk", parts: int = 16, **options: str) -> DataFrame:
    """The original-content store in a database, read by ``parts`` tasks, each a range of keys. The database must compare keys by their bytes."""
    keys = spark.read.jdbc(url, f"(SELECT {key} FROM {table}) keys_", properties=options)
    return spark.read.jdbc(url, table, predicates=key_ranges(keys, keys.columns[0], parts), properties=options)


def lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``table`` whose pk is asked for; absent keys are simply absent."""
    return table.join(broadcast_if_small(keys.select("pk").distinct()), "pk", "left_semi")


def content_lookup(content: DataFrame, keys: DataFrame) -> DataFrame:
    """Original texts by pk; a null text counts as missing."""
    return lookup(content.where("original_content IS NOT NULL"), keys)


def missing_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("pk").distinct().join(narrowed(table.select("pk"), keys), "pk", "left_anti")


def checked_cohort(cohort: DataFrame) -> DataFrame:
    """Cohort rows; a row without key or distance is an error."""
    bad = F.col("pk").isNull() | F.col("nearest_fit_distance").isNull()
    distance = F.when(~bad, F.col("nearest_fit_distance")).otherwise(
        F.raise_error(F.lit("cohort row without pk or nearest_fit_distance")).cast("double")
    )
    return cohort.withColumn("nearest_fit_distance", distance)


def read_cohort(spark: SparkSession, path: str, key: str = KEY, session: str = KEY) -> DataFrame:
    """A written cohort; an empty one is an error."""
    cohort = spark.read.schema(schemas.cohort(key, session)).option("mode", "FAILFAST").json(path)
    if cohort.isEmpty():
        raise ValueError(f"the cohort in {path} is empty")
    return checked_cohort(cohort)


def write_cohort(cohort: DataFrame, path: str) -> None:
    """Overwrite with distance-ascending JSON lines, rounded to six decimals; compressed, since the names of the fields fill most of a line."""
    cohort.select(
        "session_id",
        "pk",
        "nearest_fit_pk",
        "nearest_fit_label",
        round6(F.col("nearest_fit_distance")).alias("nearest_fit_distance"),
        F.lit(True).alias("passed_threshold"),
        round6(F.col("threshold_T_prime")).alias("threshold_T_prime"),
        "qualifying_fit_count",
        "qualifying_fit_pks",
    ).orderBy("session_id", "nearest_fit_distance", "pk").write.mode("overwrite").json(path, compression="gzip")


def append_log(records: DataFrame, path: str, number: int | None = None, order: tuple[str, ...] = ("turn",)) -> bool:
    """Append log lines as one batch, the next one unless its number is given; a batch that is there already stays as it is.

    The lines of a session lie in one file of the batch, in ``order``.
    """
    spark = records.sparkSession
    if number is None:
        number = max(batches.numbers(spark, path), default=-1) + 1
    lines = records.repartition("session_id").sortWithinPartitions("session_id", *order)
    return batches.put(lines, path, number, "json", ignoreNullFields="true")


def read_rubrics(spark: SparkSession, path: str, session: str = KEY) -> DataFrame:
    """Locked rubrics (session_id, rubric_version, rubric_text) with the hash that pins their text; one without a text is an error."""
    raw = spark.read.schema(schemas.rubrics(session)).option("mode", "FAILFAST").json(path)
    missing = F.raise_error(F.concat(F.lit("rubric without a text: session "), F.col("session_id").cast("string"))).cast("string")
    checked = F.when(F.length("rubric_text") > 0, F.col("rubric_text")).otherwise(missing)
    return raw.withColumn("rubric_text", checked).withColumn("prompt_sha256", F.sha2("rubric_text", 256))


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """Overwrite with JSON lines, each pinned to the rubric it was judged by; nulls are written."""
    verdicts.select(*schemas.VERDICT_FIELDS).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_verdicts(spark: SparkSession, path: str, key: str = KEY, session: str = KEY) -> DataFrame:
    return spark.read.schema(schemas.verdicts(key, session)).option("mode", "FAILFAST").json(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select("session_id", "pk", "verdict", round6(F.col("p_keep")).alias("p_keep")).write.mode("overwrite").json(path)


def read_labels(spark: SparkSession, path: str, key: str = KEY, session: str = KEY) -> DataFrame:
    return spark.read.schema(schemas.labels(key, session)).option("mode", "FAILFAST").json(path)


def write_classifiers(models: DataFrame, path: str) -> None:
    models.select(*CLASSIFIER_FIELDS).write.mode("overwrite").json(path)


def read_classifiers(spark: SparkSession, path: str, session: str = KEY) -> DataFrame:
    return spark.read.schema(schemas.classifier(session)).option("mode", "FAILFAST").json(path)


def write_export(export: DataFrame, path: str) -> None:
    """Overwrite with compressed CSV: a text is written for every session that labels it, mostly in lines next to each other."""
    export.select("user_id", "counselor_id", "original_content", "label").write.mode("overwrite").csv(
        path, header=True, quoteAll=True, escape='"', compression="gzip"
    )
