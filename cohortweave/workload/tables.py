"""Corpus, logs and phase inputs derived from the given tables, in Spark and in SQL.

Sessions are blocks of 125 document ids, so their number grows with the corpus
while each stays as small as one rater's work.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.retrieval import posted, term_vectors
from ..session import narrowed, staged
from .registry import cte

SESSION_SIZE = 125
TERM = "2025F"
ZEROED, ZEROED_HARD = 16, 56


def stage(build):
    """Phase inputs (logs, posting lists, anchors) are tables: written once, then read."""

    @wraps(build)
    def read(spark: SparkSession, d: str) -> DataFrame:
        return staged(spark, f"{build.__name__}:{d}", lambda: build(spark, d))

    return read


_SCHEMAS: dict[str, object] = {}


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table; its footer is read for the schema only once."""
    path = f"{d}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def kind(pk):
    """A digit per chunk by which the queries tell cases apart."""
    return F.pmod(pk * 7, F.lit(10)).cast("int")


KIND_SQL = "({} * 7 % 10)::INTEGER"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The texts: every document is a chunk."""
    return load(spark, d, "documents").select(
        F.col("doc_id").alias("pk"),
        F.col("source").alias("sample_id"),
        F.col("lang").alias("counselor_id"),
        F.lit(TERM).alias("term"),
        F.col("text").alias("chunk_content"),
        F.col("doc_id").cast("int").alias("chunk_seq"),
        kind(F.col("doc_id")).alias("label"),
    )


cte(
    "corpus",
    f"""SELECT doc_id AS pk, source AS sample_id, lang AS counselor_id, '{TERM}' AS term, text AS chunk_content,
    doc_id::INTEGER AS chunk_seq, {KIND_SQL.format("doc_id")} AS label FROM documents""",
)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors: every embedding, of the chunk with its id if there is one.

    They stay single precision until they are computed with.
    """
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("pk"), F.col("embedding").alias("dense"))


cte("vectors_t", "SELECT vec_id AS pk, embedding::DOUBLE[] AS dense FROM embeddings")


def postings(spark: SparkSession, d: str) -> DataFrame:
    return posted(sparse(spark, d), "pk")


cte(
    "postings",
    r"""SELECT pk, term, count(*)::DOUBLE AS weight FROM
    (SELECT pk, unnest(regexp_split_to_array(lower(chunk_content), '[^\p{L}]+')) AS term FROM corpus)
    WHERE term <> '' GROUP BY pk, term""",
)


def _rated(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "labels").withColumnRenamed("doc_id", "pk")
    rows = corpus(spark, d).join(labels, "pk")
    rating = F.when(F.col("toxic") == 1, "DISCARD").when(F.col("quality") == 1, "FIT").otherwise("NOT_FIT")
    n_lines = F.size(text.lines(F.col("chunk_content")))
    take = F.least(n_lines, (1 + F.col("pk") % 3).cast("int"))
    idx = F.when(F.col("label") == 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), take - 1))
    first = rows.select(
        F.floor(F.col("pk") / SESSION_SIZE).alias("session_id"),
        (1 + F.col("pk") % 5).cast("int").alias("turn"),
        F.when(F.col("label") == 1, "candidate").otherwise("row").alias("kind"),
        rating.alias("rating"),
        *[c for c in rows.columns],
        idx.alias("span_line_indices"),
    )
    flipped = F.when(F.col("rating") == "FIT", "NOT_FIT").when(F.col("rating") == "NOT_FIT", "FIT").otherwise("DISCARD")
    second = first.where("label = 0").withColumn("turn", F.col("turn") + 1).withColumn("rating", flipped)
    return first.unionByName(second)


@stage
def events(spark: SparkSession, d: str) -> DataFrame:
    """Rated events: every labelled chunk once, some looked at again a turn later."""
    rows = _rated(spark, d).withColumn(
        "path", F.when(F.col("kind") == "candidate", F.when(F.col("pk") % 2 == 0, "dense").otherwise("sparse"))
    )
    w = Window.partitionBy("session_id", "turn", "kind", "path").orderBy("pk")
    paths = (
        F.when(F.col("pk") % 3 == 0, F.array(F.lit("dense")))
        .when(F.col("pk") % 3 == 1, F.array(F.lit("sparse")))
        .otherwise(F.array(F.lit("dense"), F.lit("sparse")))
    )
    return rows.select(
        "session_id",
        "turn",
        "kind",
        "path",
        F.row_number().over(w).alias("pos"),
        "pk",
        text.display_id(F.col("sample_id"), F.col("chunk_seq"), F.col("pk")).alias("chunk_id"),
        "chunk_content",
        "sample_id",
        "counselor_id",
        "term",
        "rating",
        paths.alias("source_paths"),
        ((F.col("pk") * 37 % 101) / 100.0).alias("score_dense"),
        ((F.col("pk") * 17 % 53) / 10.0).alias("score_sparse"),
        "span_line_indices",
        text.span_text(F.col("chunk_content"), F.col("span_line_indices")).alias("span_text"),
        "label",
    )


cte(
    "rated_first",
    f"""SELECT c.pk // {SESSION_SIZE} AS session_id, (1 + c.pk % 5)::INTEGER AS turn,
    CASE WHEN c.label = 1 THEN 'candidate' ELSE 'row' END AS kind,
    CASE WHEN l.toxic = 1 THEN 'DISCARD' WHEN l.quality = 1 THEN 'FIT' ELSE 'NOT_FIT' END AS rating,
    c.pk, c.sample_id, c.counselor_id, c.term, c.chunk_content, c.chunk_seq, c.label,
    CASE WHEN c.label = 3 THEN []::INTEGER[]
      ELSE range(0, least(len(string_split(c.chunk_content, chr(10))), 1 + c.pk % 3))::INTEGER[] END AS span_line_indices
    FROM corpus c JOIN labels l ON l.doc_id = c.pk""",
)
cte(
    "rated_all",
    """SELECT * FROM rated_first UNION ALL
    SELECT * REPLACE (turn + 1 AS turn, CASE rating WHEN 'FIT' THEN 'NOT_FIT' WHEN 'NOT_FIT' THEN 'FIT' ELSE 'DISCARD' END AS rating)
    FROM rated_first WHERE label = 0""",
)
cte(
    "events_t",
    """SELECT session_id, turn, kind, path, row_number() OVER (PARTITION BY session_id, turn, kind, path ORDER BY pk) AS pos,
    pk, sample_id || '_C' || lpad(chunk_seq::VARCHAR, 7, '0') AS chunk_id, chunk_content, sample_id, counselor_id, term, rating,
    CASE pk % 3 WHEN 0 THEN ['dense'] WHEN 1 THEN ['sparse'] ELSE ['dense', 'sparse'] END AS source_paths,
    (pk * 37 % 101) / 100.0::DOUBLE AS score_dense, (pk * 17 % 53) / 10.0::DOUBLE AS score_sparse, span_line_indices,
    array_to_string([string_split(chunk_content, chr(10))[i + 1] FOR i IN span_line_indices], chr(10)) AS span_text, label,
    turn::BIGINT * 100000000 + CASE WHEN kind = 'row' THEN 0 ELSE 10000000 + CASE WHEN path = 'dense' THEN 0 ELSE 1000000 END END
      + row_number() OVER (PARTITION BY session_id, turn, kind, path ORDER BY pk) AS seq
    FROM (SELECT *, CASE WHEN kind = 'candidate' THEN CASE WHEN pk % 2 = 0 THEN 'dense' ELSE 'sparse' END END AS path FROM rated_all)""",
)


@stage
def turns(spark: SparkSession, d: str) -> DataFrame:
    """One row per (session, turn) with its log header."""
    per = events(spark, d).select("session_id", "turn").distinct()
    return per.select(
        "session_id",
        "turn",
        iso_time(F.col("session_id"), F.col("turn")).alias("timestamp"),
        F.concat(F.lit("scope"), F.col("session_id") % 3).alias("scope"),
        F.concat(F.lit("query of session "), F.col("session_id")).alias("query"),
        (F.col("turn") % 3 == 0).alias("audit_turn"),
        F.when((F.col("session_id") + F.col("turn")) % 4 == 0, F.array(F.lit("dense")))
        .otherwise(F.array(F.lit("dense"), F.lit("sparse")))
        .alias("active_paths"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  note "), F.col("turn"), F.lit(" \n")))
        .when(F.col("turn") == 1, " \n\t ")
        .alias("diagnose"),
    )


def iso_time(session, turn):
    """ISO time of a session's turn, whatever the session time zone: one day per session, ten minutes per turn."""
    start = F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))
    at = start + F.make_dt_interval(session.cast("int"), F.lit(0), turn.cast("int") * 10, F.lit(0))
    return F.concat(F.translate(at.cast("string"), " ", "T"), F.lit("Z"))


def stamp_sql(session: str, turn: str) -> str:
    return f"strftime(make_timestamp((1735689600 + {session} * 86400 + {turn} * 600)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


cte(
    "turns_t",
    f"""SELECT session_id, turn, {stamp_sql('session_id', 'turn')} AS timestamp, 'scope' || (session_id % 3) AS scope,
    'query of session ' || session_id AS query, turn % 3 = 0 AS audit_turn,
    CASE WHEN (session_id + turn) % 4 = 0 THEN ['dense'] ELSE ['dense', 'sparse'] END AS active_paths,
    CASE WHEN turn % 2 = 0 THEN '  note ' || turn || ' ' || chr(10) WHEN turn = 1 THEN ' ' || chr(10) || chr(9) || ' ' END AS diagnose
    FROM (SELECT DISTINCT session_id, turn FROM events_t)""",
)


@stage
def sparse(spark: SparkSession, d: str) -> DataFrame:
    """The sparse vector of every chunk: its words and how often they occur."""
    return term_vectors(corpus(spark, d), "pk", text.terms(F.col("chunk_content")))


@stage
def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One query per session: its earliest-keyed FIT chunk, with its vector. No text is read."""
    seed = (
        load(spark, d, "labels")
        .where("quality = 1 AND toxic = 0")
        .select(F.col("doc_id").alias("pk"))
        .join(load(spark, d, "embeddings").select(F.col("vec_id").alias("pk")), "pk", "left_semi")
        .groupBy(F.floor(F.col("pk") / SESSION_SIZE).alias("query_id"))
        .agg(F.min("pk").alias("pk"))
    )
    both = seed.join(vectors(spark, d), "pk")
    return both.select("query_id", "pk", F.col("dense").cast("array<double>").alias("dense"))


@stage
def queries(spark: SparkSession, d: str) -> DataFrame:
    """``query_vectors`` with the sparse vectors of their chunks."""
    seed = query_vectors(spark, d)
    both = seed.join(narrowed(sparse(spark, d), seed), "pk", "left")
    return both.select("query_id", "pk", "dense", "terms", "weights")


cte(
    "queries_t",
    """SELECT q.query_id, q.pk, c.dense FROM
    (SELECT session_id AS query_id, min(pk) AS pk FROM rated_first WHERE rating = 'FIT' AND pk IN (SELECT pk FROM vectors_t)
    GROUP BY session_id) q JOIN vectors_t c ON c.pk = q.pk""",
)


def query_postings(spark: SparkSession, d: str) -> DataFrame:
    return posted(queries(spark, d), "query_id")


cte("query_postings_t", "SELECT q.query_id, p.term, p.weight FROM queries_t q JOIN postings p ON p.pk = q.pk")


@stage
def seen(spark: SparkSession, d: str) -> DataFrame:
    """What each session was shown in its first two turns."""
    return events(spark, d).where("turn <= 2").select(F.col("session_id").alias("query_id"), "pk").distinct()


cte("seen_t", "SELECT DISTINCT session_id AS query_id, pk FROM events_t WHERE turn <= 2")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Span vectors: the chunk vector with its leading components zeroed, more of them for some."""
    emb = load(spark, d, "embeddings")
    zeroed = F.when(kind(F.col("vec_id")) == 2, ZEROED_HARD).otherwise(ZEROED)
    return emb.select(
        F.floor(F.col("vec_id") / SESSION_SIZE).alias("session_id"),
        F.col("vec_id").alias("pk"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i < zeroed, 0.0).otherwise(x)).alias("span"),
    )


@stage
def anchors(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.phases import anchor_inputs

    return anchor_inputs(events(spark, d), spans(spark, d), vectors(spark, d), allow_unconverged=True)


cte(
    "final_anchor",
    """SELECT session_id, pk, max_by(rating, seq) AS rating, min(seq) FILTER (rating = 'FIT') AS fit_seq,
    max(seq) FILTER (rating = 'FIT') AS last_fit_seq, max(seq) FILTER (rating = 'NOT_FIT') AS last_not_fit_seq
    FROM events_t WHERE rating = 'FIT' OR (rating = 'NOT_FIT' AND kind = 'row') GROUP BY session_id, pk""",
)
cte(
    "anchor_fits_t",
    """SELECT f.session_id, f.pk, e.chunk_id, e.span_text, e.span_line_indices, e.label,
    row_number() OVER (PARTITION BY f.session_id ORDER BY f.fit_seq) AS fit_ord
    FROM final_anchor f JOIN events_t e ON e.session_id = f.session_id AND e.seq = f.last_fit_seq
    WHERE f.rating = 'FIT' AND length(e.span_text) > 0 AND len(e.span_line_indices) > 0""",
)
cte(
    "anchors_t",
    f"""SELECT f.session_id, f.pk AS fit_pk, f.fit_ord, f.chunk_id, c.dense AS chunk,
    list_transform(c.dense, lambda x, i: CASE WHEN i <= CASE WHEN f.label = 2 THEN {ZEROED_HARD} ELSE {ZEROED} END THEN 0.0::DOUBLE ELSE x END) AS span
    FROM anchor_fits_t f JOIN vectors_t c ON c.pk = f.pk""",
)
