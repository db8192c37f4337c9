"""From documents to packed training sequences: quality, repeated lines, near-copies, secrets, packing.

Every stage is one operator over all that the stage before kept. All but the last return the columns of documents; where
a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.llm import jaccard, lines, packing_query, quality, secret_scan
from cohortweave.llm.common import save, table, unpacked


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or any rule on a condemned host, go."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which no word is left."""
    out = lines.deduplicated(docs)
    out = out.filter((F.col("n_removed") == 0) | F.col("kept_").rlike("[^\\x20\\x09-\\x0D]"))
    return _counted(unpacked(out.withColumn("row_", F.col("row_").withField("text", F.col("kept_"))), docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, that with the smallest id."""
    return unpacked(jaccard.linked(docs).filter("kept"), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return _counted(secret_scan.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 ids."""
    return packing_query.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near copies", near_copies),
    ("secret scans", secrets),
    ("packing", pack),
]

#: SQL has no tokenizer; tests/llm/test_pipeline.py holds every stage against SQL or the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
