"""op3: ids of every document, and the bytes they decode to."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import table


def op3_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encoded(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, keep=["doc_id"], decode=True)
    return ids.select(
        F.col("row_.doc_id").alias("doc_id"),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded_", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_rank_queue_bpe": op3_rank_queue_bpe}
SQL: dict[str, str] = {}
