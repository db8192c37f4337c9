"""op1: all documents packed into sequences of 1024."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing
from .common import table

#: The vocabulary of byte_bpe_50k.json as ranks; the tests hold the ids against the other library.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Has the added tokens, which are found in texts and which the ranks lack.
TOKENIZER = "byte_bpe_50k.json"


def added_tokens() -> dict[str, int]:
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def packed(docs: DataFrame) -> DataFrame:
    out = packing.pack(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=["doc_id"], added=added_tokens())
    columns = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return out.select(F.col("row_.doc_id").alias("doc_id"), *columns)


def op1_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op1_cutting_stock": op1_cutting_stock}
SQL: dict[str, str] = {}
