"""Small shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array; no text and blank text have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RUN)
    )


def save(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder in a dense format and go on from what is written.

    Tables with rows of megabytes have few ``rows_per_file`` (0: any number): a reader holds thousands of rows of a file at once.

    Later steps then neither repeat the work nor depend on executors that may be gone,
    and values such as row ids that depend on the partitioning stay as they are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FIRST_ID = -(2**63)


def document_keys(docs: DataFrame, text: str, doc_id: str) -> list[Column]:
    """(id_, sub_), which tell documents apart and order them; a null id comes first.

    Rows of one id and one text are one document. Different texts of one id differ in ``sub_``, a hash of the text. A null id
    names no document: there ``sub_`` is a hash of the whole row, so that only identical rows are one. Without ids of several texts
    ``sub_`` is 0 for all rows with an id.
    """
    key, content = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    several = docs.select(key.alias("id_"), content.alias("c")).filter("id_ is not null").groupBy("id_").agg((F.min("c") != F.max("c")).alias("several"))
    own = F.lit(0).cast("long") if several.filter("several").isEmpty() else content
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    return [F.coalesce(key, F.lit(FIRST_ID)).alias("id_"), F.when(key.isNull(), whole).otherwise(own).alias("sub_")]


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as one struct ``row_``, so that no column of the caller can clash with one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row_").getField(c).alias(c) for c in columns])


def stretches(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes in a text column (one row at least)."""
    first = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(batch):
        yield batch.slice(first)


#: Tables up to this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def _width(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(column, F.lit(16).cast("long"), lambda a, x: a + _width(x, kind.elementType)), F.lit(16).cast("long"))
    if isinstance(kind, T.StructType):
        return sum((_width(column.getField(f.name), f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def broadcast_measured(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows, measured, fit ``BROADCAST_BYTES``; pass a written or otherwise cheap table."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8))
    size = df.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that moves both sides by key and broadcasts neither.

    The optimizer takes the bytes of a written table for its size; links between copies compress to a twentieth of their rows, so that
    millions of them would be broadcast.
    """
    return df.hint("merge")
