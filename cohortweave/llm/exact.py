"""Removal of exact copies: groups by a 128-bit content hash, one row of each group stays, bytes are compared inside groups.

1. Every text is folded (letters A to Z in lower case, nothing else) and hashed once; what is written are narrow rows: id, place in
   the table, SHA-256, its first 128 bits as content hash, and a 64-bit hash of the same text that costs little to compute again.
2. Rows are counted by these hashes, with partial sums before the shuffle: a group with a third of all rows is one row of each task.
3. Texts of groups with several rows are read again (found by the cheap hash) and grouped by hash and bytes. Equal texts meet before
   the shuffle, so a task sends each text once. A hash under which two different texts come out is a collision; texts of
   collisions get a number, and the rows are keyed again with it.
4. The row that stays is joined back to the narrow rows. Groups above ``HOT_ROWS`` rows are joined apart from the rest: there are at most
   rows / ``HOT_ROWS`` of them, and their rows never gather by key.

Built from DataFrame functions only. Defined cases: null text counts as empty, and empty texts are copies of each other; a null id is
chosen only in groups without any other id (``keep_id`` is null then); of rows with one id and equal texts one stays, the first read (the last read with
``keep="largest"``); an empty table gives an empty result; columns of the caller are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_measured, save, unpacked

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Groups above so many rows are joined apart.
HOT_ROWS = 100_000
KEY = ["hash_", "cheap_", "which_"]


def folded(text: Column) -> Column:
    """Letters A to Z in lower case; texts without other than ASCII characters take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def content_hash(digest: Column) -> Column:
    return F.substring(digest, 1, 16)


def cheap_hash(text: Column) -> Column:
    """Equal for texts that are equal when folded (full lower case tells no more apart than folding)."""
    return F.xxhash64(F.lower(text))


def _texts(docs: DataFrame, text: str, doc_id: str, keep: list[str], cheap: Callable[[Column], Column]) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("struct<none:int>")
    return docs.select(row.alias("row_"), F.col(f"`{doc_id}`").alias("id_"), cheap(body).alias("cheap_"), body.alias("body_"))


def _hashed(texts: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    out = texts.withColumn("body_", folded(F.col("body_"))).withColumn("digest_", F.unhex(F.sha2("body_", 256)))
    return out.withColumn("hash_", hashed(F.col("digest_")))


def _counted(rows: DataFrame, keep: str) -> DataFrame:
    """Groups of several rows, with the row that stays."""
    if keep == "smallest":
        best = F.min(F.struct(F.col("id_").isNull().alias("last"), "id_", "place_"))
    elif keep == "largest":
        best = F.max(F.struct(F.col("id_").isNotNull().alias("last"), "id_", "place_"))
    else:
        raise ValueError(f"keep is smallest or largest, not {keep}")
    groups = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size_"), best.alias("best_")).filter("size_ > 1")
    return groups.select(*KEY, "size_", F.col("best_.id_").alias("keep_id_"), F.col("best_.place_").alias("keep_place_"))


def _collisions(texts: DataFrame, groups: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """(hash_, cheap_, body_, which_): different texts under one key, numbered. Nearly always empty."""
    wanted = groups.select("cheap_").distinct()
    again = _hashed(texts.join(broadcast_measured(wanted), "cheap_", "left_semi"), hashed)
    classes = again.groupBy("hash_", "cheap_", "body_").agg(F.count(F.lit(1)).alias("n")).select("hash_", "cheap_", "body_")
    classes = save(classes, "exact_classes")
    several = classes.groupBy("hash_", "cheap_").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash_", "cheap_")
    alike = classes.join(broadcast_measured(save(several, "exact_collided")), ["hash_", "cheap_"], "left_semi")
    return alike.withColumn("which_", F.expr("row_number() over (partition by hash_, cheap_ order by body_)"))


def verdicts(
    docs: DataFrame,
    keep: str = "smallest",
    text: str = "text",
    doc_id: str = "doc_id",
    columns: list[str] | None = None,
    hashed: Callable[[Column], Column] = content_hash,
    cheap: Callable[[Column], Column] = cheap_hash,
) -> DataFrame:
    """``row_`` (``columns``, all by default), keep_id, group_size, kept and text_sha256 (of the folded text) of every row.

    ``keep`` says which id of a group stays, the ``smallest`` or the ``largest``.
    """
    texts = _texts(docs, text, doc_id, docs.columns if columns is None else columns, cheap)
    keyed = _hashed(texts, hashed).withColumn("place_", F.monotonically_increasing_id())
    narrow = ["row_", "id_", "place_", "digest_", *KEY]
    rows = save(keyed.withColumn("which_", F.lit(0)).select(*narrow), "exact_rows")
    groups = save(_counted(rows, keep), "exact_groups")
    collided = save(_collisions(texts.drop("row_", "id_"), groups, hashed), "exact_collisions")
    if not collided.isEmpty():
        told = keyed.join(broadcast_measured(collided), ["hash_", "cheap_", "body_"], "left")
        rows = save(told.withColumn("which_", F.coalesce("which_", F.lit(0))).select(*narrow), "exact_rows")
        groups = save(_counted(rows, keep), "exact_groups")
    out = _joined(rows, groups)
    return out.select(
        "row_",
        F.when(F.col("size_").isNull(), F.col("id_")).otherwise(F.col("keep_id_")).alias("keep_id"),
        F.coalesce("size_", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size_").isNull() | (F.col("keep_place_") == F.col("place_"))).alias("kept"),
        F.lower(F.hex("digest_")).alias("text_sha256"),
    )


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their group, if it has several rows; hot groups first, and their rows spread by place in the join of the rest."""
    found = ["size_", "keep_id_", "keep_place_"]
    hot = groups.filter(F.col("size_") > HOT_ROWS).select(*KEY, *[F.col(c).alias(f"hot_{c}") for c in found])
    cold = groups.filter(F.col("size_") <= HOT_ROWS).withColumn("spread_", F.lit(-1).cast("long"))
    first = rows.join(broadcast_measured(hot), KEY, "left")
    first = first.withColumn("spread_", F.when(F.col("hot_size_").isNull(), F.lit(-1)).otherwise(F.col("place_")).cast("long"))
    both = first.join(broadcast_measured(cold), [*KEY, "spread_"], "left")
    chosen = [F.when(F.col("hot_size_").isNull(), F.col(c)).otherwise(F.col(f"hot_{c}")).alias(c) for c in found]
    return both.select("row_", "id_", "place_", "digest_", *chosen)


def deduplicated(docs: DataFrame, keep: str = "smallest", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    return unpacked(verdicts(docs, keep, text, doc_id).filter("kept"), docs.columns)
