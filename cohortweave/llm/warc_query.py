"""op8: all pages written as WARC files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import warc
from .common import table


def op8_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = warc.new_directory(spark)
    manifest = warc.write_archive(table(spark, sf_dir, "pages"), directory)
    records = warc.read_archive(manifest, directory, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_sharded_warc": op8_sharded_warc}

SQL = {
    "op8_sharded_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p),
quints AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || hex[g * 5 + 1:g * 5 + 5])::BIGINT) AS q FROM f)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((q[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM quints
"""
}
