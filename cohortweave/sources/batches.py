"""Numbered batches in a shared folder, each there as a whole or not at all.

A batch is written beside its place and renamed into it, which is one step on HDFS and local disks. A number that is there
already is not written again: a job that repeats a batch after a failure changes nothing. Readers, streams included,
list only finished batches, in order of their numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_WIDTH = 10


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def place(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/b{number:0{_WIDTH}d}"


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Finished batches, ascending."""
    files, path = _files(spark, folder)
    if not files.exists(path(folder)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path(folder))]
    return sorted(int(n[1:]) for n in names if len(n) == _WIDTH + 1 and n[0] == "b" and n[1:].isdigit())


def put(rows: DataFrame, folder: str, number: int, form: str = "json", **options: str) -> bool:
    """Write ``rows`` as batch ``number``; False, and no change, if it is there already."""
    spark = rows.sparkSession
    files, path = _files(spark, folder)
    target = path(place(folder, number))
    if files.exists(target):
        return False
    beside = path(f"{folder.rstrip('/')}/_writing/{number}-{uuid.uuid4().hex}")
    rows.write.options(**options).format(form).save(beside.toString())
    files.mkdirs(target.getParent())
    if not files.exists(target) and files.rename(beside, target):
        return True
    files.delete(beside, True)  # another attempt at the same batch was faster
    return False


def forget_before(spark: SparkSession, folder: str, number: int) -> None:
    """Remove batches that newer ones replace."""
    files, path = _files(spark, folder)
    for n in numbers(spark, folder):
        if n < number:
            files.delete(path(place(folder, n)), True)
