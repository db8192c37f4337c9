"""Session helpers: building, shared scratch space and lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "cohortweave", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without it (tests, a laptop) gets a fresh local folder: on a
    cluster every machine would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master or 'the cluster'} share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses, with its scheme: a bare path is one of the cluster's
    default file system, which tasks that open files themselves must not take for the local disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Survives lost executors, lets a table that several steps read be computed
    once, and gives the optimizer the table's real size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_in(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads no more than that)."""
    return df.limit(max_rows + 1).count() <= max_rows


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``; costs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: The most that is broadcast, measured.
BROADCAST_BYTES = 32 * 1024 * 1024


def _width(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 16
        return 8 * F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) + 16
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 16
    return F.lit(8)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of ``df`` in memory, summed by Spark."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8))
    n, size = df.agg(F.count(F.lit(1)), F.sum(row.cast("long"))).first()
    return n, size or 0


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Let ``df`` be broadcast only when its size is known to be small.

    Below the optimizer's own broadcast threshold nothing needs saying. Above
    it, the estimate is often far too high, so the size is measured.
    Larger sides shuffle, with adaptive skew splitting.
    """
    if planned_bytes(df) <= 10 * 1024 * 1024:
        return df
    return F.broadcast(df) if measured(df)[1] <= BROADCAST_BYTES else df


def lies_by(df: DataFrame, key: str) -> bool:
    """Whether ``df`` is stored in buckets of ``key``, so that a join on it does not move it."""
    layout = df.select(key)._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
    return re.match(rf"hashpartitioning\({re.escape(key)}#\d+\w*, \d+", layout) is not None


#: Files that laying out a table by key may write without moving rows to one task for each bucket.
MAX_BUCKET_FILES = 10_000


def laid_out(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``: joins on it shuffle the other side only, any number of times.

    Each task writes its rows into the buckets; only where that would make too many files are the rows shuffled, once.
    """
    spark = df.sparkSession
    buckets = buckets or max(8, min(20_000, planned_bytes(df) // (256 * 1024 * 1024)))
    path, name = scratch_path(spark, "by_key"), f"by_key_{uuid.uuid4().hex}"
    if df.rdd.getNumPartitions() * buckets > MAX_BUCKET_FILES:
        df = df.repartition(buckets, key)
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def narrowed(table: DataFrame, keys: DataFrame, on: str = "pk") -> DataFrame:
    """``table`` cut down to the wanted keys while it is scanned, when those are few.

    Keeps a large table from being shuffled for a join with a small one in
    which it cannot be the streamed side.
    """
    wanted = keys.select(on).distinct()
    if measured(wanted)[1] > BROADCAST_BYTES:
        return table
    return table.join(F.broadcast(wanted), on, "left_semi")


_STAGED: dict[tuple[str, str], DataFrame] = {}


def staged(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], write: Callable[[DataFrame], DataFrame] = cut
) -> DataFrame:
    """A derived input table, written once per application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STAGED:
        _STAGED[key] = write(build())
    return _STAGED[key]
