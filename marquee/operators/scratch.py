"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

FEW_ROWS = 1 << 18  # of a few numbers each, which one task joins and groups in a second or so
_SINGLE = "spark.sql.maxSinglePartitionBytes"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode (tests), and an error on a cluster."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marquee-shared-")
    if not known.isDefined():
        sc.setCheckpointDir(at)
    return at


def _path(df_or_spark, at: str):
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table(df: DataFrame, name: str, buckets: int = 0, by: str = "", at: str | None = None, **options: str) -> DataFrame:
    """Written as Parquet in the shared folder and read again, so that a lost executor costs no recomputation.

    The write's shuffle files go as soon as it ends; the table goes with
    :func:`drop`, or else when the application ends. With ``buckets`` its rows lie
    in that many buckets of the column ``by``, so that grouping by it takes no
    shuffle. With ``at`` the table lies there and stays.
    """
    spark = df.sparkSession
    keep, at = at is not None, at or f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    view = f"{name.replace('-', '_')}_{uuid.uuid4().hex}" if buckets else None
    writer = df.write.options(**({"compression": "zstd"} | options))
    try:
        if view:
            writer.format("parquet").bucketBy(buckets, by).option("path", at).saveAsTable(view)
        else:
            writer.parquet(at)
    finally:
        spark.conf.set(_CLEANUP, before)
    if not keep:
        path, fs = _path(spark, at)
        fs.deleteOnExit(path)
    out = spark.table(view) if view else spark.read.schema(df.schema).parquet(at)
    out._written_at, out._view = at, view
    return out


def bucketed(spark: SparkSession, at: str, schema: str, buckets: int, by: str) -> DataFrame:
    """A bucketed table that :func:`table` once wrote at a place of its own."""
    view = f"held_{uuid.uuid4().hex}"
    spark.sql(f"create table {view} ({schema}) using parquet options (path '{at}') clustered by ({by}) into {buckets} buckets")
    out = spark.table(view)
    out._written_at, out._view = at, view
    return out


def few(*tables: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """The rows of written tables of one schema; at most ``most`` as one partition.

    What is grouped or joined among such frames takes no shuffle in :func:`small`.
    Where there are more rows, all is dealt out as usual. A single table can be
    dropped by the result.
    """
    out = reduce(DataFrame.unionByName, tables)
    if out.count() <= most:
        out = out.coalesce(1)
    if len(tables) == 1:
        out._written_at, out._view = getattr(tables[0], "_written_at", None), getattr(tables[0], "_view", None)
    return out


def small(df: DataFrame, name: str) -> DataFrame:
    """:func:`few` rows of a :func:`table`; joins among few() stay in their one task, however large Spark takes their results to be."""
    spark = df.sparkSession
    before = spark.conf.get(_SINGLE)
    spark.conf.set(_SINGLE, str((1 << 63) - 1))
    try:
        return few(table(df, name))
    finally:
        spark.conf.set(_SINGLE, before)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of :func:`table` that nothing reads any more."""
    for df in tables:
        if getattr(df, "_view", None):
            df.sparkSession.sql(f"drop table {df._view}")
        path, fs = _path(df, df._written_at)
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """A small result as a reliable checkpoint, whose files go when nothing refers to the frame any more; its shuffles go at once."""
    written = table(df, name)
    out = written.checkpoint()
    drop(written)
    return out
