"""Intermediate tables in the folder that driver and executors share.

A stash is a Parquet table: it cuts lineage, survives the loss of any executor, and lets
later jobs read only the columns they need.  The folder is ``spark.checkpoint.dir``.  Where that is unset
a local session uses ``/tmp/checkpoints``; on a cluster, whose machines share no such folder, it is an error.
What a run has not discarded is deleted when its driver process ends.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = "file:///tmp/checkpoints"  # of local sessions alone
_small: list[bool] = []
_ROOTS: set[str] = set()  # folders that are deleted at exit
_RUN = uuid.uuid4().hex  # names the folder of this driver process


def stash_root(spark: SparkSession) -> str:
    """This run's folder for intermediates, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = LOCAL
    return f"{root.rstrip('/')}/quillmark/{_RUN}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other stash has."""
    root = stash_root(spark)
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_leave, spark, root)
    return f"{stash_root(spark)}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str, thin: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    ``thin`` is for tables of a few numbers a row, such as links: a quarter as many files as there are shuffle
    partitions holds them, and each file costs the store a few calls.
    """
    spark = df.sparkSession
    if _small:
        return spark.createDataFrame(df.toArrow(), df.schema)
    if thin:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stash that no plan reads any more; other frames are left alone."""
    path = getattr(df, "_stash_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store that Spark can reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _leave(spark: SparkSession, root: str) -> None:
    try:
        remove(spark, root)
    except Exception:  # the JVM is gone before this process
        pass


def clear(spark: SparkSession) -> None:
    """Delete all of this run's intermediates; frames that read them are of no use afterwards."""
    remove(spark, stash_root(spark))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that differ from all of ``taken``, whatever its case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, key: str, row: str) -> DataFrame:
    """``df`` with a column ``row`` that no two rows share and that stays the same in every later job.

    Where no two rows share the whole number ``key`` and none lacks it, it is that number.  Else ``df`` is written
    with the numbers, for a plan that is run again, as when executors were lost, may deal rows otherwise.
    """
    unsound = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
    if unsound.isEmpty():
        return df.withColumn(row, F.col(key).cast("long"))
    return stash(df.withColumn(row, F.monotonically_increasing_id()), "numbered")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its scan has tasks for half of them at most; any larger table is left as it is.

    A file of one row group is read by one task, and all that stays within rows would run there too.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


@contextmanager
def in_memory() -> Iterator[None]:
    """Stashes go through the driver's memory: for a pair of files alone, whose tables are a few MB."""
    _small.append(True)
    try:
        yield
    finally:
        _small.pop()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows while stashes are written: long texts make large batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
