"""Extractions kept by content: a table for each part, partitioned by cache key.

A key names the file's bytes, the schema version and the options; any change of one is another key.
Writing a key again replaces its partitions only, and readers see whole partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMA_VERSION, Params
from ..plans.stash import remove


def cache_key(sha256: Column, options: Params) -> Column:
    return F.concat_ws("-", F.substring(sha256, 1, 16), F.lit(f"v{SCHEMA_VERSION}"), F.lit(options.digest()))


def files(spark: SparkSession, path: str, options: Params, pattern: str = "*.pdf") -> DataFrame:
    """``path, content, sha256, cache_key`` of the files at a path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return rows.withColumn("sha256", F.sha2("content", 256)).withColumn("cache_key", cache_key(F.col("sha256"), options))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def store(part: DataFrame, root: str, name: str) -> None:
    """Write rows that have a ``cache_key``; keys that are there already are replaced."""
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str, keys: DataFrame, schema: str | None = None) -> DataFrame | None:
    """Cached rows of the given keys, or None if nothing was ever stored; ``schema``, if given, need not be read from the files."""
    if not _exists(spark, f"{root}/{name}"):
        return None
    reader = spark.read.schema(f"{schema}, cache_key string") if schema else spark.read
    return reader.parquet(f"{root}/{name}").join(keys.select("cache_key").distinct(), "cache_key", "left_semi")


def missing(found: DataFrame, root: str, name: str) -> DataFrame:
    """The files whose key isn't stored under ``name``."""
    spark = found.sparkSession
    if not _exists(spark, f"{root}/{name}"):
        return found
    return found.join(spark.read.schema("cache_key string").parquet(f"{root}/{name}").distinct(), "cache_key", "left_anti")


def clear(spark: SparkSession, root: str) -> None:
    remove(spark, root)
