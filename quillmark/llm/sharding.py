"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows stay where they are read until their shard is known.  The driver counts rows by partition and
draws, partition by partition, how many go to each shard: a multivariate hypergeometric draw from
what the shards still lack, which is the law of these counts under a uniform shuffle, with row sums
the partitions' and column sums the shards' exact sizes.  Each partition then permutes its own shard
labels, rows are exchanged once, and each shard is permuted again.  A number for each partition is
all that reaches the driver, and what goes to tasks grows with the square root of the matrix (``Matrix``).

The second permutation orders a shard by a hash of the row's place.  A shard is cut into ranges of that
hash of about ``RANGE_ROWS`` rows or ``RANGE_BYTES``, and slots are a range's offset and the row's rank in it, so no
task holds a whole shard.

Draws depend on the seed and on row places in the input's partitions.  A plan whose partitions
could differ between runs, any with a shuffle or Python code, is written to the shared folder first; a
task that then meets other rows than were counted fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stash import fresh, stash

RANGE_ROWS, RANGE_BYTES = 1 << 14, 64 << 20
SAMPLER_ROWS = 1_000_000_000  # numpy's sampler takes fewer
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good`` and ``bad`` ones are good, for totals beyond numpy's sampler.

    Inversion over twelve standard deviations around the mode, where ratios of neighbouring
    probabilities need no factorials; what is beyond weighs less than rounding.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    share = good / total if total else 0.0
    reach = 50 + int(12 * np.sqrt(n * share * (1 - share) * ((total - n) / max(total - 1, 1))))
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.int64)
    x = k[:-1].astype(float)
    with np.errstate(divide="ignore"):
        logs = np.log((good - x) / (x + 1)) + np.log((n - x) / (bad - n + x + 1))
    weight = np.concatenate([[0.0], np.cumsum(logs)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(np.searchsorted(chance, rng.random() * chance[-1], side="right"), len(k) - 1)])


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Counts by shard of ``n`` rows drawn from what the shards lack."""
    total = int(left.sum())
    if total < SAMPLER_ROWS:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    if len(left) == 1:
        return np.array([n], np.int64)
    half = len(left) // 2
    good = int(left[:half].sum())
    first = _hypergeometric(rng, good, total - good, n)
    return np.concatenate([_draw(rng, left[:half], first), _draw(rng, left[half:], n - first)])


class Matrix:
    """Counts of rows by partition and shard, drawn as by a uniform shuffle, without the whole matrix anywhere.

    Partitions form groups, about as many as a group has members.  The driver draws each group's counts by shard;
    a task draws those of its own group's partitions, one after another and from what the group still has,
    until it has come to its own.
    """

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, seed: int):
        self.rows, self.seed = rows, seed
        self.width = max(1, int(np.ceil(np.sqrt(len(rows)))))
        rng = np.random.default_rng([seed, 0])
        left = sizes.astype(np.int64).copy()
        self.groups = np.zeros((-(-len(rows) // self.width), len(sizes)), np.int64)
        for g in range(len(self.groups)):
            self.groups[g] = _draw(rng, left, int(rows[g * self.width : (g + 1) * self.width].sum()))
            left -= self.groups[g]

    def row(self, i: int) -> np.ndarray:
        """Counts by shard of partition ``i``."""
        g = i // self.width
        rng, left = np.random.default_rng([self.seed, 2, g]), self.groups[g].copy()
        for n in self.rows[g * self.width : i + 1]:
            got = _draw(rng, left, int(n))
            left -= got
        return got


def communication_matrix(rows: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Counts (partitions, shards) with the given row and column sums, drawn as by a uniform shuffle."""
    matrix = Matrix(rows, sizes, seed)
    return np.array([matrix.row(i) for i in range(len(rows))], np.int64).reshape(len(rows), len(sizes))


def shard_sizes(total: int, n_shards: int) -> np.ndarray:
    """Rows of each shard, at most one apart."""
    return total // n_shards + (np.arange(n_shards) < total % n_shards)


def _stable(docs: DataFrame) -> bool:
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return "Scan" in plan and not any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas", "Sample", "AdaptiveSparkPlan", "Scan ExistingRDD"))


def _bytes(docs: DataFrame) -> Column:
    """Bytes of a row's texts and binaries, and 16 for each other column."""
    long = [f.dataType.typeName() in ("string", "binary") for f in docs.schema.fields]
    parts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, x in zip(docs.columns, long, strict=True) if x]
    return sum(parts, F.lit(16 * (len(long) - len(parts)))).cast("long")


def shuffle_into_shards(docs: DataFrame, n_shards: int, seed: int = 11) -> DataFrame:
    """``docs`` with ``shard int`` (0..n_shards-1) and ``slot long`` (0.. without gaps in each shard).

    Every row, repeated or with nulls, is put somewhere once; row counts of shards differ by one at
    most.  Columns of ``docs`` named shard or slot are replaced, all others come back as they are.  An empty
    input gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    if not _stable(docs):
        docs = stash(docs, "rows")
    place, key, part_of, size, offset, rank = fresh([*docs.columns, "shard", "slot"], "place", "key", "range", "n", "offset", "rank")
    seen = docs.select(F.spark_partition_id().alias("part"), _bytes(docs).alias("b"))
    counted = seen.groupBy("part").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()  # a row for each partition
    counted = sorted((r.part, r.n, r.b) for r in counted)
    parts = np.array([p for p, _, _ in counted], np.int64)
    rows = np.array([n for _, n, _ in counted], np.int64)
    total, volume = int(rows.sum()), sum(b for _, _, b in counted)
    shared = spark.sparkContext.broadcast((parts, Matrix(rows, shard_sizes(total, n_shards), seed)))

    @F.pandas_udf("int")
    def shard_of(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, matrix = shared.value
        mine, labels = -1, np.zeros(0, np.int32)
        for p in places:
            p = p.to_numpy()
            out = np.empty(len(p), np.int32)
            part = p >> _ROW_BITS
            for k in np.unique(part):
                if k != mine:
                    counts = matrix.row(int(np.searchsorted(ids, k)))
                    labels = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                    np.random.default_rng([seed, 1, int(k)]).shuffle(labels)
                    mine = k
                here = part == k
                out[here] = labels[p[here] & ((1 << _ROW_BITS) - 1)]
            yield pd.Series(out)

    ranges = max(1, -(-total // (n_shards * RANGE_ROWS)), -(-volume // (n_shards * RANGE_BYTES)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // (2 * RANGE_BYTES)))
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), place), 1)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn(place, F.monotonically_increasing_id())
        df = df.withColumn("shard", shard_of(place)).withColumn(key, hashed)
        return df.withColumn(part_of, F.least(F.lit(ranges - 1), (F.col(key) / float(1 << 63) * ranges).cast("int")))

    sizes = placed(docs.select()).groupBy("shard", part_of).agg(F.count("*").alias(size))
    before = F.sum(size).over(Window.partitionBy("shard").orderBy(part_of).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("shard", part_of, F.coalesce(before, F.lit(0)).alias(offset))
    ranked = placed(docs).repartition(tasks, "shard", part_of)
    ranked = ranked.withColumn(rank, F.row_number().over(Window.partitionBy("shard", part_of).orderBy(key, place)))
    return ranked.join(offsets, ["shard", part_of]).select(*[f"`{c}`" for c in docs.columns], "shard", (F.col(offset) + F.col(rank) - 1).alias("slot"))


def digest(shards: DataFrame) -> DataFrame:
    """Size, text hash and place of every row of ``shuffle_into_shards``; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
