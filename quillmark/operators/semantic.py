"""Semantic layer: mutual nearest neighbours by cosine, over units that the verbatim layer left.

Vectors come with the units; where none are given the layer is skipped with a note.  Similarities are
computed in blocks of bounded size by matrix products, and a block gives each unit's best partner only,
so neither the matrix nor its pairs are ever a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import SemanticParams, text_kinds

PAIR = ["a_doc", "b_doc"]
BLOCK = 2048
DIGITS = 12  # similarities equal to so many places are ties, which go to the lower id


def covered_fraction(units: DataFrame, intervals: DataFrame) -> DataFrame:
    """``units`` with ``covered``: characters of intervals in the unit's span over its length.

    Units have ``doc_id, id, para, span``, intervals ``doc_id, para, start, end``.  Intervals that
    overlap count twice, so the share may exceed 1.
    """
    s, e = F.col("span.start"), F.col("span.end")
    cut = intervals.select(F.col("doc_id").alias("_doc"), F.col("para").alias("_para"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = units.join(cut, (F.col("doc_id") == F.col("_doc")) & (F.col("para") == F.col("_para")))
    inside = met.groupBy("doc_id", "id").agg(F.sum(F.greatest(F.lit(0), F.least("_e", e) - F.greatest("_s", s))).alias("_n"))
    share = F.when(e > s, F.coalesce("_n", F.lit(0)) / (e - s)).otherwise(0.0)
    return units.join(inside, ["doc_id", "id"], "left").withColumn("covered", share).drop("_n")


def eligible(units: DataFrame, intervals: DataFrame, excluded: DataFrame, level: str, params: SemanticParams = SemanticParams()) -> DataFrame:
    """Units long enough and mostly unexplained; ``excluded`` has ``doc_id, id`` of near sentences."""
    least = params.min_sentence_tokens if level == "sentence" else params.min_paragraph_tokens
    rows = units.where(F.col("kind").isin(text_kinds(params.include_references)) & (F.size(T.tokenize(F.col("text"))) >= least))
    if level == "sentence":
        rows = rows.join(excluded, ["doc_id", "id"], "left_anti")
    return covered_fraction(rows, intervals).where(F.col("covered") < params.max_verbatim_fraction)


def embed(units: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """``units`` with ``vec``, unit vectors of ``text`` from a model that each worker loads once."""
    columns = units.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields) + ", vec array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for frame in frames:
            vecs = [v for lo in range(0, len(frame), batch) for v in np.asarray(encode(frame["text"].tolist()[lo : lo + batch]), float)]
            yield frame[columns].assign(vec=[(v / (np.linalg.norm(v) or 1.0)).tolist() for v in vecs])

    return units.mapInPandas(run, schema)


def _best(table: pa.Table) -> pa.Table:
    left = table.column("left").to_numpy(zero_copy_only=False)
    ids = table.column("id").to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    left, ids = left[order], ids[order]
    vecs = np.array(table.column("vec").to_pylist(), float)[order]
    a, b = ids[left], ids[~left]
    key = [table.column(k)[0] for k in PAIR]
    if not len(a) or not len(b):
        rows: tuple = ([], [], [], [])
    else:
        sim = np.round(vecs[left] @ vecs[~left].T, DIGITS)
        to_b, to_a = sim.argmax(axis=1), sim.argmax(axis=0)
        rows = (
            [True] * len(a) + [False] * len(b), np.concatenate([a, b]), np.concatenate([b[to_b], a[to_a]]),
            np.concatenate([sim[np.arange(len(a)), to_b], sim[to_a, np.arange(len(b))]]),
        )
    n = len(rows[1])
    return pa.table({PAIR[0]: pa.array([key[0].as_py()] * n, key[0].type), PAIR[1]: pa.array([key[1].as_py()] * n, key[1].type), "left": pa.array(rows[0], pa.bool_()), "id": pa.array(rows[1], pa.int64()), "other": pa.array(rows[2], pa.int64()), "sim": pa.array(rows[3], pa.float64())})


def nearest(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a_doc, b_doc, left, id, other, sim``: each unit's best partner on the other side of its pair.

    Both sides have ``a_doc, b_doc, id, vec``.
    """
    counts = a.groupBy(*PAIR).agg(F.count("*").alias("na")).join(b.groupBy(*PAIR).agg(F.count("*").alias("nb")), PAIR)
    cuts = counts.select(*PAIR, F.ceil(F.col("na") / block).cast("int").alias("ca"), F.ceil(F.col("nb") / block).cast("int").alias("cb"))
    chunk = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = a.join(cuts, PAIR).select(*PAIR, chunk(F.col("ca")).alias("i"), all_of(F.col("cb")).alias("j"), F.lit(True).alias("left"), F.col("id").cast("long"), "vec")
    right = b.join(cuts, PAIR).select(*PAIR, all_of(F.col("ca")).alias("i"), chunk(F.col("cb")).alias("j"), F.lit(False).alias("left"), F.col("id").cast("long"), "vec")
    kinds = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in PAIR) + ", left boolean, id long, other long, sim double"
    found = left.union(right).groupBy(*PAIR, "i", "j").applyInArrow(_best, schema)
    best = found.groupBy(*PAIR, "left", "id").agg(F.max(F.struct("sim", (-F.col("other")).alias("minus"))).alias("m"))
    return best.select(*PAIR, "left", "id", (-F.col("m.minus")).alias("other"), F.col("m.sim").alias("sim"))


def matches(best: DataFrame, threshold: float, mutual: bool = True) -> DataFrame:
    """``a_doc, b_doc, a_id, b_id, sim`` at the threshold or above, each the other's nearest."""
    ab = best.where(F.col("left") & (F.col("sim") >= threshold)).select(*PAIR, F.col("id").alias("a_id"), F.col("other").alias("b_id"), "sim")
    if not mutual:
        return ab
    ba = best.where("not left").select(*PAIR, F.col("id").alias("b_id"), F.col("other").alias("a_id"))
    return ab.join(ba, [*PAIR, "a_id", "b_id"])


def _bin(x: Column) -> Column:
    return F.least(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 10), F.lit(9)).cast("int")


def statistics(best: DataFrame, threshold: float, pairs: DataFrame | None = None, a: DataFrame | None = None, b: DataFrame | None = None) -> DataFrame:
    """Unit counts, mean best similarity of A, shares at the threshold, and ten bins of A's best.

    With ``pairs`` and both sides' units every pair has a row: where a side is empty all but the counts is 0.
    """
    left, s = F.col("left"), F.col("sim")
    share = lambda side: F.coalesce(F.avg(F.when(side, (s >= threshold).cast("double"))), F.lit(0.0))
    bins = F.array(*[F.count_if(left & (_bin(s) == i)) for i in range(10)])
    found = best.groupBy(*PAIR).agg(
        F.count_if(left).alias("n_a"), F.count_if(~left).alias("n_b"), F.round(F.coalesce(F.avg(F.when(left, s)), F.lit(0.0)), 4).alias("mean_max_sim"),
        F.round(share(left), 4).alias("fraction_matched_a"), F.round(share(~left), 4).alias("fraction_matched_b"), bins.alias("histogram"),
    )
    if pairs is None:
        return found
    out = pairs.select(*PAIR).join(found.drop("n_a", "n_b"), PAIR, "left")
    for name, units in (("n_a", a), ("n_b", b)):
        out = out.join(units.groupBy(*PAIR).agg(F.count("*").alias(name)), PAIR, "left")
    zeros = F.array(*[F.lit(0).cast("long")] * 10)
    return out.fillna(0).withColumn("histogram", F.coalesce("histogram", zeros)).select(*found.columns)
