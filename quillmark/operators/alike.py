"""Which document sentences can be a near sentence of a stated set of sentences, whatever else their documents share.

The set travels to the documents in blocks of bounded size, and documents are not shuffled.  A pair is dropped only
where an upper bound of its common subsequence is too short for the ratio: the shorter length, then the characters
that both have, counted by bucket.  What is left is compared exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BLOCK = 4 << 20  # bytes of sentences in a block
BUCKETS = 32  # the most frequent characters have one each, the others share the last
_WORD = re.compile(r"[^\W_]+")


def token_strings(text: str) -> Iterator[str]:
    """Token strings of the sentences of a text whose lines are paragraphs."""
    for line in text.split("\n"):
        line = T.normalized(line)
        for a, b in T.sentence_spans(line):
            yield " ".join(_WORD.findall(line[a:b].lower()))


class Block:
    """Distinct token strings with the documents that have them."""

    def __init__(self, owners: dict[str, list], threshold: float):
        self.texts, self.owners, self.threshold = list(owners), list(owners.values()), float(threshold)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.low = np.floor(self.size * self.threshold / (200 - self.threshold)).astype(np.int64)
        self.high = np.ceil(self.size * (200 - self.threshold) / max(self.threshold, 1e-9)).astype(np.int64)
        self.bucket = np.full(0x110000, BUCKETS - 1, np.uint8)
        for i, (ch, _) in enumerate(Counter("".join(self.texts)).most_common(BUCKETS - 1)):
            self.bucket[ord(ch)] = i
        longest = int(self.high.max(initial=0))
        self.kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
        self.counts = self.count(self.texts, self.size)

    def count(self, texts: list[str], size: np.ndarray) -> np.ndarray:
        """Characters by bucket, a column for each text."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.repeat(np.arange(len(texts)) * BUCKETS, size) + self.bucket[codes]
        found = np.bincount(at, minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)
        return np.ascontiguousarray(found.T.astype(self.kind))

    def alike(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """Pairs of a place in ``texts`` and one in the block that have the ratio, and that."""
        size = np.array([len(t) for t in texts], np.int64)
        kept = np.flatnonzero((size >= self.low.min(initial=1)) & (size <= self.high.max(initial=0)))
        kept = kept[np.argsort(size[kept], kind="stable")]
        size, counts = size[kept], self.count([texts[i] for i in kept], size[kept])
        first, last = np.searchsorted(size, self.low), np.searchsorted(size, self.high, side="right")
        for k in np.flatnonzero(first < last):
            part = slice(first[k], last[k])
            both = np.minimum(counts[:, part], self.counts[:, k, None]).sum(axis=0, dtype=self.kind)
            hit = np.flatnonzero(both * 200.0 >= (size[part] + self.size[k]) * self.threshold - 1e-6)
            if len(hit):
                masks = T.masks(self.texts[k])
                for i in kept[part][hit]:
                    ratio = T.ratio(self.texts[k], texts[i], masks, self.threshold)
                    if ratio >= self.threshold:
                        yield int(i), int(k), ratio


def _meet(blocks: list[Broadcast], min_tokens: int, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            texts = list(held)
            found = {(a, b) for block in blocks for i, k, _ in block.value.alike(texts) for b in held[texts[i]] for a in block.value.owners[k]}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], kinds[i]) for i in (0, 1)], ["a_doc", "b_doc"])

        held: dict[str, set] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for s in token_strings(text.as_py()):
                    if s.count(" ") >= min_tokens - 1:
                        held.setdefault(s, set()).add(doc)
                if len(held) >= 20_000:
                    yield flush()
        yield flush()

    return run


GROUP = 4096  # sentences of a side that are compared together


def near_sentences(a: DataFrame, b: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """``keys, a_id, b_id, ratio`` of all sentences of a key's two sides that are alike enough.

    Both sides have ``keys, id, toks``.  Sides are cut into groups by id, and every group of A meets every one of B.
    """

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        ids, toks = table.column("id").to_numpy(zero_copy_only=False), np.array(table.column("toks").to_pylist(), object)
        sides = []
        for mine in (left, ~left):
            held: dict[str, list] = {}
            for i, t in zip(ids[mine].tolist(), toks[mine], strict=True):
                held.setdefault(t, []).append(i)
            sides.append(held)
        found = []
        if sides[0] and sides[1]:
            block, texts = Block(sides[0], threshold), list(sides[1])
            found = [(x, y, ratio) for i, k, ratio in block.alike(texts) for x in block.owners[k] for y in sides[1][texts[i]]]
        own = [pa.array([table.column(k)[0].as_py()] * len(found), table.column(k).type) for k in keys]
        rest = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        return pa.table([*own, *rest], [*keys, "a_id", "b_id", "ratio"])

    group = lambda df: df.withColumn("g", F.floor(F.col("id") / GROUP).cast("long"))
    a, b = group(a), group(b)
    meet = lambda mine, other, own, far, flag: mine.join(other.select(*keys, F.col("g").alias(far)).distinct(), keys).select(*keys, F.col("g").alias(own), far, F.lit(flag).alias("left"), F.col("id").cast("long").alias("id"), "toks").select(*keys, "i", "j", "left", "id", "toks")
    rows = meet(a, b, "i", "j", True).union(meet(b, a, "j", "i", False))
    kinds = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", a_id long, b_id long, ratio double"
    return rows.groupBy(*keys, "i", "j").applyInArrow(run, schema)


def near_pairs(sents_a: DataFrame, docs: DataFrame, min_tokens: int, threshold: float, block_bytes: int = BLOCK) -> DataFrame:
    """``a_doc, b_doc``: all pairs in which a sentence of A and one of B are alike enough, runs or none.

    ``sents_a`` has ``doc_id, toks``, ``docs`` has ``doc_id, text``, its lines paragraphs.
    """
    spark = docs.sparkSession
    sents = sents_a.select("doc_id", "toks").where("doc_id is not null").distinct()
    total = sents.agg(F.coalesce(F.sum(F.octet_length("toks")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    blocks = []
    for i in range(n):
        owners: dict[str, list] = {}
        for r in sents.where(F.pmod(F.xxhash64("toks"), F.lit(n)) == i).collect():  # at most about block_bytes
            owners.setdefault(r.toks, []).append(r.doc_id)
        if owners:
            blocks.append(spark.sparkContext.broadcast(Block(owners, threshold)))
    kinds = [x.schema["doc_id"].dataType for x in (sents, docs)]
    arrow = [spark.createDataFrame([], f"x {k.simpleString()}").toArrow().schema.field(0).type for k in kinds]
    found = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(
        _meet(blocks, min_tokens, arrow), f"a_doc {kinds[0].simpleString()}, b_doc {kinds[1].simpleString()}"
    )
    return found.distinct()
