"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch.  A text's set of five-word shingles is thrown into ``t`` bins in rounds: in round i < t a
shingle with hash x lands in bin h_i(x) with value (i, h_i(x)); in round t + j all shingles land in
bin j.  A bin keeps its least value, and rounds end once every bin is filled, so every coordinate
holds a value and the share of equal coordinates concentrates around the Jaccard similarity as for
sampling without replacement.  A set of n shingles costs about n + t log t operations.

Bands.  ``bands * rows = t``; texts that agree in all rows of a band share a bucket.  Sets that are
equal are first collapsed to one node, so copies cost one row.  In each bucket the member with the
largest buckets overall, which is the original of a group of edited copies, is the centre; only
(centre, member) pairs leave a bucket, never all pairs.

Verification.  Each such pair is confirmed on the full sets.  Members of a cluster of buckets that
this leaves in several components meet again by prefix filtering: shingles are ordered by rarity, and two
texts can be linked only if one of the first seventh of the smaller is among the first quarter of the larger.  Texts that have a frame in
common and little else, which fill buckets without being linked, share none and part here.  Those that do meet
another component are compared exactly as blocks of bounded size: left those outside the largest
component, right everybody; a block returns a spanning forest of its links and not the links.  So
components are those of all confirmed links inside a cluster of buckets.

Words and shingles are told apart by 64-bit hashes that are not linear in bytes or words, equal sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.stash import arrow_rows, discard, fresh, numbered, stash
from .textkit import NOT_SPACE, buffers, mix, shingle_sets, slices, words

SHINGLE = 5
BANDS, ROWS = 42, 6
BLOCK = 768  # texts on each side of an exact block
BATCH = 1000  # rows of texts in memory together
ALIKE, OF = 75, 100
ORDER_BITS = 20  # of a shingle's hash, by which rarity is counted: a table of 4 MB whatever the corpus

_SIGNATURE = "row long, doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def fast_sketch(sets: list[np.ndarray], t: int, seed: int = 1) -> np.ndarray:
    """Sketch of every set of 64-bit hashes, ``t`` coordinates each; an empty set has all ones."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), full, np.uint64)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    cells = out.reshape(-1)
    for i in range(2 * t):
        salt = np.uint64((seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xC2B2AE3D27D4EB4F) % 2**64)
        x = mix(flat ^ salt)
        place = np.uint64(i - t) if i >= t else ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        value = (np.uint64(i) << np.uint64(48)) | (mix(x) >> np.uint64(16))
        np.minimum.at(cells, owner * t + np.asarray(place, dtype=np.int64), value)
        open_ = (out == full).any(axis=1) & (sizes > 0)
        if not open_.any():
            break
        keep = open_[owner]
        flat, owner = flat[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for every band of every sketch, different between bands."""
    part = sketch.reshape(len(sketch), bands, rows)
    key = np.zeros(part.shape[:2], np.uint64)
    for r in range(rows):
        key = mix((key ^ part[:, :, r]) + np.uint64(0x9E3779B97F4A7C15))
    return mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = buffers(batch.column(2))
        for lo, hi in slices(off):
            sets = shingle_sets(words(buf, off[lo : hi + 1], NOT_SPACE, True), SHINGLE)
            n = np.array([len(s) for s in sets], np.int64)
            keys = band_keys(fast_sketch(sets, BANDS * ROWS), BANDS, ROWS)
            ends = np.concatenate([[0], np.cumsum(n)])
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ np.uint64(s)), dtype=np.uint64)]) for s in (0x51, 0xA7)]
            a, b = ((t[ends[1:]] - t[ends[:-1]]).view(np.int64) for t in total)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(a), pa.array(b), lists],
                ["row", "doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y) or OF * min(len(x), len(y)) < ALIKE * max(len(x), len(y)):
        return False
    both = np.intersect1d(x, y, assume_unique=True).size
    return OF * both >= ALIKE * (len(x) + len(y) - both)


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    buf, off = buffers(column)
    out: list[np.ndarray] = []
    for lo, hi in slices(off):
        out += shingle_sets(words(buf, off[lo : hi + 1], NOT_SPACE, True), SHINGLE)
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the linked (a, b); rows of one a come together."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            lefts = _sets_of(batch.column(2).take(pa.array(new)))
            group = np.searchsorted(new, np.arange(len(a)), side="right") - 1
            good = [_linked(lefts[group[i]], y) for i, y in enumerate(_sets_of(batch.column(3)))]
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _forest(table: pa.Table) -> pa.Table:
    """Exact links between the left and the right texts of a block, as a spanning forest."""
    left = table.column("left").to_numpy(zero_copy_only=False)
    node = table.column("node").to_numpy(zero_copy_only=False)
    label = table.column("label").to_numpy(zero_copy_only=False)
    sets = _sets_of(table.column("text"))
    size = np.array([len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), size)
    kinds, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[code]
    owner, code = owner[use], column[code[use]]
    rows_l, rows_r = np.flatnonzero(left), np.flatnonzero(~left)
    at = np.full(len(sets), -1)
    at[rows_l], at[rows_r] = np.arange(len(rows_l)), np.arange(len(rows_r))
    both = np.zeros((len(rows_l), len(rows_r)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = 2048
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, [lo, lo + width])
        o, c = owner[a:b], code[a:b] - lo
        is_l = left[o]
        x = np.zeros((len(rows_l), width), np.float32)
        y = np.zeros((len(rows_r), width), np.float32)
        x[at[o[is_l]], c[is_l]] = 1
        y[at[o[~is_l]], c[~is_l]] = 1
        both += x @ y.T
    union = size[rows_l][:, None] + size[rows_r][None, :] - both
    i, j = np.nonzero((OF * both >= ALIKE * union) & (label[rows_l][:, None] != label[rows_r][None, :]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out_a, out_b = [], []
    for p, q in zip(rows_l[i], rows_r[j], strict=True):
        u, v = find(int(label[p])), find(int(label[q]))
        if u != v:
            root[max(u, v)] = min(u, v)
            out_a.append(int(node[p]))
            out_b.append(int(node[q]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task have a shingle of each of 2**ORDER_BITS kinds."""
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            flat = np.concatenate([*_sets_of(batch.column(0).slice(lo, 512)), np.zeros(0, np.uint64)])
            total += np.bincount((flat >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["kind", "n"])


def _prefixes(shared):
    """(cluster, node, label, text) to (cluster, key, node, label, short), a row for each shingle of the prefix.

    In any one order of all shingles two sets of similarity 0.75 or more share one that stands, in the larger set y,
    among the first |y| - ceil(0.75 |y|) + 1 and, in the smaller set x, among the first |x| - ceil(1.5 / 1.75 |x|) + 1,
    for else what follows is too little; ``short`` marks the latter.  Rare ones come first, so texts that share a frame
    and not their own words meet in none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                keys, short = [], [np.zeros(0, bool)]
                for x in _sets_of(batch.column(3)):
                    n = len(x)
                    order = np.lexsort((x, count[(x >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]))
                    keys.append(x[order[: n - -(-ALIKE * n // OF) + 1]])
                    short.append(np.arange(len(keys[-1])) < n - -(-2 * ALIKE * n // (ALIKE + OF)) + 1)
                at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(flat), batch.column(1).take(at), batch.column(2).take(at), pa.array(np.concatenate(short))], ["cluster", "key", "node", "label", "short"]
                )

    return run


def _open(stars: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, node, label, main, n_left, n_right``: members of clusters in which links may still be missing.

    Clusters are first those of the buckets.  Members of one that has several components meet again by shared
    prefix shingles, and only those that so meet another component stay together.
    """
    spark = stars.sparkSession

    def split(clusters: DataFrame) -> DataFrame:
        member = clusters.join(labels, "node", "left").select("node", "cluster", F.coalesce("label", "node").alias("label"))
        parts = member.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        several = (
            parts.groupBy("cluster")
            .agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"))
            .where("labels > 1")
            .select(
                "cluster", F.col("top.label").alias("main"),
                F.ceil(F.col("all") / BLOCK).cast("int").alias("n_right"),
                F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("n_left"),
            )
        )
        return stash(member.join(stash(several, "several", thin=True), "cluster"), "open", thin=True)

    wide = split(components(stars).withColumnRenamed("label", "cluster"))
    ready = wide.join(texts, "node").select("cluster", "node", "label", "text")
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for r in ready.select("text").mapInArrow(_frequencies, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.kind] = r.n  # a row for each kind at most
    shared = spark.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
    prefix = stash(ready.mapInArrow(_prefixes(shared), "cluster long, key long, node long, label long, short boolean"), "prefixes")
    met = prefix.groupBy("cluster", "key").agg(F.min(F.when(F.col("short"), F.col("node"))).alias("a"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("a is not null and lo < hi")
    close = prefix.join(met.select("cluster", "key", "a"), ["cluster", "key"]).select("a", F.col("node").alias("b"))
    out = split(components(close).withColumnRenamed("label", "cluster"))
    for x in (wide, prefix):
        discard(x)
    return out


def _residual(stars: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components inside a cluster of buckets, as edges of a forest per block."""
    member = _open(stars, texts, labels)
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    left = member.where("label <> main").select(
        "cluster", spread(F.col("n_left")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("j"),
        "node", "label", F.lit(True).alias("left"),
    )
    right = member.select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"), spread(F.col("n_right")).alias("j"),
        "node", "label", F.lit(False).alias("left"),
    )
    blocks = left.union(right).join(texts, "node")
    found = stash(blocks.groupBy("cluster", "i", "j").applyInArrow(_forest, "a long, b long"), "links", thin=True)
    discard(member)
    return found


def _first() -> Column:
    """Order of rows: by doc_id, those without one last, then by row."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Links join texts with ``100 * intersection >= 75 * union`` of their five-word shingles
    (A-Z lower-cased; fewer than five words are one shingle).  ``component_id`` is the least doc_id
    reachable over links, and ``kept`` says whether the row is that document's.  Rows are told apart whatever their
    doc_id: of rows that repeat component_id the first is kept, and where all rows of a
    component lack a doc_id component_id is null and one of them is kept.  A null, empty or wordless text
    has no shingles, is linked with nothing and kept.  An empty table gives no rows.  Other columns are ignored.
    """
    docs = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "row")
    return _components(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _components(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, kept`` for ``row, doc_id, text``."""
    with arrow_rows(docs.sparkSession, BATCH):
        return _linked_rows(docs)


def _linked_rows(docs: DataFrame) -> DataFrame:
    sig = stash(docs.select("row", "doc_id", "text").mapInArrow(_signatures, _SIGNATURE), "signatures")
    same = ["set_a", "set_b", "n_shingles"]
    able = sig.where("n_shingles > 0")
    group = able.groupBy(*same).agg(F.min(_first()).alias("first"))
    group = stash(group.select(*same, F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id")), "sets", thin=True)

    keys = able.join(group.select("node"), able.row == group.node, "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    bucket = stash(keys.join(shared.select("key", "n"), "key"), "buckets")
    weight = stash(bucket.groupBy("node").agg(F.sum("n").alias("weight")), "weights", thin=True)
    centre = bucket.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
    stars = bucket.join(centre, "key").select((-F.col("top.minus")).alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    stars = stash(stars, "stars", thin=True)
    discard(bucket)
    texts = stash(docs.join(weight.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "text"), "texts")

    pairs = stars.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    edges = stash(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long"), "links")
    more = _residual(stars, texts, components(edges))
    for x in (texts, stars, weight):
        discard(x)
    labels = stash(components(edges.union(more)), "labels", thin=True)
    named = group.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.where("label <> node").select("label").distinct()  # components of more than one set
    ends = named.join(least, "label", "left_semi").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("end"))
    ends = stash(ends, "ends", thin=True)  # a small table goes to the large component's rows, not they to one task
    named = named.join(ends, "label", "left").select(
        *same, F.when(F.col("end").isNull(), F.col("doc_id")).otherwise(F.col("end.doc_id")).alias("component_id"), F.coalesce("end.node", "node").alias("keeper")
    )
    linked = sig.drop("bands").where("n_shingles > 0").join(named, same).select("row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("keeper")).alias("kept"))
    alone = sig.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that ``near_duplicates`` keeps, all columns as they are.

    Of equal rows, rows that share a doc_id and rows without one, one row of each component stays; rows
    without words all stay.
    """
    row, = fresh(docs.columns, "row")
    rows = numbered(docs, "doc_id", row)
    gone = _components(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")).where("not kept")
    gone = stash(gone.select(F.col("row").alias(row)), "gone", thin=True)  # broadcast only if its files are small
    return rows.join(gone, row, "left_anti").select(*docs.columns)
