"""Repeated passages by a sparse suffix array over content-selected positions.

A passage counts when ``LENGTH`` = 50 consecutive words (as written, cut at ASCII white space) occur
at more than one place.  Retained suffixes start at minimisers: of every 50-word window, the 26
windows of 25 words inside it are hashed and the leftmost least is its anchor.  The anchor depends
on the window's words alone, so equal windows have the same anchor at the same offset, and about
one position in thirteen is retained.

1. Suffixes are sorted by range over the cluster, in blocks of 25 words as symbols: the block at the anchor,
   the one to its right, the one to its left, then place.  The order of blocks is that of their hashes,
   which serves as well as any, for all that is asked of neighbours is how far they agree.  A sort
   range may end inside a group of equal suffixes, so no group has to fit in a task.
2. Neighbours are compared in a stream.  Words to the right and left that agree in full extend the
   match over all windows of the anchor; the later place is a repeat of the first.
3. Neighbours that agree at the anchor and not in full have to be extended word by word to both sides, and with
   all classes of the anchor, for the longest match to the right and that to the left may be with different ones.
   So the first place of each class comes back with its text, and meets the others in every window around the
   anchor, o words to the left and 25 - o to the right, by the hash of its words.  The ends of a sort range
   take this way too.

A word is repeated if a 50-word window over it has an equal window at an earlier place, places
ordered by (doc_id, row, word).  Repeats that touch are one span.  Only first places keep a passage, so of
passages that differ in their last word the shared part alone goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stash import discard, fresh, numbered, stash
from .textkit import NOT_SPACE, Words, buffers, grams, slices, words

LENGTH = 50
GRAM = 25
SPAN = LENGTH - GRAM + 1  # windows of GRAM words in one of LENGTH
_LAST = (1 << 63) - 1  # sorts rows without a doc_id last

_SUFFIX = "gram long, right long, left long, doc long, row long, pos long, lo long, hi long"
_FOUND = "open boolean, row long, lo long, hi long, doc long, from_doc long, from_row long, from_lo long"
_PLACE = "hash long, doc long, row long, pos long"


def anchors(g: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, anchor, and first and last window start of every anchor.

    ``g`` are the hashes of all windows of ``GRAM`` words, text i has the words ``first[i]`` and the ``size[i]`` from there.
    """
    n = len(g) - SPAN + 1
    if n <= 0 or size.max(initial=0) < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    at, value, width = np.arange(len(g)), g, 1
    while 2 * width <= SPAN:
        m = len(at) - width
        take = value[:m] <= value[width:]
        at, value = np.where(take, at[:m], at[width:]), np.where(take, value[:m], value[width:])
        width *= 2
    shift = SPAN - width
    at = np.where(value[:n] <= value[shift : shift + n], at[:n], at[shift : shift + n])
    count = np.maximum(size - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(size)), count)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    p = at[q]
    new = np.ones(len(q), bool)
    new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(q)) - 1
    return doc[head], p[head], q[head], q[tail]


def suffixes(w: Words) -> tuple[np.ndarray, ...]:
    """gram, right, left, text, anchor, first and last window start of every retained suffix; places within the text.

    Between texts stand ``GRAM`` marks that no word equals, so contexts that a text's end cuts short differ from others.
    """
    size = np.diff(w.first)
    first = w.first[:-1] - w.first[0] + GRAM * (np.arange(len(size)) + 1)
    padded = np.zeros(int(size.sum()) + GRAM * (len(size) + 1), np.uint64)
    padded[np.arange(int(size.sum())) + np.repeat(first - w.first[:-1] + w.first[0], size)] = w.hash
    g = grams(padded, GRAM)
    doc, p, q0, q1 = anchors(g, first, size)
    base = first[doc]
    return g[p], g[p + GRAM], g[p - GRAM], doc, p - base, q0 - base, q1 - base


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SUFFIX.split(", ")]
    for batch in batches:
        rows, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        buf, off = buffers(batch.column(2))
        for lo, hi in slices(off):
            gram, right, left, text, *places = suffixes(words(buf, off[lo : hi + 1], NOT_SPACE, False))
            keys = [x.view(np.int64) for x in (gram, right, left)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, docs[lo:hi][text], rows[lo:hi][text], *places)], names)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each suffix with the one before it; at most one suffix is kept between batches.

    A suffix that agrees with the first of its class in 75 words gives all its windows, with the place of the
    first window in that one; the first of a class gives them as open ones if its gram has other classes.
    """
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def out(open_: bool, row, lo, hi, doc, from_doc, from_row, from_lo) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), open_)), *(pa.array(x) for x in (row, lo, hi, doc, from_doc, from_row, from_lo))], names)

    head = None  # the first suffix of the class that the last batch ended in
    pending = True  # it hasn't been given out
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        begins = head is None
        if not begins:
            cols = np.concatenate([head[:, None], cols], axis=1)
        gram, right, left, doc, row, pos, lo, hi = cols
        group = np.ones(cols.shape[1], bool)
        group[1:] = gram[1:] != gram[:-1]
        klass = group.copy()
        klass[1:] |= (right[1:] != right[:-1]) | (left[1:] != left[:-1])
        at = np.flatnonzero(klass)
        again = np.flatnonzero(~klass)
        mine = at[np.cumsum(klass) - 1][again]
        yield out(False, row[again], lo[again], hi[again], doc[again], doc[mine], row[mine], lo[again] - pos[again] + pos[mine])
        several = ~group[at]  # not the first class of its gram
        several[:-1] |= ~group[at[1:]]
        if begins:
            several[0] = True  # its gram may have begun in the range before
        elif not pending:
            several[0] = False
        give = at[several]
        yield out(True, row[give], lo[give], hi[give], doc[give], doc[give], row[give], lo[give])
        head = cols[:, at[-1]].copy()
        pending = not several[-1] if (begins or len(at) > 1 or pending) else False
    if head is not None and pending:  # its gram may go on in the next range
        doc, row, _, lo, hi = (head[i : i + 1] for i in range(3, 8))
        yield out(True, row, lo, hi, doc, doc, row, lo)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of every window of the ranges of a text."""
    names = [x.split()[0] for x in _PLACE.split(", ")]
    for batch in batches:
        rows, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        buf, off = buffers(batch.column(2))
        ranges = batch.column(3)
        lists = ranges.offsets.to_numpy()
        lows, highs = (ranges.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for lo, hi in slices(off):
            w = words(buf, off[lo : hi + 1], NOT_SPACE, False)
            g = grams(w.hash, LENGTH)
            owner = np.repeat(np.arange(hi - lo), np.diff(lists[lo : hi + 1]))
            a, b = lows[lists[lo] : lists[hi]], highs[lists[lo] : lists[hi]] + 1
            n = b - a
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            owner = np.repeat(owner, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[w.first[owner] + pos].view(np.int64)), pa.array(docs[lo:hi][owner]), pa.array(rows[lo:hi][owner]), pa.array(pos)], names
            )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per span of repeated words: ``doc_id, start, stop, n_words, first_doc_id``.

    ``start`` and ``stop`` number the words of the text from 0; ``first_doc_id`` is the document of the earliest
    place of the span's first window, maybe the same document.  Rows are told apart whatever their doc_id: rows that
    share one, or have none and come last, are texts of their own and the later one of two equal rows is all
    repeat.  Texts that are null, empty or shorter than 50 words have no spans; an empty table gives
    none.  Other columns are ignored.
    """
    docs = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "row")
    return _spans(docs).select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "first_doc_id")


def _spans(docs: DataFrame) -> DataFrame:
    """``row, doc_id, start, stop, first_doc_id`` for ``row, doc_id, text``."""
    known = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    docs = docs.select("row", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "text").where("text is not null")
    kept = stash(docs.mapInArrow(_suffixes, _SUFFIX), "suffixes")
    keys = ["gram", "right", "left", "doc", "row", "pos"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = kept.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    found = stash(order.mapInArrow(_neighbours, _FOUND), "neighbours")
    discard(kept)

    open_ = found.where("open").groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    windows = stash(docs.join(open_, "row").select("row", "doc", "text", "ranges").mapInArrow(_windows, _PLACE), "windows")
    place = F.struct("doc", "row", "pos")
    first = windows.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    extended = windows.join(first, "hash").where("row <> first.row or pos <> first.pos")
    extended = stash(extended.select("row", "doc", F.col("pos").alias("start"), F.col("first.doc").alias("from_doc"), F.col("first.row").alias("from_row"), F.col("first.pos").alias("from_lo")), "extended")
    discard(windows)

    source = ["from_doc", "from_row", "from_lo"]
    repeats = found.where("not open").select("row", "doc", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("stop"), *source).union(
        extended.select("row", "doc", "start", (F.col("start") + LENGTH).alias("stop"), *source)
    )
    by_row = Window.partitionBy("row").orderBy("start", "stop")
    reach = F.max("stop").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    islands = repeats.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("long")).withColumn("island", F.sum("new").over(by_row))
    spans = islands.groupBy("row", "doc", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(F.struct("start", *source)).alias("first"))
    spans = spans.select("row", "doc", "start", "stop", *[F.col(f"first.{c}").alias(c) for c in source])
    # the first of a class may itself be a repeat, of a place whose wider context differs
    earlier = extended.select(F.col("row").alias("from_row"), F.col("start").alias("from_lo"), F.col("from_doc").alias("least"))
    spans = spans.join(earlier, ["from_row", "from_lo"], "left").withColumn("from_doc", F.coalesce("least", "from_doc"))
    return spans.select("row", known("doc").alias("doc_id"), "start", "stop", known("from_doc").alias("first_doc_id"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text without the words of its spans."""
    for batch in batches:
        texts, spans = batch.column(0), batch.column(1)
        buf, off = buffers(texts)
        lists = spans.offsets.to_numpy()
        starts, stops = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        left = []
        for i in range(batch.num_rows):
            w = words(buf, off[i : i + 2], NOT_SPACE, False)
            pieces, at = [], int(off[i])
            for a, b in zip(starts[lists[i] : lists[i + 1]], stops[lists[i] : lists[i + 1]], strict=True):
                pieces.append(buf[at : w.start[a]].tobytes())
                at = int(w.end[b - 1])
            pieces.append(buf[at : off[i + 1]].tobytes())
            left.append(b"".join(pieces).strip(b" \t\n\v\f\r").decode())
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline stage: ``docs`` without its repeated spans; the earliest place keeps a passage.

    Rows without a span, among them those with null, empty and short texts, come back as they are.  Spans are
    cut from their own row alone, whatever other rows have its doc_id.  ``n_chars``, if there, follows the new
    text.  A row of which nothing is left is dropped.  An empty table stays empty.
    """
    row, spans = fresh(docs.columns, "row", "spans")
    rows = numbered(docs, "doc_id", row)
    found = _spans(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = found.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(spans))
    joined = rows.join(stash(found, "spans"), row, "left")
    rest = [c for c in docs.columns if c != "text"]
    schema = joined.select("text", *rest).schema
    hit = joined.where(F.col(spans).isNotNull()).select("text", spans, *rest).mapInArrow(_cut, schema).where("text <> ''")
    if "n_chars" in rest:
        hit = hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    whole = joined.where(F.col(spans).isNull()).select(*docs.columns)
    return whole.union(hit.select(*docs.columns))
