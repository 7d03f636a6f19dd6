"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of ten words (a shorter item is one window).  A document contains a
window when every shingle of the window stands in it in order, containment 1.0, so the prefix filter
needs one shingle of each window: the rarest in all documents, counted in a first pass.  Document
shingles meet that prefix index; a match at word p puts the window's start at p minus the shingle's
offset, and the length and positional bounds drop it unless the whole window then fits inside the
document; the survivors are verified word by word over the window.

A benchmark of up to ``BLOCK_BYTES`` of text travels to the documents as one index, and nothing is shuffled but
per-shingle counts.  A larger one stays a table: its windows are keyed by their prefix shingles, documents send the
places whose shingle passes a sieve of those keys, each with the words around it, and the two meet in a join on the
shingle.  Rarity is then counted by ``ORDER_BITS`` of a shingle's hash, which orders shingles alike everywhere and
has one size whatever the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stash import discard, fresh, numbered, stash
from .textkit import ALNUM, FOLD, Words, buffers, grams, same_bytes, slices, words

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4 << 20
ORDER_BITS, SIEVE_BITS = 20, 22
_BITS = 20
_BACK = WINDOW - SHINGLE  # words before a shingle that its window may have

_SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


class PrefixIndex:
    """Windows of a block of items and, per shingle length, the prefix shingle of every window."""

    def __init__(self, ids: list[str], texts: list[str]):
        column = pa.array(texts, pa.large_string())
        buf, off = buffers(column)
        w = words(buf, off, ALNUM, True)
        self.ids = ids
        self.hash, self.words, self.bytes = w.hash, (w.start, w.end), FOLD[buf]
        start, size, item = [], [], []
        for i in range(len(ids)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            m = min(WINDOW, b - a)
            if m:
                start.append(np.arange(a, b - m + 1))
                size.append(np.full(b - m + 1 - a, m))
                item.append(np.full(b - m + 1 - a, i))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.start, self.size, self.item = cat(start), cat(size), cat(item)
        self.shingles = {s: self._shingles(s)[0] for s in range(1, SHINGLE + 1)}

    def _shingles(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of length s in windows that use that length, and each window's own."""
        mine = np.flatnonzero(np.minimum(SHINGLE, self.size) == s)
        if not len(mine):
            return np.zeros(0, np.uint64), mine, np.zeros((0, WINDOW - s + 1), np.uint64)
        g = grams(self.hash, s)
        offset = np.arange(WINDOW - s + 1)
        inside = offset[None, :] <= (self.size[mine] - s)[:, None]
        at = np.minimum(self.start[mine][:, None] + offset[None, :], len(g) - 1)
        own = g[at]
        return np.unique(own[inside]), mine, own

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose the rarest shingle of every window by the corpus counts of ``self.shingles``."""
        self.prefix = {}
        for s in range(1, SHINGLE + 1):
            kinds, mine, own = self._shingles(s)
            if not len(mine):
                continue
            at = np.minimum(np.searchsorted(kinds, own), len(kinds) - 1)
            rare = counts[s][at].astype(np.float64)
            rare[np.arange(own.shape[1])[None, :] > (self.size[mine] - s)[:, None]] = np.inf
            best = rare.argmin(axis=1)
            key = own[np.arange(len(mine)), best]
            order = np.argsort(key, kind="stable")
            key, window, offset = key[order], mine[order], best[order]
            kinds, first = np.unique(key, return_index=True)
            self.prefix[s] = (sieve(kinds), kinds, np.append(first, len(key)), window, offset)

    def hits(self, w: Words, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) pairs in the documents of ``w``, verified by the letters of every word."""
        doc = w.doc()
        found_w, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, (mask, kinds, first, window, offset) in self.prefix.items():
            g = grams(w.hash, s)
            p = lookup(g, mask, kinds)
            k = np.searchsorted(kinds, g[p])
            n = first[k + 1] - first[k]
            p = np.repeat(p, n)
            entry = np.repeat(first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(len(p))
            win, at = window[entry], p - offset[entry]
            size, own = self.size[win], doc[p]
            fits = (at >= w.first[own]) & (at + size <= w.first[own + 1])
            win, at, size = win[fits], at[fits], size[fits]
            for j in range(WINDOW):
                live = j >= size
                same = live | (w.hash[np.minimum(at + j, len(w.hash) - 1)] == self.hash[np.minimum(self.start[win] + j, len(self.hash) - 1)])
                win, at, size = win[same], at[same], size[same]
            found_w.append(win)
            found_p.append(at)
        win, at = np.concatenate(found_w), np.concatenate(found_p)
        if len(win):
            lo, hi = int(w.start[at.min()]), int(w.end[(at + self.size[win] - 1).max()])
            text = FOLD[buf[lo:hi]]
            for j in range(WINDOW):
                live = np.flatnonzero(j < self.size[win])
                mine, own = self.start[win[live]] + j, at[live] + j
                same = np.ones(len(win), bool)
                same[live] = same_bytes(text, w.start[own] - lo, w.end[own] - lo, self.bytes, self.words[0][mine], self.words[1][mine])
                win, at = win[same], at[same]
        return win, at


def sieve(kinds: np.ndarray) -> np.ndarray:
    mask = np.zeros(1 << _BITS, bool)
    mask[(kinds >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return mask


def lookup(g: np.ndarray, mask: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Positions of ``g`` whose value is in the sorted ``kinds``."""
    p = np.flatnonzero(mask[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(p) or not len(kinds):
        return p[:0]
    at = np.minimum(np.searchsorted(kinds, g[p]), len(kinds) - 1)
    return p[kinds[at] == g[p]]


def _count(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: PrefixIndex = shared.value
        masks = {s: sieve(kinds) for s, kinds in index.shingles.items()}
        totals = {s: np.zeros(len(kinds), np.int64) for s, kinds in index.shingles.items()}
        for batch in batches:
            buf, off = buffers(batch.column(0))
            for lo, hi in slices(off):
                w = words(buf, off[lo : hi + 1], ALNUM, True)
                for s, kinds in index.shingles.items():
                    if len(kinds):
                        g = grams(w.hash, s)
                        totals[s] += np.bincount(np.searchsorted(kinds, g[lookup(g, masks[s], kinds)]), minlength=len(kinds))
        for s, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["size", "shingle", "n"])

    return run


def _found(index: PrefixIndex, buf: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    w = words(buf, off, ALNUM, True)
    return w, *index.hits(w, buf)


def _join(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: PrefixIndex = shared.value
        for batch in batches:
            buf, off = buffers(batch.column(1))
            for lo, hi in slices(off):
                w, win, at = _found(index, buf, off[lo : hi + 1])
                doc = w.doc()
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + index.size[win], -1)
                hit = np.cumsum(edge[:-1]) > 0
                new = np.ones(len(hit), bool)
                new[1:] = ~hit[:-1] | (doc[1:] != doc[:-1])
                start = np.flatnonzero(hit & new)
                last = np.ones(len(hit), bool)
                last[:-1] = ~hit[1:] | (doc[1:] != doc[:-1])
                stop = np.flatnonzero(hit & last) + 1
                base = w.first[doc[start]] if len(start) else start
                cuts = np.searchsorted(doc[start] if len(start) else start, np.arange(hi - lo + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(
                    pa.array(cuts), pa.StructArray.from_arrays([pa.array(start - base), pa.array(stop - base)], ["start", "stop"])
                )
                both = np.unique(doc[at] * max(len(index.ids), 1) + index.item[win])
                items: list[set[str]] = [set() for _ in range(hi - lo)]
                for x in both.tolist():
                    items[x // len(index.ids)].add(index.ids[x % len(index.ids)])
                lists = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first).astype(np.int64)), spans, lists], ["doc_id", "n_words", "spans", "items"]
                )

    return run


def _keep(shared: Broadcast, place: int):
    """Rows whose text, column ``place``, has no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: PrefixIndex = shared.value
        for batch in batches:
            buf, off = buffers(batch.column(place))
            for lo, hi in slices(off):
                w, _, at = _found(index, buf, off[lo : hi + 1])
                clean = np.ones(hi - lo, bool)
                clean[np.searchsorted(w.first, at, side="right") - 1] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(clean))

    return run


def _index(docs: DataFrame, items: DataFrame) -> Broadcast:
    """The whole benchmark as one index, its shingles ordered by their count in ``docs``."""
    spark = docs.sparkSession
    rows = items.collect()  # at most BLOCK_BYTES of text
    index = PrefixIndex([r[0] for r in rows], [r[1] for r in rows])
    counted = docs.select("text").mapInArrow(_count(spark.sparkContext.broadcast(index)), "size int, shingle int, n long")
    counts = {s: np.zeros(len(kinds), np.int64) for s, kinds in index.shingles.items()}
    for r in counted.groupBy("size", "shingle").agg(F.sum("n").alias("n")).collect():  # a row for each item shingle at most
        counts[r.size][r.shingle] = r.n
    index.order(counts)
    return spark.sparkContext.broadcast(index)


# --- a benchmark of any size ------------------------------------------------------


def _apart(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with ``WINDOW`` marks, which no word equals, around every text; and each text's first word in them."""
    size = np.diff(w.first)
    first = w.first[:-1] - w.first[0] + WINDOW * (np.arange(len(size)) + 1)
    out = np.zeros(int(size.sum()) + WINDOW * (len(size) + 1), np.uint64)
    out[np.arange(int(size.sum())) + np.repeat(first - w.first[:-1] + w.first[0], size)] = w.hash
    return out, first


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places with a shingle of each of 2**ORDER_BITS kinds in the texts of a task."""
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        buf, off = buffers(batch.column(0))
        for lo, hi in slices(off):
            g = grams(words(buf, off[lo : hi + 1], ALNUM, True).hash, SHINGLE)
            total += np.bincount((g >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["kind", "n"])


def _windows(shared: Broadcast):
    """(item, text) to its windows: words, prefix shingle and that shingle's place in the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            buf, off = buffers(batch.column(1))
            for lo, hi in slices(off):
                w = words(buf, off[lo : hi + 1], ALNUM, True)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for i in range(hi - lo):
                    own = w.hash[w.first[i] : w.first[i + 1]]
                    m = min(WINDOW, len(own))
                    if not m:
                        continue
                    s = min(SHINGLE, m)
                    g = grams(own, s)
                    rare = np.lib.stride_tricks.sliding_window_view(count[(g >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], m - s + 1)
                    best = rare.argmin(axis=1)
                    out[0].extend([lo + i] * len(best))
                    out[1].append(g[np.arange(len(best)) + best])
                    out[2].append(best)
                    out[3].extend(np.lib.stride_tricks.sliding_window_view(own, m).view(np.int64).tolist())
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(out[0])), pa.array(np.concatenate(out[1]).view(np.int64)), pa.array(np.concatenate(out[2]).astype(np.int32)), pa.array(out[3], pa.list_(pa.int64()))],
                        ["item", "key", "ahead", "own"],
                    )

    return run


def _places(shared: Broadcast):
    """(row, text) to the places whose shingle, of any length in use, passes the sieve, with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, lengths = shared.value
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = buffers(batch.column(1))
            for lo, hi in slices(off):
                w = words(buf, off[lo : hi + 1], ALNUM, True)
                line, first = _apart(w)
                for s in lengths:
                    g = grams(line, s)
                    p = np.flatnonzero(mask[(g >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
                    p = p[line[p] != 0]
                    text = np.searchsorted(first, p, side="right") - 1
                    for a in range(0, len(p), 1 << 14):
                        q, t = p[a : a + (1 << 14)], text[a : a + (1 << 14)]
                        near = line[np.minimum(q[:, None] + np.arange(-_BACK, WINDOW), len(line) - 1)]
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * (_BACK + WINDOW)), pa.array(near.reshape(-1).view(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(rows[lo:hi][t]), pa.array(g[q].view(np.int64)), pa.array(q - first[t]), lists], ["row", "key", "pos", "near"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = buffers(batch.column(2))
        n = [np.diff(words(buf, off[lo : hi + 1], ALNUM, True).first) for lo, hi in slices(off)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64))], ["row", "doc_id", "n_words"])


def _hits(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``row, start, stop, item`` of every window in ``row, text``; neither side is collected."""
    spark = rows.sparkSession
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for r in rows.select("text").mapInArrow(_kinds, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.kind] = r.n  # a row for each kind at most
    made = items.mapInArrow(_windows(spark.sparkContext.broadcast(counts)), "item string, key long, ahead int, own array<long>")
    windows = stash(made, "windows")
    mask = np.zeros(1 << SIEVE_BITS, bool)
    for r in windows.select(F.shiftrightunsigned("key", 64 - SIEVE_BITS).alias("kind")).distinct().toLocalIterator():
        mask[r.kind] = True  # a row for each kind at most
    lengths = sorted(r.s for r in windows.select(F.least(F.lit(SHINGLE), F.size("own")).alias("s")).distinct().collect())  # three at most
    places = rows.select("row", "text").mapInArrow(_places(spark.sparkContext.broadcast((mask, lengths))), "row long, key long, pos long, near array<long>")
    kinds = windows.groupBy("own", "key", "ahead").agg(F.count("*").alias("n"))  # each window once, however many items have it
    start = F.col("pos") - F.col("ahead")
    met = places.join(kinds, "key").where(F.slice("near", _BACK + 1 - F.col("ahead"), F.size("own")) == F.col("own"))
    met = met.select("row", start.alias("start"), (start + F.size("own")).alias("stop"), "own").distinct()
    out = stash(met.join(windows.select("own", "item").distinct(), "own").select("row", "start", "stop", "item"), "hits")
    discard(windows)
    return out


def _contamination_of_any(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = numbered(docs, "doc_id", "row")
    hits = _hits(rows, items)
    by_row = Window.partitionBy("row").orderBy("start", "stop")
    reach = F.max("stop").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.select("row", "start", "stop").distinct().withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("long"))
    islands = islands.withColumn("island", F.sum("new").over(by_row)).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = islands.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    names = hits.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = stash(spans.join(names, "row"), "found")
    counted = rows.select("row", "doc_id", "text").mapInArrow(_lengths, "row long, doc_id long, n_words long")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return counted.join(found, "row", "left").select(
        "doc_id", "n_words", none("spans", "array<struct<start:bigint,stop:bigint>>").alias("spans"), none("items", "array<string>").alias("items")
    )


# --- either way -------------------------------------------------------------------


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")


def _fits(items: DataFrame, block_bytes: int) -> bool:
    return items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0] <= block_bytes


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, spans, items``.

    Words are runs of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased.
    ``spans`` are the word ranges (start, stop) covered by occurrences of item windows, merged where
    they touch; ``items`` the distinct ids, as strings in order, of items with such a window.  Null,
    empty and wordless texts have no words and no spans.  Rows that share a doc_id or have none are judged each.
    Items without a word or an id take no part; items that repeat an id count once.  An empty benchmark
    leaves every document clean; an empty table gives no rows.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _items(benchmark)
    if _fits(items, block_bytes):
        return docs.mapInArrow(_join(_index(docs, items)), _SCHEMA)
    return _contamination_of_any(docs, items)


def digest(found: DataFrame) -> DataFrame:
    """Counts and the hash of the item list for every row of ``contamination``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` without a hit word, all columns as they are.

    Every row is judged by its own text, whatever its doc_id; null and wordless texts stay.  An empty table
    stays empty, and an empty benchmark drops nothing.
    """
    items = _items(benchmark)
    if _fits(items, block_bytes):
        return docs.mapInArrow(_keep(_index(docs, items), docs.columns.index("text")), docs.schema)
    row, = fresh(docs.columns, "row")
    rows = numbered(docs, "doc_id", row)
    hit = _hits(rows.select(F.col(row).alias("row"), "text"), items).select(F.col("row").alias(row)).distinct()
    return rows.join(stash(hit, "hit", thin=True), row, "left_anti").select(*docs.columns)
