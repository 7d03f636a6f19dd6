"""Words and word windows of Arrow text batches, as numpy arrays.

Texts stay in Arrow's UTF-8 buffers.  Word boundaries come from a byte table and word hashes from
blocks of eight bytes, so no Python object is made per word.  Work goes in slices of a few MB and
pieces of some hundred kB, whatever the batch or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
SLICE = 1 << 19
#: Bytes with A-Z as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_MASK = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)
_LENGTH, _PLACE, _JOIN, _TURN = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

#: Bytes of a word: all but space, tab, newline, vertical tab, form feed and carriage return.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    lo = 0
    while lo < len(off) - 1:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(off) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of some texts: byte ranges, hashes, and the first word of every text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of len(texts) + 1

    def doc(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``buf[start:end]`` of every range, none of them empty.

    Eight bytes at a time go through ``mix``, with their place, before anything is added up: up to eight bytes
    of one length never collide, and longer ranges do so by chance alone, whatever their pattern.
    """
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    size = end - start
    out = mix((eight[start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _LENGTH)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8  # blocks after the first
        first = np.cumsum(more) - more
        nth = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(start[long], more) + 8 * nth
        block = eight[at] & _MASK[np.minimum(np.repeat(end[long], more) - at, 8)]
        out[long] = join(out[long], np.add.reduceat(mix(block + nth.astype(np.uint64) * _PLACE), first))
    return out


def same_bytes(a: np.ndarray, start_a: np.ndarray, end_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Whether the bytes ``a[start_a:end_a]`` and ``b[start_b:end_b]`` of every pair of ranges are equal."""
    size = end_a - start_a
    same = size == end_b - start_b
    live = np.flatnonzero(same & (size > 0))
    if len(live):
        count = (size[live] + 7) // 8
        first = np.cumsum(count) - count
        nth = 8 * (np.arange(int(count.sum())) - np.repeat(first, count))
        mask = _MASK[np.minimum(np.repeat(size[live], count) - nth, 8)]
        sides = []
        for buf, start in ((a, start_a), (b, start_b)):
            padded = np.zeros(len(buf) + 8, np.uint8)
            padded[: len(buf)] = buf
            sides.append(np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))[np.repeat(start[live], count) + nth] & mask)
        same[live] = ~np.logical_or.reduceat(sides[0] != sides[1], first)
    return same


class Grown:
    """An array that grows at its end without being copied each time."""

    def __init__(self, kind, start=()):
        self.a, self.n = np.zeros(1 << 12, kind), 0
        self.add(np.array(start, kind))

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            self.a = np.concatenate([self.a[: self.n], np.zeros(self.n + 2 * len(x), self.a.dtype)])
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)


class ByteTable:
    """Numbers of byte strings, in a direct-mapped table of fixed size; strings are compared, not their hashes alone."""

    def __init__(self, bits: int):
        self.bits = bits
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1)
        self.bytes, self.start, self.end = Grown(np.uint8), Grown(np.int64), Grown(np.int64)

    def find(self, hashed: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each string, or -1 where it isn't in the table."""
        slot = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        got = np.where(self.key[slot] == hashed, self.value[slot], -1)
        hit = np.flatnonzero(got >= 0)
        # of one length up to eight bytes, equal hashes are equal bytes
        at = got[hit]
        size = end[hit] - start[hit]
        same = size == self.end.a[at] - self.start.a[at]
        long = np.flatnonzero(same & (size > 8))
        same[long] = same_bytes(buf, start[hit[long]], end[hit[long]], self.bytes.a[: self.bytes.n], self.start.a[at[long]], self.end.a[at[long]])
        got[hit[~same]] = -1
        return got

    def add(self, hashed: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New numbers of some strings, equal ones alike, and where the first of each new number stands."""
        kinds, first, back = np.unique(hashed, return_index=True, return_inverse=True)
        odd = np.flatnonzero(~same_bytes(buf, start, end, buf, start[first[back]], end[first[back]]))
        number = self.start.n + back
        number[odd] = self.start.n + len(first) + np.arange(len(odd))
        reps = np.concatenate([first, odd])
        slot = (hashed[reps] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.key[slot], self.value[slot] = hashed[reps], self.start.n + np.arange(len(reps))
        size = end[reps] - start[reps]
        ends = np.cumsum(size)
        self.bytes.add(buf[np.repeat(start[reps] - ends + size, size) + np.arange(int(size.sum()))])
        base = self.bytes.n - int(size.sum())
        self.start.add(base + ends - size)
        self.end.add(base + ends)
        return number, reps


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray, lower: bool, kinds: np.ndarray | None = None) -> Words:
    """Words of the texts ``buf[off[i]:off[i+1]]``; with ``lower`` A-Z count as a-z.

    ``kinds`` gives bytes a kind, and cuts words where kinds 1 and 2 meet.
    """
    begin, stop = int(off[0]), int(off[-1])
    starts, ends, hashes = [], [], []
    lo = begin
    while lo < stop:
        hi = min(lo + PIECE, stop)
        if hi < stop and is_word[buf[hi - 1]] and is_word[buf[hi]]:
            breaks = np.flatnonzero(~is_word[buf[lo:hi]])
            if len(breaks):
                hi = lo + int(breaks[-1]) + 1
            while hi < stop and is_word[buf[hi - 1]] and is_word[buf[hi]]:
                more = np.flatnonzero(~is_word[buf[hi : hi + PIECE]])
                hi = hi + int(more[0]) if len(more) else min(hi + PIECE, stop)
        b = buf[lo:hi]
        inside = is_word[b]
        cut = off[np.searchsorted(off, lo) : np.searchsorted(off, hi)] - lo
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[cut] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[cut[cut > 0] - 1] = False
        if kinds is not None:
            kind = kinds[b]
            meet = kind[1:] + kind[:-1] == 3
            before[1:] &= ~meet
            after[:-1] &= ~meet
        s = np.flatnonzero(inside & ~before)
        e = np.flatnonzero(inside & ~after) + 1
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(range_hashes(FOLD[b] if lower else b, s, e))
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(start, end, hashed, np.searchsorted(start, off))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order; not linear in either, so no pattern of words cancels out."""
    x = a * _JOIN
    x ^= x >> np.uint64(32)
    x += b
    x *= _TURN
    x ^= x >> np.uint64(29)
    return x


def grams(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k consecutive words, over text boundaries too; windows are joined by doubling."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, PIECE):
        hi = min(lo + PIECE, n)
        double, width, whole, have = hashed[lo : hi + k - 1], 1, None, 0
        while True:
            if k & width:
                whole = double if whole is None else join(whole[: len(double) - have], double[have:])
                have += width
            if have == k:
                break
            double = join(double[:-width], double[width:])
            width *= 2
        out[lo:hi] = mix(whole[: hi - lo])
    return out


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of every text; of fewer words, all of them as one shingle."""
    g = grams(w.hash, k)
    out = []
    for i in range(len(w.first) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(grams(w.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
