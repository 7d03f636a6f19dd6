"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces that match a text form a lattice.  Forward filtering sums, for every place, the weight
of all segmentations that reach it; backward sampling then draws the last piece, the one before it,
and so on, each in proportion to the filtered weight, which is an exact draw from all segmentations.
A segmentation weighs the product of its pieces; piece with merge rank r weighs
``(r + 2) ** -THETA``, as a BPE model has ranks and no probabilities.

Where no piece has two neighbouring characters side by side, as before spaces and around newlines and most
marks, the lattice falls apart, and chunks between such places are drawn independently.  Each distinct chunk is filtered once while
it stays in a cache of fixed size, whose hits compare bytes; draws use a counter hash of (row key, chunk, step) and so do not
depend on batches, partitions or the cache.  The lattice of a chunk of more than ``LONG`` bytes is not kept but
gone through twice in blocks, so memory stays bounded whatever stands without a space.

Decoding is exact: characters without a piece, newlines, and a literal U+2581 go out as byte pieces,
and the space that stands before a text is taken off again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import PIECE, ByteTable, Grown, buffers, mix, range_hashes, slices

THETA = 0.7
_SPACE = 0x2581
_LITERAL = 0x7FFFFFFF  # a literal U+2581, which no piece matches
_CHAR = 0xE7037ED1A0B428DB
_CACHE_BITS, _CACHE_EDGES, _SIEVE = 20, 6 << 20, 19
_CELLS = 1 << 18  # of lattices filtered together
LONG = 1 << 15  # bytes of a chunk whose lattice isn't kept
_STRIDE = 1 << 14  # characters of such a chunk that are matched together


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_CHAR**i and _CHAR**-i modulo 2**64 for i in 0..n-1 at least."""
    if not _powers or len(_powers[0][0]) < n:
        made = []
        for b in (_CHAR, pow(_CHAR, -1, 1 << 64)):
            p = np.full(max(n, PIECE + 64), b, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = [tuple(made)]
    return _powers[0]


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``_hash`` makes the hash of any range; ranges are as short as pieces."""
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * _power(len(codes) + 1)[0][: len(codes)], out=total[1:])
    return total


def _hash(total: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    return mix((total[start + k] - total[start]) * _power(len(total))[1][start] ^ np.uint64(k))


class Pieces:
    """The model's pieces: lookup by characters, weights, and their bytes."""

    def __init__(self, path: str, theta: float = THETA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte_id = np.zeros(256, np.int64)
        raw: list[bytes] = []
        by_length: dict[int, list[tuple[str, int]]] = {}
        self.log = np.zeros(n)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
            else:
                raw.append(piece.replace("▁", " ").encode())
                by_length.setdefault(len(piece), []).append((piece, i))
            self.log[i] = -theta * np.log(min(-model.get_score(i), n) + 2)
        self.fallback = -theta * np.log(n + 2)
        self.size = np.array([len(x) for x in raw])
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        #: By pairs of bytes: whether they stand side by side in a piece, or in a character.
        joined = np.zeros((256, 256), bool)
        for x in raw:
            pair = np.frombuffer(x, np.uint8)
            joined[pair[:-1], pair[1:]] = True
        joined[:, 0x80:0xC0] = True
        self.joined = joined.reshape(-1)
        self.by_length = {}
        for k, found in sorted(by_length.items()):
            codes = np.frombuffer("".join(p for p, _ in found).encode("utf-32-le"), np.uint32)
            key = _hash(_prefix(codes), np.arange(len(found)) * k, k)
            order = np.argsort(key)
            mask = np.zeros(1 << _SIEVE, bool)
            mask[(key >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
            self.by_length[k] = (mask, key[order], np.array([i for _, i in found])[order])


class Sampler:
    """Draws segmentations; keeps the filtered lattices of chunks."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.strange: dict[int, int] = {}  # characters without a piece, to codes beyond the pieces
        n = len(pieces.log)
        self.weight = Grown(np.float64, np.exp(pieces.log))
        self.flat, self.out, self.n_out = Grown(np.int32, np.arange(n)), Grown(np.int32, np.arange(n)), Grown(np.int32, np.ones(n))
        self._clear()

    def _clear(self) -> None:
        self.known = ByteTable(_CACHE_BITS)
        self.last = Grown(np.int32)  # end node of each chunk; a node is a place after its start
        self.first = Grown(np.int32)  # first edge into each node
        self.cdf, self.source, self.code = Grown(np.float32), Grown(np.int32), Grown(np.int32)  # of edges

    def _bytes_of(self, char: int) -> int:
        """The code of a character that goes out as byte pieces."""
        if char not in self.strange:
            raw = "\u2581".encode() if char == _LITERAL else chr(char).encode()
            self.strange[char] = self.weight.n
            self.weight.add(np.array([np.exp(self.p.fallback * len(raw))]))
            self.out.add(np.array([self.flat.n]))
            self.n_out.add(np.array([len(raw)]))
            self.flat.add(self.p.byte_id[list(raw)])
        return self.strange[char]

    def _match(self, codes: np.ndarray, end_of: np.ndarray) -> np.ndarray:
        """By length less one and start: the piece there, or -1."""
        n, most = len(codes), max(self.p.by_length)
        found = np.full((most, n), -1, np.int32)
        for lo in range(0, n, PIECE):
            hi = min(lo + PIECE, n)
            stop = min(hi + most, n)
            total = _prefix(codes[lo:stop])
            i, room = np.arange(hi - lo), end_of[lo:hi] - np.arange(lo, hi)
            for k, (mask, keys, ids) in self.p.by_length.items():
                fits = room >= k
                i, room = i[fits], room[fits]
                h = _hash(total, i, k)
                near = np.flatnonzero(mask[(h >> np.uint64(64 - _SIEVE)).astype(np.int64)])
                h, near = h[near], i[near]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                found[k - 1, lo + near[hit]] = ids[at[hit]]
        lone = np.flatnonzero(found[0] < 0)
        if len(lone):
            kinds, back = np.unique(codes[lone], return_inverse=True)
            found[0, lone] = np.array([self._bytes_of(c) for c in kinds.tolist()])[back]
        return found

    def _filter(self, chunks: list[bytes]) -> None:
        """Add the lattices of some chunks, those of one length together."""
        texts = [c.decode() for c in chunks]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        codes = np.where(codes == _SPACE, _LITERAL, np.where(codes == 0x20, _SPACE, codes))
        begin = np.cumsum(size) - size
        found = self._match(codes, np.repeat(begin + size, size))
        weight = np.append(self.weight.a[: self.weight.n], 0.0)  # of no piece: 0
        last = np.empty(len(texts), np.int64)
        order = np.argsort(size, kind="stable")
        bounds = np.flatnonzero(np.diff(size[order])) + 1
        for rows in np.split(order, bounds):
            n = int(size[rows[0]])
            most = min(n, len(found))
            for lo in range(0, len(rows), max(1, _CELLS // (n * most))):
                part = rows[lo : lo + max(1, _CELLS // (n * most))]
                base, nodes = self.first.n, len(part) * n
                self._lattices(found, weight, begin[part], n, most)
                last[part] = base + np.arange(n - 1, nodes, n)
        self.last.add(last)

    def _lattices(self, found: np.ndarray, weight: np.ndarray, begin: np.ndarray, n: int, most: int) -> None:
        """Chunks of n characters: shares of the pieces, longest first, that end at each place."""
        rows, length = len(begin), np.arange(most, 0, -1)
        source = np.arange(1, n + 1)[:, None] - length
        code = found[length - 1, begin[:, None, None] + np.maximum(source, 0)]
        code[:, source < 0] = -1
        share = weight[code]
        window = np.zeros((rows, most))  # summed weights of the places before, the nearest last
        window[:, -1] = 1
        for j in range(n):
            share[:, j] *= window
            total = share[:, j].sum(axis=1, keepdims=True)
            share[:, j] /= total
            window[:, :-1] = window[:, 1:] / total  # in units of this place's sum: nothing underflows
            window[:, -1] = 1
        there = code >= 0
        count = there.sum(axis=2).reshape(-1)
        cdf = np.cumsum(share, axis=2)[there]
        first = np.cumsum(count) - count
        cdf[first + count - 1] = np.inf  # rounding must not run past the last edge
        node = self.first.n
        back = np.where(source > 0, source - 1, -1 - node)[None] + node + np.where(source > 0, np.arange(rows)[:, None, None] * n, 0)
        self.source.add(back[there])
        self.code.add(code[there])
        self.first.add(self.cdf.n + first)
        self.cdf.add(cdf)

    def _chunks(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the chunks: they start where no piece goes on from the character before."""
        start = np.zeros(len(buf), bool)
        start[1:] = ~self.p.joined[buf[:-1].astype(np.int32) * 256 + buf[1:]]
        start[off[:-1][off[:-1] < len(buf)]] = True
        s = np.flatnonzero(start)
        return s, np.append(s[1:], len(buf))

    def sample(self, buf: np.ndarray, off: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each text's first (one more offset than texts)."""
        size = np.diff(off)
        at = off[:-1][size > 0]
        buf = np.insert(buf[: off[-1]], at, 0x20)  # the space before each text
        off = off + np.concatenate([[0], np.cumsum(size > 0)])
        s, e = self._chunks(buf, off)
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        if self.cdf.n > _CACHE_EDGES:
            self._clear()
        plain = np.flatnonzero(e - s <= LONG)
        h = range_hashes(buf, s[plain], e[plain])
        chunk = self.known.find(h, buf, s[plain], e[plain])
        miss = np.flatnonzero(chunk < 0)
        if len(miss):
            chunk[miss], reps = self.known.add(h[miss], buf, s[plain[miss]], e[plain[miss]])
            raw = buf.tobytes()
            self._filter([raw[s[i] : e[i]] for i in plain[miss[reps]]])
        owner = np.searchsorted(off, s, side="right") - 1
        rank = np.arange(len(s)) - np.searchsorted(s, off[:-1])[owner]
        salt = mix(seeds[owner] + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first_edge, cdf, source = self.first.a, self.cdf.a, self.source.a
        live, node = plain, self.last.a[chunk]
        taken, whose = [], []
        n = np.zeros(len(s), np.int64)
        turn = 0
        while len(live):
            u = (mix(salt[live] + np.uint64(turn)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first_edge[node]
            more = np.flatnonzero(u > cdf[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] > cdf[edge[more]]]
            taken.append(edge)
            whose.append(live)
            n[live] += 1
            node = source[edge]
            go = node >= 0
            live, node, turn = live[go], node[go], turn + 1
        drawn = {int(i): self._draw_long(buf[s[i] : e[i]].tobytes(), salt[i]) for i in np.flatnonzero(e - s > LONG)}
        for i, codes in drawn.items():
            n[i] = len(codes)
        place = np.cumsum(n)  # pieces were drawn from the end
        edges = np.empty(int(n.sum()), np.int64)
        for t, (edge, own) in enumerate(zip(taken, whose, strict=True)):
            edges[place[own] - 1 - t] = self.code.a[edge]
        for i, codes in drawn.items():
            edges[place[i] - n[i] : place[i]] = codes
        wide = self.n_out.a[edges].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(wide)])
        if total[-1] == len(edges):
            ids = self.flat.a[self.out.a[edges]]
        else:
            ids = self.flat.a[np.repeat(self.out.a[edges] - total[:-1], wide) + np.arange(total[-1])]
        piece_of = np.concatenate([[0], place])[np.searchsorted(s, off)]
        return ids.astype(np.int32), total[piece_of]

    def _ends(self, codes: np.ndarray, lo: int, hi: int, most: int) -> np.ndarray:
        """Pieces that end at each of the places lo+1..hi, the longest first; -1 for none."""
        base = max(0, lo - most + 1)
        part = codes[base : hi + most]
        found = self._match(part, np.full(len(part), min(len(part), hi - base)))
        length = np.arange(most, 0, -1)
        start = np.arange(lo + 1, hi + 1)[:, None] - length - base
        got = found[length - 1, np.maximum(start, 0)]
        got[start < 0] = -1
        return got

    def _draw_long(self, raw: bytes, salt: np.uint64) -> np.ndarray:
        """A draw from a chunk of any length: of the filtered sums alone a number for each place is kept.

        Sums are taken forwards block by block; backwards each block is matched again and its shares follow
        from the sums.
        """
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        codes = np.where(codes == _SPACE, _LITERAL, np.where(codes == 0x20, _SPACE, codes))
        n, most = len(codes), max(self.p.by_length)
        level = np.zeros(n + 1)  # logs of the sums
        window = np.zeros(most)  # sums of the places before over that of the last, the nearest last
        window[-1] = 1
        for lo in range(0, n, _STRIDE):
            hi = min(lo + _STRIDE, n)
            ends = self._ends(codes, lo, hi, most)
            weight = np.append(self.weight.a[: self.weight.n], 0.0)[ends]
            for j in range(hi - lo):
                total = float(weight[j] @ window)
                level[lo + j + 1] = level[lo + j] + np.log(total)
                window[:-1] = window[1:] / total
                window[-1] = 1
        out, place, lo, turn = [], n, n, 0
        while place:
            if place <= lo:
                hi, lo = place, max(0, place - _STRIDE)
                ends = self._ends(codes, lo, hi, most)
                weight = np.append(self.weight.a[: self.weight.n], 0.0)[ends]
            row = place - lo - 1
            before = level[np.maximum(place - np.arange(most, 0, -1), 0)] - level[place]
            share = np.cumsum((weight[row] * np.exp(before))[ends[row] >= 0])
            u = float(mix(np.array([salt + np.uint64(turn)], np.uint64))[0] >> np.uint64(11)) * 2.0**-53
            at = np.flatnonzero(ends[row] >= 0)[min(int(np.searchsorted(share, u, side="left")), len(share) - 1)]
            out.append(int(ends[row, at]))
            place -= most - int(at)
            turn += 1
        return np.array(out[::-1], np.int64)


def decode_ids(p: Pieces, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts whose ids are ``ids[first[i]:first[i+1]]``, and their offsets."""
    size = p.size[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    buf = p.bytes[np.repeat(p.off[ids] - total[:-1], size) + np.arange(total[-1])]
    off = total[first]
    some = np.diff(off) > 0
    keep = np.ones(len(buf), bool)
    keep[off[:-1][some]] = False  # the space before each text
    return buf[keep], off - np.concatenate([[0], np.cumsum(some)])


def _seed(keys: list, seed: int) -> np.ndarray:
    return np.array([zlib.crc32(str(k).encode()) | (zlib.crc32(f"{seed}:{k}".encode()) << 32) for k in keys], np.uint64)


_SAMPLERS: dict[tuple[str, float], Sampler] = {}  # of a Python worker, for all its tasks


def _sampler(path: str, theta: float) -> Sampler:
    if (path, theta) not in _SAMPLERS:
        _SAMPLERS[path, theta] = Sampler(Pieces(path, theta))
    return _SAMPLERS[path, theta]


def _encoder(path: str, theta: float, seed: int, check: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(path, theta)
        pieces = sampler.p
        for batch in batches:
            texts = batch.column(1)
            buf, off = buffers(texts)
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            for lo, hi in slices(off, 1 << 20):
                raw, cut = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                ids, first = sampler.sample(raw, cut, _seed(batch.column(0).slice(lo, hi - lo).to_pylist(), seed))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(missing[lo:hi]))
                part = batch.slice(lo, hi - lo)
                if check:
                    same = _same(raw, cut, *decode_ids(pieces, ids, first))
                    wide = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                    sums = pa.array(crc, pa.int64(), mask=missing[lo:hi])
                    yield pa.RecordBatch.from_arrays([part.column(0), lists, sums, pa.array(same)], [batch.schema.names[0], "ids", "ids_crc32", "lossless"])
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*batch.schema.names, "ids"])

    return run


def _same(buf: np.ndarray, off: np.ndarray, other: np.ndarray, cut: np.ndarray) -> list[bool]:
    """Whether each of two lists of texts are equal, byte by byte."""
    return [np.array_equal(buf[a:b], other[c:d]) for a, b, c, d in zip(off[:-1], off[1:], cut[:-1], cut[1:], strict=True)]


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = part.column(part.num_columns - 1)
                off = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
                buf, cut = decode_ids(p, ids, off - off[0])
                texts = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))
                texts = pa.array(texts.to_pylist(), pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", theta: float = THETA, seed: int = 1) -> DataFrame:
    """``key, text, ids``: a sampled segmentation of every row's text by the model at ``path``.

    The same key and text always give the same ids; rows that repeat both repeat the ids.  A null
    text has null ids, an empty text none.  A null key seeds like the text "None".
    """
    ready = docs.select(key, "text")
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, text string, ids array<int>"
    return ready.mapInArrow(_encoder(path, theta, seed), schema)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with a column ``decoded``, the text of its ``ids``; null ids give null."""
    rest = [c for c in coded.columns if c != "ids"]
    ready = coded.select(*rest, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields) + ", decoded string"
    return ready.mapInArrow(_decoder(path), schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_pieces, ids, ids_crc32, lossless`` for every row of ``docs``.

    The checksum is of the ids as 32-bit numbers, and lossless compares what they decode to with the text.  A null
    text has null ids and checksum, n_pieces -1 and is lossless; an empty text has no ids.  Rows that repeat others
    repeat their result.  An empty table gives no rows.  Other columns are ignored.
    """
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = ready.mapInArrow(_encoder(path, THETA, 1, check=True), "doc_id long, ids array<int>, ids_crc32 long, lossless boolean")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "ids_crc32", "lossless")
