"""Token ids as entropy-coded blocks: a static range asymmetric numeral system.

All blocks share one frequency table, made from the counts of every id in the corpus.  A block holds
whole documents, about ``BLOCK`` ids, and decodes alone.  Id i of a block belongs to lane
i mod lanes; the lanes are independent coders that interleave their 32-bit words in one stream, so a
step codes one id per lane with a handful of numpy operations.  Every ``EVERY`` steps a checkpoint
keeps all coder states and the place in the stream, from which a decoder may start: the reader decodes
the segments of a block side by side, as more lanes.  A block ends with the CRC-32 of what precedes it, and its coders must
end in their first state.

Container: Parquet files in doc_id order, a row for each block (``part, seq, first_doc_id, n_docs,
n_tokens, block``), beside a table of ``token, freq``.  Spark's writer and commit protocol put them
on any store, and a lost executor's rows are written again.

Layout of ``block``, little-endian: magic ``QRNS``; uint32 documents, ids, lanes, words, checkpoints;
int64 doc_ids; uint8 doc_id present; uint32 ids per document; uint64 states; per checkpoint uint32
step, uint32 word, uint64 states; uint32 words; uint32 CRC.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stash import discard, stash
from .textkit import FOLD, NOT_SPACE, ByteTable, Grown, buffers, range_hashes, slices, words

END_ID = 2
BITS = 20
BLOCK = 1 << 20
MAX_LANES, EVERY = 4096, 64
_LOW = np.uint64(1 << 31)
_MAGIC = b"QRNS"
_CACHE_BITS, _CACHE_IDS = 21, 6 << 20


# --- tokenizer --------------------------------------------------------------------


#: Letters (1) and marks (2) of ASCII between which the tokenizer always cuts.  Apostrophes begin
#: contractions, and <, | and > stand in special tokens, so nothing is cut beside them.
_CUTS = np.zeros(256, np.uint8)
_CUTS[[*range(65, 91), *range(97, 123)]] = 1
_CUTS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "'<|>"]] = 2


class ChunkEncoder:
    """Ids of whole texts, equal to the library's for each.

    Only white space and ``_CUTS`` separate what the tokenizer looks at together, and it drops white
    space and case, so a text's ids are those of its chunks.  The library encodes each distinct chunk
    once while it stays in a direct-mapped cache of fixed size, whose hits compare bytes; many go in one
    call, with a character between them that no chunk has.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        mark = self._ids(["\0"])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.known = ByteTable(_CACHE_BITS)
        self.flat, self.off = Grown(np.uint16), Grown(np.int64, [0])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each has."""
        flat, size = [], []
        for lo in range(0, len(chunks), 4096):
            part = chunks[lo : lo + 4096]
            ids = np.array(self._ids([" \0 ".join(part)])[0], np.uint16)
            cut = np.flatnonzero(ids == self.mark) if self.mark is not None else ids[:0]
            if len(cut) == len(part) - 1:
                n = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
                ids = np.delete(ids, cut)
            else:  # a chunk has that character itself
                each = self._ids(part)
                n, ids = np.array([len(x) for x in each]), np.array([x for y in each for x in y], np.uint16)
            flat.append(ids)
            size.append(n)
        return np.concatenate(flat), np.concatenate(size)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's first id (one more offset than texts)."""
        w = words(buf, off, NOT_SPACE, True, _CUTS)
        seen = FOLD[buf]
        special = np.flatnonzero(buf[off[0] : off[-1]] == 0x3C) + off[0]
        if len(special):  # case counts in the names of special tokens
            own = np.unique(np.searchsorted(w.start, special, side="right") - 1)
            size = w.end[own] - w.start[own]
            at = np.repeat(w.start[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            seen[at] = buf[at]
            w.hash[own] = range_hashes(seen, w.start[own], w.end[own])
        if max(self.flat.n, self.known.bytes.n >> 2) > _CACHE_IDS:
            self._clear()
        chunk = self.known.find(w.hash, seen, w.start, w.end)
        miss = np.flatnonzero(chunk < 0)
        if len(miss):
            chunk[miss], reps = self.known.add(w.hash[miss], seen, w.start[miss], w.end[miss])
            raw, at = buf.tobytes(), miss[reps]
            ids, size = self._encode_chunks([raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
            self.off.add(self.flat.n + np.cumsum(size))
            self.flat.add(ids)
        begin = self.off.a[chunk]
        size = self.off.a[chunk + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat.a[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return ids, total[w.first]


_CODERS: dict[str, ChunkEncoder] = {}  # of a Python worker, for all its tasks


def _coder(path: str) -> ChunkEncoder:
    if path not in _CODERS:
        _CODERS[path] = ChunkEncoder(path)
    return _CODERS[path]


# --- coder ------------------------------------------------------------------------


class Table:
    """Frequencies that sum to 2**BITS, one at least for every id that occurs."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order].astype(np.float64)
        total = 1 << BITS
        freq = np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * (total - len(counts))).astype(np.int64))
        rest = total - int(freq.sum())
        by_size = np.argsort(-counts, kind="stable")
        while rest and len(freq):  # the largest take what rounding left
            give = by_size[: max(1, min(abs(rest), len(freq) // 4 + 1))]
            step = np.full(len(give), 1 if rest > 0 else -1)
            if rest < 0:
                step[freq[give] == 1] = 0
            freq[give] += step
            rest -= int(step.sum())
        self.load(tokens, freq)

    def load(self, tokens: np.ndarray, freq: np.ndarray) -> Table:
        self.tokens, self.freqs = tokens, freq
        size = int(tokens.max()) + 1 if len(tokens) else 1
        self.freq, self.first = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[tokens] = freq
        self.first[tokens] = np.cumsum(freq) - freq
        self.symbol = np.repeat(tokens, freq).astype(np.uint16)
        return self

    @classmethod
    def stored(cls, tokens: np.ndarray, freq: np.ndarray) -> Table:
        order = np.argsort(tokens)
        return cls.__new__(cls).load(tokens[order], freq[order])


def encode_ids(table: Table, ids: np.ndarray, lanes: int):
    """Stream of words, states to start decoding with, and checkpoints (step, word, states)."""
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, _LOW)
    parts, marks = [], []
    limit = (_LOW >> np.uint64(BITS)) << np.uint64(32)
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        f, c = table.freq[s], table.first[s]
        y = x[: len(s)]
        spill = y >= limit * f
        parts.append((y[spill] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        y = np.where(spill, y >> np.uint64(32), y)
        q = y // f
        x[: len(s)] = (q << np.uint64(BITS)) + (y - q * f) + c
        if t and t % EVERY == 0:
            marks.append((t, sum(map(len, parts)), x.copy()))
    stream = np.concatenate(parts[::-1]) if parts else np.zeros(0, np.uint32)
    return stream, x, [(t, len(stream) - after, state) for t, after, state in reversed(marks)]


def decode_ids(table: Table, stream: np.ndarray, starts: list[tuple[int, int, np.ndarray]], n: int, lanes: int) -> np.ndarray:
    """All ids, from the start and every checkpoint (step, word, states) at once.

    The segments between checkpoints are decoded side by side, each with its own states and place in the
    stream.  A segment must end in the states of the next, and the last in the coders' first state.
    """
    steps = -(-n // lanes)
    if not steps:
        return np.zeros(0, np.uint16)
    begin = np.array([t for t, _, _ in starts])
    length = np.diff(np.append(begin, steps))
    at = np.array([w for _, w, _ in starts])
    x = np.stack([state for _, _, state in starts]).astype(np.uint64)
    want = np.concatenate([x[1:], np.full((1, lanes), _LOW)])
    out = np.zeros((steps, lanes), np.uint16)
    mask = np.uint64((1 << BITS) - 1)
    for k in range(int(length.max())):
        on = np.flatnonzero(length > k)
        y = x[on]
        slot = y & mask
        s = table.symbol[slot.astype(np.int64)]
        y = table.freq[s] * (y >> np.uint64(BITS)) + slot - table.first[s]
        need = y < _LOW
        idle = None
        if on[-1] == len(starts) - 1 and k == length[-1] - 1 and n % lanes:  # lanes without an id in the last step
            idle = n % lanes
            need[-1, idle:] = False
        place = at[on, None] + np.cumsum(need, axis=1) - need
        y[need] = (y[need] << np.uint64(32)) | stream[place[need]].astype(np.uint64)
        at[on] += need.sum(axis=1)
        out[begin[on] + k] = s
        if idle is not None:
            y[-1, idle:] = x[on[-1], idle:]
        x[on] = y
    if (x != want).any():
        raise ValueError("coders did not end where they should")
    return out.reshape(-1)[:n]


def pack_block(table: Table, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    lanes = int(np.clip(len(ids) // 64, 1, MAX_LANES))
    stream, states, marks = encode_ids(table, ids, lanes)
    present = np.array([d is not None for d in doc_ids], np.uint8)
    body = [
        _MAGIC, struct.pack("<5I", len(doc_ids), len(ids), lanes, len(stream), len(marks)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), present.tobytes(), sizes.astype("<u4").tobytes(), states.astype("<u8").tobytes(),
    ]
    for t, at, state in marks:
        body += [struct.pack("<2I", t, at), state.astype("<u8").tobytes()]
    body.append(stream.astype("<u4").tobytes())
    raw = b"".join(body)
    return raw + struct.pack("<I", zlib.crc32(raw))


class Block:
    """A parsed block; raises ValueError if its bytes or its coders don't check."""

    def __init__(self, raw: bytes):
        if raw[:4] != _MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        docs, self.n, self.lanes, n_words, n_marks = struct.unpack_from("<5I", raw, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        ids, present = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(d) if p else None for d, p in zip(ids, present, strict=True)]
        self.sizes, self.states = take("<u4", docs), take("<u8", self.lanes)
        self.marks = []
        for _ in range(n_marks):
            t, place = take("<u4", 2)
            self.marks.append((int(t), int(place), take("<u8", self.lanes)))
        self.stream = take("<u4", n_words)

    def starts(self) -> list[tuple[int, int, np.ndarray]]:
        """(step, word, states) from which parts decode independently."""
        return [(0, 0, self.states), *self.marks]

    def decode(self, table: Table) -> np.ndarray:
        return decode_ids(table, self.stream, self.starts(), self.n, self.lanes)


# --- over a corpus ----------------------------------------------------------------


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, squeeze = _coder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            buf, off = buffers(batch.column(1))
            for lo, hi in slices(off, 1 << 20):
                ids, first = coder.encode(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                ids = np.insert(ids, first[1:], END_ID)
                first = first + np.arange(len(first))
                raw = ids.tobytes()
                packed = [squeeze.compress(raw[2 * a : 2 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return run


def _loosen(column: pa.Array) -> list[np.ndarray]:
    open_ = zstandard.ZstdDecompressor()
    return [np.frombuffer(open_.decompress(x.as_py()), np.uint16) for x in column]


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            n += np.bincount(np.concatenate(_loosen(batch.column(0).slice(lo, 256))), minlength=1 << 16)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["token", "n"])


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, freq = shared.value
        table = Table.stored(tokens, freq)
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        part = seq = total = 0

        def flush() -> pa.RecordBatch:
            block = pack_block(table, docs, np.array([len(x) for x in held]), np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([docs[0]], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([total], pa.int64()), pa.array([block], pa.binary())],
                ["part", "seq", "first_doc_id", "n_docs", "n_tokens", "block"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(2)[i].as_py()
                docs.append(batch.column(0)[i].as_py())
                held += _loosen(batch.column(1).slice(i, 1))
                total += len(held[-1])
                if total >= BLOCK:
                    yield flush()
                    docs, held, total, seq = [], [], 0, seq + 1
        if docs:
            yield flush()

    return run


_BLOCKS = "part int, seq long, first_doc_id long, n_docs long, n_tokens long, block binary"


def write_blocks(docs: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """Tokenize ``doc_id, text`` and write the blocks and the table; both as read from their files.

    Rows stand in doc_id order, those without one first.  Every text ends with id 2; a null or empty text is that
    id alone.  Rows that repeat others are written each; an empty input gives no blocks and an empty table.
    Other columns are ignored.  A document stays in one block however long it is.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = stash(docs.mapInArrow(_tokenize(tokenizer_path), "doc_id long, ids binary"), "ids")
    counted = coded.select("ids").mapInArrow(_histogram, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    table = Table(np.array([r.token for r in counted], np.int64), np.array([r.n for r in counted], np.int64))  # a row for each id of the vocabulary at most
    stored = stash(spark.createDataFrame([(int(t), int(f)) for t, f in zip(table.tokens, table.freqs, strict=True)], "token int, freq long"), "table")
    shared = spark.sparkContext.broadcast((table.tokens, table.freqs))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", F.xxhash64("ids")]  # the hash splits rows that share an id, or have none
    order = coded.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    blocks = stash(order.mapInArrow(_encoder(shared), _BLOCKS), "blocks")
    discard(coded)
    return blocks, stored


def _decoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.stored(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column(2)[i].as_py())
                ids, n = block.decode(table), len(block.sizes)
                ends = np.cumsum(block.sizes.astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                wide = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip((ends - block.sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(0)[i].as_py(), np.int32)), pa.array(np.full(n, batch.column(1)[i].as_py(), np.int64)), pa.array(block.doc_ids, pa.int64()), pa.array(ends - block.sizes), pa.array(block.sizes.astype(np.int64)), pa.array(crc, pa.int64()), lists],
                    ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read_blocks(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` from the files; damaged blocks raise.

    ``start`` counts the ids of all documents before, in doc_id order (null first, repeated rows in
    any order).  Every document ends with id 2; a null or empty text is that id alone.
    """
    spark = blocks.sparkSession
    rows = table.collect()  # a row for each id of the vocabulary at most
    shared = spark.sparkContext.broadcast((np.array([r.token for r in rows], np.int64), np.array([r.freq for r in rows], np.int64)))
    size = blocks.select("part", "seq", "n_tokens")
    totals = sorted((r.part, r.n) for r in size.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each file
    base, at = [], 0
    for part, n in totals:
        base.append((part, at))
        at += n
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = size.join(spark.createDataFrame(base, "part int, base long"), "part").select("part", "seq", (F.col("base") + before).alias("base"))
    schema = "part int, seq long, doc_id long, offset long, n_tokens long, ids_crc32 long, ids array<int>"
    docs = blocks.select("part", "seq", "block").mapInArrow(_decoder(shared), schema)
    return docs.join(F.broadcast(place) if len(base) <= 1 << 12 and blocks.count() <= 1 << 14 else place, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
