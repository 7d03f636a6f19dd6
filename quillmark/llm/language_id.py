"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Two recurrent layers read every byte of a text, one forwards and one backwards; a softmax over both
states gives each position a distribution over languages, and the document's probability is the
mean over its positions.  Texts are cut into windows of ``WINDOW`` bytes, each read from a zero
state in both directions, so windows of many texts are lanes of one matrix and a text of any length
needs bounded memory.

Training is backpropagation through time in numpy on the driver, from a bounded sample of labelled
rows: about ``TRAIN_ROWS`` documents, shared equally between languages and chosen by the hash of
their id and text, of each ``PIECES`` random pieces of ``PIECE_BYTES`` bytes (512 bytes of a text at most).  Only the pieces reach
the driver, and only the weights (some 60 kB) reach the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gru import Adam, Tape, step
from .textkit import buffers, slices

HIDDEN = 8
WINDOW = 192
LANES = 2048
PAD = 256
TRAIN_ROWS, PIECES, PIECE_BYTES = 2400, 8, 64
MAX_SHARED = 1 << 16  # languages whose limits go to every task: some MB
STEPS, BATCH, RATE = 260, 256, 0.02

Weights = dict[str, np.ndarray]


def train(pieces: list[bytes], labels: np.ndarray, n_classes: int, steps: int = STEPS, seed: int = 7) -> Weights:
    """Weights from labelled pieces, in batches with as many pieces of each class."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    w: Weights = {"xf": draw(257, 3 * h), "xb": draw(257, 3 * h), "uf": draw(3 * h, h), "ub": draw(3 * h, h), "v": draw(n_classes, 2 * h), "c": np.zeros((n_classes, 1), np.float32)}
    by_class = [np.flatnonzero(labels == k) for k in range(n_classes)]
    data = np.full((len(pieces), PIECE_BYTES), PAD)
    for i, p in enumerate(pieces):
        data[i, PIECE_BYTES - len(p) :] = np.frombuffer(p, np.uint8)
    adam = Adam(w, RATE)
    for it in range(steps):
        pick = np.concatenate([rng.choice(rows, BATCH // n_classes + 1) for rows in by_class])
        b, y = data[pick].T, labels[pick]
        lanes = len(pick)
        start = np.zeros((h, lanes), np.float32)
        for x in ("xf", "xb"):
            w[x][PAD] = 0
            w[x][PAD, :h] = 30
        fore, back = Tape(w["uf"]), Tape(w["ub"])
        hf = fore.forward(np.ascontiguousarray(w["xf"][b].transpose(0, 2, 1)), start)
        hb = back.forward(np.ascontiguousarray(w["xb"][b[::-1]].transpose(0, 2, 1)), start)[::-1]
        both = np.concatenate([hf, hb], axis=1)
        p = _softmax(np.matmul(w["v"], both) + w["c"])
        real = (b != PAD)[:, None, :]
        d = p.copy()
        d[:, y, np.arange(lanes)] -= 1
        d *= real / np.float32(real.sum())
        dboth = np.matmul(w["v"].T, d)
        grads = {"v": np.einsum("tkl,thl->kh", d, both, optimize=True), "c": d.sum(axis=(0, 2))[:, None]}
        dxf, grads["uf"] = fore.backward(np.ascontiguousarray(dboth[:, :h]))
        dxb, grads["ub"] = back.backward(np.ascontiguousarray(dboth[::-1, h:]))
        for key, dx, bytes_ in (("xf", dxf, b), ("xb", dxb, b[::-1])):
            grads[key] = np.zeros_like(w[key])
            np.add.at(grads[key], bytes_.reshape(-1), dx.transpose(0, 2, 1).reshape(-1, 3 * h))
            grads[key][PAD] = 0
        adam.step(w, grads, 1.0 if it < steps * 0.6 else 0.3)
    return w


def _softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-2, keepdims=True)
    return x


def position_probabilities(w: Weights, symbols: np.ndarray) -> np.ndarray:
    """Probabilities (T, classes, lanes) of every position of the windows ``symbols`` (T, lanes)."""
    h, (t_max, lanes) = HIDDEN, symbols.shape
    both = np.empty((t_max, 2 * h, lanes), np.float32)
    for x, u, part, order in (("xf", "uf", slice(0, h), range(t_max)), ("xb", "ub", slice(h, 2 * h), range(t_max - 1, -1, -1))):
        table = np.ascontiguousarray(w[x].T)
        state = np.zeros((h, lanes), np.float32)
        for t in order:
            state = step(np.take(table, symbols[t], axis=1), w[u], state)
            both[t, part] = state
    return _softmax(np.matmul(w["v"], both) + w["c"])


def document_probabilities(w: Weights, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean over a text's positions of their probabilities; zeros for an empty text."""
    size = np.diff(off)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    begin = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    stop = np.minimum(begin + WINDOW, off[doc + 1])
    total = np.zeros((len(size), len(w["c"])))
    for lo in range(0, len(doc), LANES):
        d, a, b = doc[lo : lo + LANES], begin[lo : lo + LANES], stop[lo : lo + LANES]
        at = b - WINDOW + np.arange(WINDOW)[:, None]
        real = at >= a
        symbols = np.where(real, buf[np.maximum(at, 0)].astype(np.int64), PAD)
        p = position_probabilities(w, symbols)
        if not real.all():
            p *= real[:, None, :]
        np.add.at(total, d, p.sum(axis=0).T)
    return total / np.maximum(size, 1)[:, None]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = buffers(batch.column(1))
        langs, cut = [], []
        for i, (key, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            rng = np.random.default_rng(zlib.crc32(str(key).encode()))
            for a in rng.integers(off[i], max(off[i] + 1, off[i + 1] - PIECE_BYTES + 1), PIECES):
                langs.append(lang)
                cut.append(buf[a : min(a + PIECE_BYTES, off[i + 1])].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cut, pa.binary())], ["lang", "piece"])


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], Weights | None]:
    """Languages and weights from ``doc_id, text, lang``; about ``train_rows`` rows are used.

    Rows without a language or a text take no part, and rows that are equal count once.  Every language
    that has a row with text is in the sample, be there more of them than ``train_rows``.  Without any row the result
    has no languages, with one language no weights.  Other columns are ignored.
    """
    spark = labelled.sparkSession
    labelled = labelled.where("lang is not null and text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    labelled = labelled.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    counts = {r.lang: (r.n, r.least) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}  # a row for each language
    if not counts:
        return [], None
    langs = sorted(counts)
    share = max(1, train_rows // len(langs))
    below = [(k, max(counts[k][1], min((1 << 63) - 1, int((share + 3 * share**0.5) / counts[k][0] * 2.0**63)))) for k in langs]
    limits = spark.createDataFrame(below, "lang string, top long")
    if len(below) <= MAX_SHARED:  # texts stay where they are
        limits = F.broadcast(limits)
    chosen = labelled.join(limits, "lang").where("h <= top")
    chosen = chosen.groupBy("lang", "h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    rows = chosen.select("doc_id", "text", "lang").mapInArrow(_pieces, "lang string, piece binary").orderBy("lang", "piece").collect()
    code = {k: i for i, k in enumerate(langs)}
    if len(langs) == 1:
        return langs, None
    return langs, train([bytes(r.piece) for r in rows], np.array([code[r.lang] for r in rows]), len(langs))


def _predict(langs: list[str], w: Weights | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            buf, off = buffers(batch.column(1))
            for lo, hi in slices(off):
                known = letters[lo:hi] & bool(langs)
                if w is None:
                    best, score = np.zeros(hi - lo, int), np.ones(hi - lo)
                else:
                    p = document_probabilities(w, buf, off[lo : hi + 1])
                    best, score = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
                label = names[np.where(known, best, len(langs))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(label, pa.string()), pa.array(np.where(known, score, 0.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, langs: list[str], weights: Weights | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``, from the text alone.

    A null text or one without a letter gets ``und`` and score 0, as does every text if no
    language was learned; with one learned language the score is 1.  Other columns are ignored.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters)
    return ready.mapInArrow(_predict(langs, weights), "doc_id long, lang_pred string, score double")


def held_out(column: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text leaves the remainder ``part``; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))
