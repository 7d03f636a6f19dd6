"""Document log-likelihood under a gated recurrent language model with a class-factored softmax.

Vocabulary.  Words of all training documents are counted (a shuffle that grows with the corpus).
The frequent ones, above the count that leaves at most ``FREQUENT`` of them, are known to every task:
``CLASSES`` classes of ``MEMBERS`` words each for the most frequent, then ``BANDS`` classes of equal
mass.  All other words, unseen ones included, form the tail class.

Model.  P(word | past) = P(class | state) * P(word | class).  The state is a GRU's over the words so
far, started anew at each document and carried from window to window to its end.  Within the first
classes P(word | class) is a second softmax over the state; within bands and tail it is the word's
share of the class's corpus count, where the tail leaves the share of its words seen once to words
never seen.  All unseen words count as one.

Training.  Truncated backpropagation in numpy: each task trains on its own documents in windows of
``UNROLL`` words, the state carried over; after each of ``ROUNDS`` rounds over different documents
the weights are averaged, weighted by tokens, in a tree of groups.  Every training document is
used once.  A task cuts its stream of documents into equal lanes, so a lane may begin inside a document, from a
zero state, and the last is filled up with the first words again.  Weights, and so scores, follow from how rows are
dealt to tasks and batches and from the order of sums: runs over files split otherwise differ a little.  Counts and
base scores do not.

Scoring.  One pass gives each document what needs the frequent words only, and the list of its tail
words; those are joined with their corpus counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stash import stash
from .gru import Adam, Tape, step
from .textkit import NOT_SPACE, buffers, slices, words

FREQUENT = 1 << 18
RARE = 8  # fewer occurrences than this are always of the tail, from which unseen words are estimated
CLASSES, MEMBERS, BANDS = 32, 32, 16
TOP = CLASSES * MEMBERS
TAIL, END = CLASSES + BANDS, CLASSES + BANDS + 1
N_CLASS = END + 1
N_INPUT = TOP + BANDS + 2
HIDDEN, UNROLL, LANES = 16, 20, 512
ROUNDS, RATE = 4, 0.01
SLICES = 32
_STEPS = 32  # steps whose outputs are computed together
_NEVER = -30.0

Weights = dict[str, np.ndarray]
_SHAPES = {"x": (3 * HIDDEN, N_INPUT), "u": (3 * HIDDEN, HIDDEN), "b": (3 * HIDDEN, 1), "v": (N_CLASS, HIDDEN), "c": (N_CLASS, 1), "w": (CLASSES, MEMBERS, HIDDEN), "d": (CLASSES, MEMBERS, 1)}


@dataclass
class Vocabulary:
    """The frequent words by hash, and totals of the training documents."""

    key: np.ndarray  # sorted hashes
    klass: np.ndarray
    member: np.ndarray  # place in the class's softmax, or -1
    inside: np.ndarray  # natural log of P(word | class), for bands
    base: np.ndarray  # log10 of the smoothed share of all tokens
    tokens: int
    types: int
    documents: int
    tail_tokens: int
    unseen: float  # of the tail's mass
    weights: Weights

    def base_of(self, count: float) -> float:
        return float(np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1))))

    def encode(self, hashed: np.ndarray) -> np.ndarray:
        """Index into the frequent words, or -1."""
        if not len(self.key):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.key, hashed), len(self.key) - 1)
        return np.where(self.key[at] == hashed, at, -1)


def vocabulary(hashes: np.ndarray, counts: np.ndarray, tokens: int, types: int, documents: int, once: int, seed: int = 3) -> Vocabulary:
    """From the frequent words in descending order of count; ``tokens`` and ``types`` hold the ends too."""
    n = len(hashes)
    klass, member, inside = np.full(n, TAIL), np.full(n, -1), np.zeros(n)
    top = min(TOP, n)
    klass[:top], member[:top] = np.arange(top) // MEMBERS, np.arange(top) % MEMBERS
    mass = np.cumsum(counts[top:])
    if n > top:
        klass[top:] = CLASSES + np.minimum(mass * BANDS // (mass[-1] + 1), BANDS - 1).astype(int)
    total = np.bincount(klass, counts, N_CLASS).astype(float)
    inside[top:] = np.log(counts[top:] / total[klass[top:]]) if n > top else 0
    tail = max(0, tokens - documents - int(counts.sum()))
    total[TAIL] += tail
    total[END] = documents
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.15, s).astype(np.float32) for k, s in _SHAPES.items()}
    w["b"][:] = 0
    w["v"] *= np.float32(0.3)
    w["w"] *= np.float32(0.3)
    total[TAIL] += 0.5
    total[END] += 0.5
    with np.errstate(divide="ignore"):
        w["c"][:, 0] = np.maximum(np.log(total / total.sum()), _NEVER)
        share = np.zeros((CLASSES, MEMBERS))
        share[klass[:top], member[:top]] = counts[:top]
        w["d"][:, :, 0] = np.maximum(np.log(share / np.maximum(share.sum(axis=1, keepdims=True), 1)), _NEVER)
    order = np.argsort(hashes, kind="stable")
    base = np.log10((counts + 0.5) / (tokens + 0.5 * (types + 1)))
    return Vocabulary(hashes[order], klass[order], member[order], inside[order], base[order], tokens, types, documents, tail, (once + 0.5) / (tail + 1), w)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=0)
    x -= np.log(np.exp(x).sum(axis=0))
    return x


def _inputs(klass: np.ndarray, member: np.ndarray) -> np.ndarray:
    """The row of the input table for a word: its own in the first classes, else its class's."""
    return np.where(member >= 0, klass * MEMBERS + member, TOP + klass - CLASSES)


def train(w: Weights, klass: np.ndarray, member: np.ndarray, seed: int) -> Weights:
    """A pass of truncated backpropagation over a stream of documents, each closed by an end."""
    n = len(klass)
    lanes = int(np.clip(n // (100 * UNROLL), 1, LANES))  # some hundred steps at least
    length = -(-n // lanes)
    pad = length * lanes - n
    y, m = (np.concatenate([a, a[:pad]]).reshape(lanes, length).T for a in (klass, member))
    before = np.full((1, lanes), END)
    x = np.concatenate([_inputs(before, np.full_like(before, -1)), _inputs(y, m)[:-1]])
    fresh = x == TOP + END - CLASSES
    adam = Adam(w, RATE)
    h = np.zeros((HIDDEN, lanes), np.float32)
    windows = range(0, length, UNROLL)
    for i, lo in enumerate(windows):
        t = slice(lo, min(lo + UNROLL, length))
        h, grads = _window(w, x[t], y[t], m[t], fresh[t], h)
        adam.step(w, grads, min(1.0, (i + 1) / 20))
    return w


def _window(w: Weights, x: np.ndarray, y: np.ndarray, m: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, Weights]:
    steps, lanes = x.shape
    pre = np.take(w["x"], x.reshape(-1), axis=1).reshape(3 * HIDDEN, steps, lanes).transpose(1, 0, 2) + w["b"]
    hs = np.empty((steps, HIDDEN, lanes), np.float32)
    tapes = []
    for t in range(steps):  # a step at a time, for a document's start clears the state
        if fresh[t].any():
            h = h * ~fresh[t]
        tape = Tape(w["u"])
        hs[t] = h = tape.forward(pre[t : t + 1], h)[0]
        tapes.append(tape)
    flat = hs.transpose(1, 0, 2).reshape(HIDDEN, -1)
    y, m, total = y.reshape(-1), m.reshape(-1), steps * lanes
    p = np.exp(_log_softmax(w["v"] @ flat + w["c"]))
    p[y, np.arange(total)] -= 1
    p /= np.float32(total)
    dflat = w["v"].T @ p
    grads = {"v": p @ flat.T, "c": p.sum(axis=1, keepdims=True), "w": np.zeros_like(w["w"]), "d": np.zeros_like(w["d"]), "u": np.zeros_like(w["u"])}
    for k, at in _by_class(y, m):
        part = flat[:, at]
        q = np.exp(_log_softmax(w["w"][k] @ part + w["d"][k]))
        q[m[at], np.arange(len(at))] -= 1
        q /= np.float32(total)
        grads["w"][k], grads["d"][k] = q @ part.T, q.sum(axis=1, keepdims=True)
        dflat[:, at] += w["w"][k].T @ q
    dhs = dflat.reshape(HIDDEN, steps, lanes).transpose(1, 0, 2)
    dpre = np.empty_like(pre)
    carry = np.zeros((HIDDEN, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        carry, dpre[t], dg = _back(tapes[t], dhs[t] + carry)
        grads["u"] += dg @ tapes[t].steps[0][0].T
        if fresh[t].any():
            carry = carry * ~fresh[t]
    dx = dpre.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)
    order = np.argsort(x.reshape(-1), kind="stable")
    rows, first = np.unique(x.reshape(-1)[order], return_index=True)
    grads["x"] = np.zeros_like(w["x"])
    grads["x"][:, rows] = np.add.reduceat(dx[order], first, axis=0).T
    grads["b"] = dpre.sum(axis=(0, 2))[:, None]
    return h, grads


def _back(tape: Tape, dh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, z, r, c, gc = tape.steps[0]
    dc = dh * (1 - z) * (1 - c * c)
    d = np.concatenate([dh * (h - c) * z * (1 - z), dc * gc * r * (1 - r), dc])
    dg = d.copy()
    dg[2 * HIDDEN :] *= r
    return dh * z + tape.u.T @ dg, d, dg


def _by_class(y: np.ndarray, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    own = np.flatnonzero(m >= 0)
    own = own[np.argsort(y[own], kind="stable")]
    kinds, first = np.unique(y[own], return_index=True)
    for k, at in zip(kinds, np.split(own, first[1:]), strict=True) if len(kinds) else ():
        yield int(k), at


def log_probability(w: Weights, klass: np.ndarray, member: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log of the modelled part of every document's probability.

    Document i has the words ``first[i]:first[i+1]``, its end among them.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    inputs = _inputs(klass, member)
    total = np.zeros(len(size))
    h = np.zeros((HIDDEN, len(size)), np.float32)
    for lo in range(0, int(size[0]) if len(size) else 0, _STEPS):
        states, at, who = [], [], []
        for t in range(lo, min(lo + _STEPS, int(size[0]))):
            live = int(np.searchsorted(-size, -t, side="left"))  # documents with more than t words
            here = begin[:live] + t
            x = inputs[here - 1] if t else np.full(live, TOP + END - CLASSES)
            h = step(np.take(w["x"], x, axis=1) + w["b"], w["u"], h[:, :live])
            states.append(h)
            at.append(here)
            who.append(np.arange(live))
        flat, at, who = np.concatenate(states, axis=1), np.concatenate(at), np.concatenate(who)
        y, m = klass[at], member[at]
        logp = _log_softmax(w["v"] @ flat + w["c"])[y, np.arange(len(y))].astype(np.float64)
        for k, own in _by_class(y, m):
            logp[own] += _log_softmax(w["w"][k] @ flat[:, own] + w["d"][k])[m[own], np.arange(len(own))]
        total += np.bincount(who, logp, len(size))
    out = np.empty(len(size))
    out[order] = total
    return out


# --- over a corpus --------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = buffers(batch.column(0))
        kinds, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        for lo, hi in slices(off, 16 << 20):
            held = [words(buf, off[lo : hi + 1], NOT_SPACE, True).hash]
            k, c = np.unique(held[0], return_counts=True)
            kinds, n = np.concatenate([kinds, k]), np.concatenate([n, c])
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["hash", "n"])


def _stream(vocab: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class and member of all words of some documents, an end after each."""
    buf, off = buffers(column)
    ks, ms = [], []
    for lo, hi in slices(off):
        w = words(buf, off[lo : hi + 1], NOT_SPACE, True)
        k, m, _, _ = _with_ends(vocab, w.hash, w.first)
        ks.append(k)
        ms.append(m)
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ks, ms))


def _with_ends(vocab: Vocabulary, hashed: np.ndarray, first: np.ndarray):
    code = vocab.encode(hashed)
    known = code >= 0
    k = np.where(known, vocab.klass[code], TAIL) if len(vocab.key) else np.full(len(code), TAIL)
    m = np.where(known, vocab.member[code], -1) if len(vocab.key) else np.full(len(code), -1)
    k, m = np.insert(k, first[1:], END), np.insert(m, first[1:], -1)
    return k.astype(np.int32), m.astype(np.int32), first + np.arange(len(first)), code


def _pack(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in _SHAPES])


def _unpack(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def _trainer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = shared.value
        w = {k: v.copy() for k, v in vocab.weights.items()}
        seen = 0
        part = 0
        for batch in batches:
            if batch.num_rows:
                part = int(batch.column(1)[0].as_py())
                k, m = _stream(vocab, batch.column(0))
                w = train(w, k, m, seen)
                seen += len(k)
        if seen:
            pieces = np.array_split(_pack(w).astype(np.float64) * seen, SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(np.full(SLICES, part % 64, np.int32)), pa.array(np.full(SLICES, float(seen))), pa.array([p.tobytes() for p in pieces], pa.binary())],
                ["slice", "part", "tokens", "sums"],
            )

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("sums"))
    return pa.table(
        {"slice": table.column("slice").slice(0, 1).cast(pa.int32()), "part": pa.array([0], pa.int32()), "tokens": pa.array([float(sum(table.column("tokens").to_pylist()))]), "sums": pa.array([total.tobytes()], pa.binary())}
    )


def _round(texts: DataFrame, vocab: Vocabulary) -> Weights:
    """Weights after each task has trained on its rows of ``texts``."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    schema = "slice int, part int, tokens double, sums binary"
    rows = texts.select("text", F.spark_partition_id().alias("part")).mapInArrow(_trainer(shared), schema)
    rows = rows.groupBy("slice", "part").applyInArrow(_add, schema).groupBy("slice").applyInArrow(_add, schema)
    got = sorted(rows.collect(), key=lambda r: r.slice)  # SLICES rows: one set of weights
    shared.unpersist()
    if not got:
        return vocab.weights
    return _unpack(np.concatenate([np.frombuffer(bytes(r.sums), np.float64) for r in got]) / got[0].tokens)


def fit(training: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """A model from ``doc_id, text``, and the table ``hash, n`` of its words' counts.

    A null text counts as empty, an empty one as its end alone; rows that repeat others or have no
    doc_id are learned each.  An empty table gives a model to which every word is unseen.  Other columns are ignored.
    """
    spark = training.sparkSession
    training = training.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = training.select("text").mapInArrow(_count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counted = stash(counted, "words")
    documents = training.count()
    level = F.floor(F.log2("n") * 32).cast("int")
    levels = counted.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.count_if(F.col("n") == 1).alias("once")).collect()
    room, least = FREQUENT, 1 << 20
    for r in sorted(levels, key=lambda r: -r.level):  # a few hundred rows
        room -= r.types
        if room < 0 or r.level < 32 * np.log2(RARE):
            break
        least = r.level
    top = counted.where(level >= least).collect()
    top.sort(key=lambda r: (-r.n, r.hash))
    hashes = np.array([r.hash for r in top], np.int64).view(np.uint64)
    counts = np.array([r.n for r in top], np.float64)
    tokens = sum(r.tokens for r in levels) + documents
    types = sum(r.types for r in levels) + (documents > 0)
    once = sum(r.once for r in levels if r.level < least)
    vocab = vocabulary(hashes, counts, tokens, types, documents, once)
    turn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(ROUNDS))
    for i in range(ROUNDS):
        vocab.weights = _round(training.where(turn == i), vocab)
    tail = counted.where(level < least)
    del spark
    return vocab, tail


_LOCAL = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, n_tail long, base double, logp double, tail array<struct<hash:long,n:int>>"


def _local(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = shared.value
        for batch in batches:
            buf, off = buffers(batch.column(3))
            for lo, hi in slices(off, 24 << 20):
                w = words(buf, off[lo : hi + 1], NOT_SPACE, True)
                k, m, first, code = _with_ends(vocab, w.hash, w.first)
                logp = log_probability(vocab.weights, k, m, first)
                doc, known, n = w.doc(), code >= 0, hi - lo
                add = lambda where, x: np.bincount(doc[where], x[where] if x is not None else None, n)  # noqa: E731, B023
                if len(vocab.key):
                    base = add(known, vocab.base[code]) + vocab.base_of(vocab.documents)
                    logp += add(known & (np.insert(m, 0, 0)[1:][np.arange(len(code)) + doc] < 0), vocab.inside[code])
                else:
                    base = np.full(n, vocab.base_of(vocab.documents))
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((w.hash[rare], doc[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (w.hash[order[1:]] != w.hash[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
                head = np.flatnonzero(new)
                times = np.diff(np.append(head, len(order)))
                cuts = np.searchsorted(doc[order[head]], np.arange(n + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(
                    pa.array(cuts), pa.StructArray.from_arrays([pa.array(w.hash[order[head]].view(np.int64)), pa.array(times.astype(np.int32))], ["hash", "n"])
                )
                n_known = add(known, None) + (vocab.documents > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, n) for i in range(3)]
                    + [pa.array((np.diff(w.first) + 1).astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(add(~known, None).astype(np.int64)), pa.array(base), pa.array(logp), tail],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "n_tail", "base", "logp", "tail"],
                )

    return run


def score(docs: DataFrame, vocab: Vocabulary, tail: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    ``docs`` has ``doc_id, text, held_out``; a null text is empty, and an empty text is its end
    alone.  Scores are log10.  ``base_score`` is the add-half unigram's.  Without training documents
    every word is unseen.  Repeated rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.monotonically_increasing_id().alias("row"), "text")
    local = stash(ready.mapInArrow(_local(shared), _LOCAL), "scored")
    rare = local.select("row", F.explode("tail").alias("t")).select("row", F.col("t.hash").alias("hash"), F.col("t.n").alias("times"))
    bottom = vocab.tokens + 0.5 * (vocab.types + 1)
    shares = rare.join(tail, "hash").groupBy("row").agg(
        F.sum("times").alias("met"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("smooth"), F.sum(F.col("times") * F.log10("n")).alias("plain")
    )
    unseen = F.col("n_tail") - F.coalesce("met", F.lit(0))
    known_mass = float(np.log10((1 - vocab.unseen) / max(vocab.tail_tokens, 1))) if vocab.unseen < 1 else 0.0
    return local.drop("tail").join(shares, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("smooth", F.lit(0.0)) + unseen * float(np.log10(0.5)) - F.col("n_tail") * float(np.log10(bottom))).alias("base_score"),
        (F.col("logp") / float(np.log(10)) + F.coalesce("plain", F.lit(0.0)) + F.coalesce("met", F.lit(0)) * known_mass + unseen * float(np.log10(min(vocab.unseen, 1.0)))).alias("score"),
    )
