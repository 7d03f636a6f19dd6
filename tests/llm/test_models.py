import collections
import math
import zlib

import numpy as np
from helpers import ODD, empty, prose, table, words
from pyspark.sql import functions as F

from quillmark.llm import gru, language_id, lm_score, quality, queries


def check_gradients(loss, params, grads, picks=12):
    r = np.random.default_rng(0)
    for k, g in grads.items():
        for _ in range(picks):
            i = tuple(r.integers(0, n) for n in g.shape)
            keep, step = params[k][i], 1e-5
            params[k][i] = keep + step
            up = loss()
            params[k][i] = keep - step
            down = loss()
            params[k][i] = keep
            assert abs((up - down) / (2 * step) - g[i]) < 1e-5 + 1e-3 * abs(g[i]), (k, i)


def test_recurrent_layer_gradients():
    r = np.random.default_rng(2)
    pre, u, want = r.normal(size=(7, 12, 3)), r.normal(size=(12, 4)), r.normal(size=(7, 4, 3))
    params = {"pre": pre, "u": u}

    def run():
        tape = gru.Tape(params["u"])
        return tape, tape.forward(params["pre"], np.zeros((4, 3)))

    tape, out = run()
    dpre, du = tape.backward(2 * (out - want))
    check_gradients(lambda: float(((run()[1] - want) ** 2).sum()), params, {"pre": dpre, "u": du})
    h = np.zeros((4, 3))
    for t in range(7):
        h = gru.step(pre[t], u, h)
    assert np.allclose(h, out[-1])


def test_language_model_gradients_and_total():
    r = np.random.default_rng(3)
    vocab = lm_score.vocabulary(np.arange(1, 1200, dtype=np.uint64), np.sort(r.integers(8, 500, 1199))[::-1].astype(float), 300000, 1300, 50, 40)
    w = {k: v.astype(float) for k, v in vocab.weights.items()}
    code = r.integers(0, 1199, (5, 4))
    y, m = vocab.klass[code], vocab.member[code]
    y[2, 1], m[2, 1] = lm_score.END, -1
    x = np.concatenate([np.full((1, 4), lm_score.TOP + lm_score.END - lm_score.CLASSES), lm_score._inputs(y, m)[:-1]])
    fresh = x == lm_score.TOP + lm_score.END - lm_score.CLASSES
    _, grads = lm_score._window(w, x, y, m, fresh, np.zeros((lm_score.HIDDEN, 4)))

    def loss():
        total, h = 0.0, np.zeros((lm_score.HIDDEN, 4))
        for t in range(5):
            h = gru.step(w["x"][:, x[t]] + w["b"], w["u"], h * ~fresh[t])
            c = lm_score._log_softmax(w["v"] @ h + w["c"])
            for lane in range(4):
                total -= c[y[t, lane], lane]
                if m[t, lane] >= 0:
                    k = y[t, lane]
                    total -= lm_score._log_softmax(w["w"][k] @ h[:, [lane]] + w["d"][k])[m[t, lane], 0]
        return total / 20

    check_gradients(loss, w, grads)
    # the modelled parts of all words sum to one: classes do, and members of a class
    h = r.normal(size=(lm_score.HIDDEN, 1))
    assert np.isclose(np.exp(lm_score._log_softmax(w["v"] @ h + w["c"])).sum(), 1)
    bands = [np.exp(vocab.inside[(vocab.klass == k)]).sum() for k in range(lm_score.CLASSES, lm_score.TAIL) if (vocab.klass == k).any()]
    assert np.allclose(bands, 1)


def test_document_probability_step_by_step():
    """Over documents of several windows and of none, from the definition, a word at a time."""
    r = np.random.default_rng(8)
    vocab = lm_score.vocabulary(np.arange(1, 1500, dtype=np.uint64), np.sort(r.integers(8, 900, 1499))[::-1].astype(float), 400000, 1600, 60, 40)
    w = {k: v + r.normal(0, 0.2, v.shape).astype(np.float32) for k, v in vocab.weights.items()}
    sizes = [1, 3 * lm_score._STEPS + 7, 2, lm_score._STEPS, 150, 1]
    code = r.integers(0, 1499, sum(sizes))
    klass, member = vocab.klass[code].copy(), vocab.member[code].copy()
    first = np.concatenate([[0], np.cumsum(sizes)])
    klass[first[1:] - 1], member[first[1:] - 1] = lm_score.END, -1
    sig = lambda x: 1 / (1 + np.exp(-x))
    n, want = lm_score.HIDDEN, []
    for a, b in zip(first[:-1], first[1:]):
        h, total, seen = np.zeros(n), 0.0, lm_score.TOP + lm_score.END - lm_score.CLASSES
        for i in range(a, b):
            pre, g = w["x"][:, seen] + w["b"][:, 0], w["u"] @ h
            z, reset = sig(pre[:n] + g[:n]), sig(pre[n : 2 * n] + g[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(pre[2 * n :] + reset * g[2 * n :])
            k, m = int(klass[i]), int(member[i])
            scores = w["v"] @ h + w["c"][:, 0]
            total += scores[k] - math.log(sum(math.exp(x) for x in scores))
            if m >= 0:
                scores = w["w"][k] @ h + w["d"][k, :, 0]
                total += scores[m] - math.log(sum(math.exp(x) for x in scores))
            seen = k * lm_score.MEMBERS + m if m >= 0 else lm_score.TOP + k - lm_score.CLASSES
        want.append(total)
    assert np.allclose(lm_score.log_probability(w, klass, member, first), want, rtol=1e-4, atol=1e-3)


def test_language_network_byte_by_byte():
    r = np.random.default_rng(4)
    n, classes = language_id.HIDDEN, 3
    w = {"xf": r.normal(size=(257, 3 * n)), "xb": r.normal(size=(257, 3 * n)), "uf": r.normal(size=(3 * n, n)), "ub": r.normal(size=(3 * n, n)), "v": r.normal(size=(classes, 2 * n)), "c": r.normal(size=(classes, 1))}
    for x in ("xf", "xb"):  # padding leaves a zero state alone, as training sees to
        w[x][language_id.PAD], w[x][language_id.PAD, :n] = 0, 30
    w = {k: v.astype(np.float32) for k, v in w.items()}
    texts = [b"", b"a", bytes(r.integers(0, 256, 2 * language_id.WINDOW + 31).tolist()), bytes(r.integers(0, 256, language_id.WINDOW).tolist()), "Grüße".encode()]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def read(symbols, x, u):
        h, out = np.zeros(n), []
        for s in symbols:
            pre, g = x[s], u @ h
            z, reset = sig(pre[:n] + g[:n]), sig(pre[n : 2 * n] + g[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(pre[2 * n :] + reset * g[2 * n :])
            out.append(h)
        return out

    want = np.zeros((len(texts), classes))
    for i, t in enumerate(texts):
        for a in range(0, len(t), language_id.WINDOW):
            part = t[a : a + language_id.WINDOW]
            for f, b in zip(read(part, w["xf"], w["uf"]), read(part[::-1], w["xb"], w["ub"])[::-1]):
                e = np.exp(w["v"] @ np.concatenate([f, b]) + w["c"][:, 0])
                want[i] += e / e.sum() / len(t)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = language_id.document_probabilities(w, np.frombuffer(b"".join(texts), np.uint8), off)
    assert np.allclose(got, want, atol=2e-4) and np.allclose(got[1:].sum(axis=1), 1, atol=1e-4)


def test_every_language_is_learned(spark):
    rows = [(i % 7 if i % 3 else None, f"text {chr(97 + i % 26)}" * 5, f"l{i % 40:02}") for i in range(400)] + [(None, "the same", "l00")] * 500
    langs, w = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=20)
    assert langs == [f"l{i:02}" for i in range(40)] and w["v"].shape[0] == 40


def held(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


def test_lm_counts_and_held_out_gain(spark):
    texts = [*ODD] + [prose(s, 150, 90) if s % 2 else prose(s, 150, 90).replace("w", "v") for s in range(150)]
    docs = table(spark, texts).withColumn("held_out", language_id.held_out(parts=5, part=1))
    vocab, tail = lm_score.fit(docs.where("not held_out"))
    got = {r.doc_id: r for r in lm_score.score(docs, vocab, tail).collect()}
    counts = collections.Counter()
    for k, t in [*enumerate(texts), (None, "a row without an id")]:
        if k is None or not held(k, 5, 1):
            counts.update([*words(t), "<end>"])
    n, v = sum(counts.values()), len(counts)
    gain = 0.0
    for k, t in enumerate(texts):
        w, r = [*words(t), "<end>"], got[k]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k, 5, 1), len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9 and r.score < 0
        gain += (r.score - r.base_score) * (r.held_out and k >= len(ODD))
    assert gain > 0 and len(got) == len(texts) + 1


def test_lm_without_training(spark):
    docs = table(spark, ["one two"]).withColumn("held_out", F.lit(True))
    vocab, tail = lm_score.fit(docs.where("not held_out"))
    rows = lm_score.score(docs, vocab, tail).collect()
    assert len(rows) == 2 and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in rows)


def test_language_identification(spark, small):
    rows = queries.op4_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.95
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = table(spark, [*ODD, *["hello there world"] * 4, *["bonjour le monde"] * 4])
    langs, w = language_id.fit(docs.withColumn("lang", F.when(F.col("text").like("bon%"), "fr").when(F.col("text").like("hello%"), "en")))
    got = {r.doc_id: r for r in language_id.identify(docs, langs, w).collect()}
    assert langs == ["en", "fr"] and len(got) == len(ODD) + 9
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {0, 1, 2}
    assert language_id.fit(empty(spark)) == ([], None)
    assert {r.lang_pred for r in language_id.identify(docs, [], None).collect()} == {"und"}


def test_quality_counts_match_brute_force(spark):
    texts = [*ODD, "x y z\nx y z\n\n q", "a a a a a", prose(1, 90), prose(2, 60) + " " + prose(2, 60), "### " * 90, (prose(3, 10) + "\n") * 12]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    for k, t in enumerate(texts):
        w = words(t, fold=False)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(repeat), failed) and not (failed and r.kept)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {k for k, r in got.items() if r.kept}
    assert quality.assess(empty(spark)).count() == 0


def test_posterior_is_that_of_plain_em(spark):
    """EM from its definition, over rows instead of patterns."""
    texts = [prose(s, 80).translate(str.maketrans("0123456789", "eatoinshrd")).replace("e w", "e. w") for s in range(30)] + ["### " * 90] * 5 + [prose(s, 70) for s in range(8)] + [(prose(3, 10) + "\n") * 12, "AB CD " * 60, None, "x"]
    got = quality.assess(table(spark, texts)).collect()
    rules = list(quality.votes())
    rows = [[r[v] for v in rules] for r in got]
    share, rates = 0.85, {(v, vote): list(quality.START[vote]) for v in rules for vote in (1, -1)}

    def good(row):
        odds = share / (1 - share)
        for v, vote in zip(rules, row):
            if vote:
                odds *= rates[v, vote][0] / rates[v, vote][1]
        return odds / (1 + odds)

    for _ in range(quality.ROUNDS):
        p = [good(row) for row in rows]
        n = sum(p), len(p) - sum(p)
        for i, v in enumerate(rules):
            for vote in (1, -1):
                cast = sum(x for x, row in zip(p, rows) if row[i] == vote), sum(1 - x for x, row in zip(p, rows) if row[i] == vote)
                pair = [max(quality.LEAST, (cast[k] + 10 * quality.START[vote][k]) / (n[k] + 10)) for k in (0, 1)]
                if (pair[0] < pair[1]) if vote == 1 else (pair[0] > pair[1]):
                    pair = [sum(pair) / 2] * 2
                rates[v, vote] = pair
        share = (n[0] + 8.5) / (len(rows) + 10)
    for r, row in zip(got, rows):
        assert abs(r.quality - good(row)) < 1e-6 and r.kept == (not r.base_failed and r.quality >= 0.5)


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    rows = quality.assess(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.good], [r.kept for r in rows if not r.good]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1
