import collections
import random

import numpy as np
from helpers import ALNUM_WORD, ODD, empty, prose, table, words
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, near_dup, suffix_dedup
from quillmark.plans.components import components


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def near_truth(rows):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)  # many blocks
    base = [prose(s, 120) for s in range(3)]
    texts = [*ODD, *base] + [edited(base[0], s, 0.005 * (s % 10)) for s in range(40)] + [base[1]] * 5 + [edited(base[2], s, 0.03) for s in range(20)]
    random.Random(5).shuffle(texts)
    docs = table(spark, texts)
    got = near_dup.near_duplicates(docs).collect()
    truth = near_truth(enumerate(texts))
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == truth
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {k for k, v in truth.items() if v[2]}


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    assert near_dup.keep_one(empty(spark)).count() == 0
    a, b, other = prose(1, 90), prose(1, 88), prose(2, 90)
    rows = [(4, a), (4, a), (4, other), (3, b), (None, a), (None, prose(3, 60)), (None, prose(3, 60)), (None, None), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _row int")
    got = sorted((r.component_id or -1, r.kept, r.n_shingles) for r in near_dup.near_duplicates(docs).collect())
    one, two, three = (len({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}) for t in (a, b, other))
    null = len({tuple(prose(3, 60).split()[i : i + 5]) for i in range(56)})
    assert got == sorted([(3, False, one)] * 3 + [(3, True, two), (4, True, three), (-1, True, null), (-1, False, null)] + [(-1, True, 0)] * 2 + [(9, True, 0)] * 2)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert collections.Counter(left) == collections.Counter([(3, b), (4, other), (None, prose(3, 60)), (None, None), (None, None), (9, ""), (9, "")])


def test_texts_with_a_common_frame_are_not_compared(spark, monkeypatch):
    frame = prose(1, 300, 5000).split()
    r = random.Random(3)
    texts = []
    for d in range(120):  # similarity 0.5 to 0.7 by pairs: they share buckets and no link
        own = [f"own{d}x{i}" for i in range(r.randrange(60, 90))]  # a fifth of the text
        texts.append(" ".join(frame[:150] + own + frame[150:]))
    texts += [texts[5] + " more words at the end", texts[5].replace("own5x7", "changed")]
    docs = table(spark, texts)
    seen = []
    open_ = near_dup._open
    monkeypatch.setattr(near_dup, "_open", lambda *a: seen.append(open_(*a).count()) or open_(*a))
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs).collect() if x.doc_id is not None}
    assert got == {k: v[1] for k, v in near_truth(enumerate(texts)).items()}
    assert seen[0] < 10


def test_words_in_patterns_are_told_apart(spark):
    x, y = ["a"], ["b"]
    for _ in range(9):
        x, y = x + y, y + x
    texts = [" ".join(x), " ".join(y), " ".join(x + y), " ".join(["a", "b"] * 256)]
    docs = table(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == near_truth(enumerate(texts))
    spans = collections.defaultdict(list)
    for r in suffix_dedup.repeated_spans(docs).collect():
        spans[r.doc_id].append((r.start, r.stop))
    assert {k: sorted(v) for k, v in spans.items()} == span_truth(enumerate(texts))


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 2**63, 100).astype(np.uint64)])
    one = a[:1]
    s = near_dup.fast_sketch([a, b, one, a[:0]], 256)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (s[:3] != full).all() and (s[3] == full).all()
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.12


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 9)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 20 for i in range(20, 61)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def span_truth(rows):
    first, out = {}, {}
    for k, t in rows:
        w, found = words(t, fold=False), []
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            if first.setdefault(key, (k, i)) != (k, i):
                if found and found[-1][1] >= i:
                    found[-1][1] = i + 50
                else:
                    found.append([i, i + 50])
        out[k] = [tuple(x) for x in found]
    return {k: v for k, v in out.items() if v}


def test_repeated_spans_match_brute_force(spark):
    passage, longer = prose(1, 55), prose(2, 140)
    texts = [*ODD, f"{prose(3, 30)} {passage} {prose(4, 20)}", f"{passage} {prose(5, 60)}", longer, longer, f"{prose(6, 9)}\n{longer}"]
    texts += [f"{prose(7, 40)} {' '.join(longer.split()[20:75])} {prose(8, 40)}", "w " * 200, "w " * 130, f"{passage} {prose(9, 5)} {passage}", " ".join(passage.split()[:49])]
    docs = table(spark, texts)
    got = collections.defaultdict(list)
    for r in suffix_dedup.repeated_spans(docs).collect():
        assert r.n_words == r.stop - r.start
        got[r.doc_id].append((r.start, r.stop))
        window = " ".join(words(texts[r.doc_id], fold=False)[r.start : r.start + 50])
        assert r.first_doc_id <= r.doc_id and window in " ".join(words(texts[r.first_doc_id], fold=False))
    assert {k: sorted(v) for k, v in got.items()} == span_truth(enumerate(texts))
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns
    rows = {r.doc_id: r for r in cut.collect()}
    assert span_truth((k, rows[k].text) for k in sorted(k for k in rows if k is not None)) == {}
    assert all(rows[k].text == t for k, t in enumerate(texts) if k not in got)
    assert 15 not in rows and rows[13].n_chars == len(rows[13].text)


def cut_truth(rows):
    """What is left of (doc_id, text) rows in place order."""
    spans, out = span_truth(enumerate(t for _, t in rows)), []
    for i, (k, t) in enumerate(rows):
        if i not in spans:
            out.append((k, t))
            continue
        w, inside = words(t, fold=False), {j for a, b in spans[i] for j in range(a, b)}
        if len(inside) < len(w):
            out.append((k, [x for j, x in enumerate(w) if j not in inside]))
    return out


def test_repeated_spans_of_nothing_and_of_repeated_rows(spark):
    assert suffix_dedup.repeated_spans(empty(spark)).count() == 0 and suffix_dedup.cut_repeats(empty(spark)).count() == 0
    p, q, z = prose(1, 60, 3000), prose(2, 100, 3000), prose(3, 100, 3000)
    # rows that share an id, equal rows, rows without an id: each keeps what stands at no earlier place
    rows = [(1, f"{p} x1 x2"), (2, f"{p} y1 y2"), (2, z), (3, q), (3, q), (None, f"n {q} m"), (None, prose(4, 70, 3000)), (None, None), (5, "")]
    docs = spark.createDataFrame([(k, t, i, 0) for i, (k, t) in enumerate(rows)], "doc_id long, text string, _spans int, _row int")
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns
    plain = lambda found: sorted(((k is None, k or 0), t if isinstance(t, list) else (words(t, fold=False) if t else [str(t)])) for k, t in found)
    assert plain((r.doc_id, r.text) for r in cut.collect()) == plain(cut_truth(rows))
    found = [(r.doc_id, r.first_doc_id, r.n_words) for r in suffix_dedup.repeated_spans(docs).collect()]
    assert sorted(found, key=str) == sorted([(2, 1, 60), (3, 3, 100), (None, 3, 100)], key=str)


def test_sort_ranges_do_not_show(spark):
    passage = prose(1, 80, 3000)
    texts = [f"{prose(100 + i, 30 + i % 7, 3000)} {passage} {prose(200 + i, 20, 3000)}" for i in range(60)] + [passage] * 60
    random.Random(1).shuffle(texts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = collections.defaultdict(list)
        for r in suffix_dedup.repeated_spans(table(spark, texts)).collect():
            got[r.doc_id].append((r.start, r.stop))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {k: sorted(v) for k, v in got.items()} == span_truth(enumerate(texts))


def test_contamination_matches_brute_force(spark):
    items = [(1, prose(1, 30)), (2, prose(2, 10)), (3, "Short One"), (4, "!!"), (5, None), (5, prose(3, 12)), (None, prose(4, 12)), (6, prose(1, 30))]
    texts = [*ODD, prose(1, 30).upper(), f"x {prose(2, 10)} y", " ".join(prose(1, 30).split()[3:14]), "a short-one here", prose(3, 12) + " " + prose(3, 12), prose(4, 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words(t, ALNUM_WORD)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m and k else 0):
            windows[tuple(w[i : i + m])].add(str(k))
    docs = table(spark, texts)
    for block in (1 << 20, 60):
        found = {r.doc_id: r for r in decontaminate.contamination(docs, bench, block).collect()}
        for k, t in enumerate(texts):
            w, hit, which = words(t, ALNUM_WORD), set(), set()
            for i in range(len(w)):
                for m in {len(x) for x in windows}:
                    if tuple(w[i : i + m]) in windows and i + m <= len(w):
                        hit |= set(range(i, i + m))
                        which |= windows[tuple(w[i : i + m])]
            r = found[k]
            assert {i for s in r.spans for i in range(s.start, s.stop)} == hit and r["items"] == sorted(which) and r.n_words == len(w)
        clean = decontaminate.drop_contaminated(docs, bench, block)
        assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k in found if not found[k].spans}
    assert decontaminate.contamination(docs, bench.where("false")).where("size(spans) > 0").count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_contaminated_row_without_an_id_is_dropped(spark):
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    rows = [(None, f"x {prose(1, 30)} y"), (None, prose(7, 30)), (None, None), (4, prose(1, 30)), (4, prose(8, 30)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1 << 20, 10):
        assert {tuple(r) for r in decontaminate.drop_contaminated(docs, bench, block).collect()} == {rows[1], rows[2], rows[4], rows[5]}
    docs = docs.withColumns({"_row": F.lit(1), "row": F.lit(2), "key": F.lit("k")})
    for block in (1 << 20, 10):
        assert decontaminate.drop_contaminated(docs, bench, block).columns == docs.columns
        assert decontaminate.drop_contaminated(docs.where("false"), bench, block).count() == 0
