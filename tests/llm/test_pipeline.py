import collections

import corpus_pipeline
from helpers import ALNUM_WORD, prose, words

import __spark_entry__ as entry
from quillmark.llm import quality


def test_pipeline_takes_effect(spark, tmp_path):
    def text(seed, n=90):
        w = prose(seed, n, 3000).split()
        return " ".join(x.capitalize() + ("." if i % 9 == 8 else "") for i, x in enumerate(w)).replace("W", "Wo")

    passage, item = text(50, 60), text(60, 30)
    clean = {k: text(k, 120) for k in range(30)}
    rows = {**clean, 100: clean[3], 101: clean[4] + " extra", 102: "short", 103: "### " * 80, 104: f"{text(70)} {passage}", 105: f"{text(71)} {passage}", 106: f"{text(72)} {item}", 107: None}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*clean, 104, 105} and all(r.lossless for r in out.values())
    assert out[105].n_pieces < out[104].n_pieces  # the passage stays at its first place


def near_copies(rows):
    """One row of each component, by the least (doc_id, row)."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [r for i, r in enumerate(rows) if find(i) == i]


def unrepeated(rows):
    """What is left after words inside a 50-word window that stands at an earlier place go."""
    first, out = {}, []
    for i, (k, t) in enumerate(rows):
        w, gone = words(t, fold=False), set()
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), (i, p)) != (i, p):
                gone |= set(range(p, p + 50))
        if len(gone) < len(w) or not w:
            out.append((k, [x for p, x in enumerate(w) if p not in gone]))
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Rows that repeat an id or have none, equal rows and clashing columns; the rules' verdict is taken from ``assess``."""
    def text(seed, n=100):
        w = prose(seed, n, 3000).translate(str.maketrans("0123456789", "eatoinshrd")).split()
        return " ".join(x + ("." if i % 9 == 8 else "") for i, x in enumerate(w))

    passage, item = text(50, 60), text(60, 30)
    rows = [(i, text(i)) for i in range(12)]
    rows += [(3, text(3)), (3, text(3)), (3, text(20)), (None, text(5)), (None, text(21)), (None, text(21)), (None, f"{text(22)} {passage}"), (4, f"{text(23)} {passage}")]
    rows += [(None, f"{text(24)} {item}"), (6, f"{text(25)} {item}"), (6, text(26)), (40, text(7) + " few more"), (41, None), (42, ""), (None, None), (43, "### " * 90), (44, text(27) + " " + text(27))]
    docs = spark.createDataFrame([(k, t, i, "x", "y") for i, (k, t) in enumerate(rows)], "doc_id long, text string, n_chars long, _row string, spans string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    verdict = collections.Counter((r.doc_id, r.n_words, r.word_chars) for r in quality.assess(docs).where("kept").collect())
    left = [r for r in rows if verdict[r[0], len(words(r[1])), sum(map(len, words(r[1])))]]
    assert len(left) > 20 and rows[-2] not in left
    left.sort(key=lambda r: (r[0] is None, r[0] or 0))
    left = unrepeated(near_copies(left))
    window = words(item, ALNUM_WORD)
    grams = {tuple(window[i : i + 10]) for i in range(len(window) - 9)}
    plain = [(k, words(" ".join(w), ALNUM_WORD), w) for k, w in left]
    want = sorted((k is None, k or 0, len(w)) for k, a, w in plain if not any(tuple(a[i : i + 10]) in grams for i in range(len(a) - 9)))
    stages = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, str(tmp_path))
        assert stages.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, len(words(r.text))) for r in stages.collect()) == want
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [x[:2] for x in want] and all(r.lossless for r in out)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_all_queries_are_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
