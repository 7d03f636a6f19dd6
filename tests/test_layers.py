import math

import numpy as np
from pyspark.sql import functions as F

from quillmark import queries as Q
from quillmark.functions import images as I
from quillmark.model import ExtractOptions, ImageParams
from quillmark.operators import figures as FG
from quillmark.operators import layout as L
from quillmark.operators import semantic as S

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def raw_block(page, number, lines, box=(50.0, 100.0, 250.0, 130.0), size=9.0, bold=False):
    made = [(t, (box[0], box[1] + 10 * i, box[2], box[1] + 10 * i + 10), [(size, len(t))], len(t) * bold, len(t)) for i, t in enumerate(lines)]
    return (1, page, number, 792.0, box, made)


def blocks(spark, rows):
    line = f"struct<text:string,bbox:{BOX},sizes:array<struct<size:double,n:int>>,bold_chars:int,chars:int>"
    return spark.createDataFrame(rows, f"doc_id long, page int, block_no int, page_height double, bbox {BOX}, lines array<{line}>")


def test_lines_are_joined(spark):
    rows = blocks(spark, [raw_block(0, 0, ["archi-", "tecture is", "", "Intel-", "Based"]), raw_block(0, 1, ["\x07"])])
    got = L.join_lines(rows).orderBy("block_no").collect()
    assert got[0].text == "architecture is Intel- Based" and got[1].text == ""
    assert [got[0].text[s.start : s.end] for s in got[0].spans] == ["archi", "tecture is", "Intel-", "Based"]


def test_paragraphs_sentences_and_rectangles(spark):
    rows = [
        raw_block(0, 0, ["A Title of Many Words"], size=16.0), raw_block(0, 1, ["Abstract"], bold=True), raw_block(0, 2, ["We did it. It works."]),
        raw_block(0, 3, ["The first half of"]), raw_block(1, 0, ["a sentence. Another one"]), raw_block(1, 1, ["References"], bold=True), raw_block(1, 2, ["[1] A paper."]),
    ]
    units = L.classify(blocks(spark, rows))
    paras = L.paragraphs(units).orderBy("id").collect()
    assert [(p.kind, p.text) for p in paras] == [("heading", "A Title of Many Words"), ("heading", "Abstract"), ("abstract", "We did it. It works."), ("body", "The first half of a sentence. Another one")]
    assert L.titles(units).first().title == "A Title of Many Words"
    assert [p.kind for p in L.paragraphs(units, ExtractOptions(include_references=True)).orderBy("id").collect()][-1] == "reference"
    sents = L.sentences(L.paragraphs(units)).orderBy("id").collect()
    by = {p.id: p for p in paras}
    assert [s.text for s in sents] == ["We did it.", "It works.", "The first half of a sentence.", "Another one"] and [s.id for s in sents] == [0, 1, 2, 3]
    assert all(by[s.para].text[s.span.start : s.span.end] == s.text for s in sents)
    assert [r.page for r in sents[2].rects] == [0, 1]


def test_scanned_pages(spark):
    page = spark.createDataFrame([(1, 0, 600.0, 800.0), (1, 1, 600.0, 800.0)], "doc_id long, page int, width double, height double")
    image = spark.createDataFrame([(1, 0, (0.0, 0.0, 600.0, 500.0)), (1, 1, (0.0, 0.0, 60.0, 50.0))], f"doc_id long, page int, bbox {BOX}")
    none = blocks(spark, []).where("false")
    pages = lambda ocr: sorted(r.page for r in L.scanned_pages(none, image, page, ExtractOptions(ocr=ocr)).collect())
    assert (pages("auto"), pages("on"), pages("off")) == ([0], [0, 1], [])


def test_nearest_in_blocks_matches_a_matrix(spark):
    r = np.random.default_rng(0)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (r.normal(size=(23, 5)), r.normal(size=(17, 5))))
    frame = lambda v: spark.createDataFrame([(1, 2, i, x.tolist()) for i, x in enumerate(v)], "a_doc long, b_doc long, id long, vec array<double>")
    sim = a @ b.T
    best = S.nearest(frame(a), frame(b), block=4).cache()
    got = {(x.left, x.id): x.other for x in best.collect()}
    assert got == {(True, i): int(j) for i, j in enumerate(sim.argmax(1))} | {(False, j): int(i) for j, i in enumerate(sim.argmax(0))}
    mutual = {(i, int(j)) for i, j in enumerate(sim.argmax(1)) if sim.argmax(0)[j] == i and sim[i, j] >= 0.5}
    assert {(x.a_id, x.b_id) for x in S.matches(best, 0.5).collect()} == mutual
    s = S.statistics(best, 0.5).first()
    assert s.histogram == np.histogram(np.clip(sim.max(1), 0, 1), 10, (0, 1))[0].tolist() and (s.n_a, s.n_b) == (23, 17)
    assert math.isclose(s.mean_max_sim, sim.max(1).mean(), abs_tol=1e-4) and math.isclose(s.fraction_matched_b, (sim.max(0) >= 0.5).mean(), abs_tol=1e-4)


def test_statistics_of_an_empty_side(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "a_doc long, b_doc long")
    rows = lambda ids: spark.createDataFrame([(a, b, i, [1.0, 0.0]) for a, b, i in ids], "a_doc long, b_doc long, id long, vec array<double>")
    a, b = rows([(1, 2, 0), (1, 2, 1), (1, 3, 0)]), rows([(1, 2, 7)])
    got = {(r.a_doc, r.b_doc): r for r in S.statistics(S.nearest(a, b), 0.5, pairs, a, b).collect()}
    assert (got[1, 2].n_a, got[1, 2].n_b, got[1, 2].mean_max_sim) == (2, 1, 1.0)
    assert (got[1, 3].n_a, got[1, 3].n_b, got[1, 3].mean_max_sim, got[1, 3].histogram) == (1, 0, 0.0, [0] * 10) and got[4, 5].n_a == 0


def test_units_that_runs_explain_are_left_out(spark):
    long = "one two three four five six seven eight nine ten"
    units = spark.createDataFrame([(1, 0, 0, "body", long, (0, 48)), (1, 1, 1, "body", long, (0, 48)), (1, 2, 2, "heading", long, (0, 48)), (1, 3, 3, "body", "few", (0, 3)), (1, 4, 4, "body", long, (0, 48))], "doc_id long, id int, para int, kind string, text string, span struct<start:int,end:int>")
    cut = spark.createDataFrame([(1, 1, 0, 20), (1, 1, 10, 20)], "doc_id long, para int, start int, end int")
    gone = spark.createDataFrame([(1, 4)], "doc_id long, id int")
    assert sorted(r.id for r in S.eligible(units, cut, gone, "sentence").collect()) == [0]
    vec = S.embed(units, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert all(math.isclose(sum(x * x for x in r.vec), 1) for r in vec.collect())


def drawing(seed, h=240, w=320):
    r = np.random.default_rng(seed)
    image = np.full((h, w), 255.0)
    for _ in range(14):
        y, x, a, b = r.integers(0, h - 30), r.integers(0, w - 30), *r.integers(12, 90, 2)
        image[y : y + a, x : x + b] = r.integers(0, 230)
    return image


def test_hashes_and_search():
    a, b = drawing(1), drawing(2)
    rough = I.resample(I.resample(a, 120, 160), 240, 320) + np.random.default_rng(0).normal(0, 3, a.shape)
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert bits(I.phash(a), I.phash(rough)) <= 6 and bits(I.phash(a), I.phash(b)) > 12
    assert bits(I.dhash(a), I.dhash(rough)) <= 16
    assert I.correlation(I.thumbnail(a), I.thumbnail(rough)) > 0.95
    small = lambda x: I.fit_within(x, I.CROP_SIDE)
    crop = a[:, 96:]
    assert I.crop_score(small(a), small(crop)) > 0.9 > 0.85 > I.crop_score(small(a), small(b))
    assert I.crop_score(np.ones((8, 8)), a) == -1.0 and I.best_place(a, np.ones((5, 5))) == -1.0


def test_template_search_matches_a_loop():
    r = np.random.default_rng(4)
    image, t = r.normal(size=(14, 17)), r.normal(size=(5, 6))
    best = -1.0
    for y in range(10):
        for x in range(12):
            p = image[y : y + 5, x : x + 6]
            best = max(best, np.corrcoef(p.reshape(-1), t.reshape(-1))[0, 1])
    assert math.isclose(I.best_place(image, t), best, abs_tol=1e-9)


def test_figures_end_to_end(spark):
    shapes = {(1, 0): drawing(1), (1, 1): np.full((200, 200), 255.0), (2, 0): drawing(1), (2, 1): I.resample(drawing(1), 180, 240), (2, 2): drawing(1)[:, 100:], (2, 3): drawing(9), (2, 4): np.full((200, 200), 255.0)}
    rows = []
    for (d, i), image in shapes.items():
        data = np.repeat(np.clip(image, 0, 255).astype(np.uint8)[..., None], 3, axis=2)
        rows.append((d, i, 0, (0.0, 0.0, 9.0, 9.0), "same" if i == 0 else f"{d}-{i}", "", *data.shape, bytearray(data.tobytes())))
    figs = spark.createDataFrame(rows, f"doc_id long, id int, page int, bbox {BOX}, sha256 string, caption string, height int, width int, channels int, data binary")
    hashed = FG.hash_figures(figs, ImageParams()).cache()
    assert {(r.doc_id, r.id) for r in hashed.where("blank").collect()} == {(1, 1), (2, 4)}
    pairs = spark.createDataFrame([(1, 2)], "a_doc long, b_doc long")
    got = {(r.a_id, r.b_id): r.verdict for r in FG.compare(hashed.where("doc_id = 1"), hashed.where("doc_id = 2"), pairs).collect()}
    assert got == {(0, 0): "exact", (0, 1): "same", (0, 2): "cropped"}


def test_every_oracle_has_a_query():
    assert set(Q.oracle_sql()) <= set(Q.queries()) and Q.FLAGSHIP in Q.oracle_sql()
    assert F is not None
