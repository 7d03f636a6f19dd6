import json
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_sources import make_pdf

from quillmark.__main__ import main
from quillmark.model import ExtractOptions, SemanticParams
from quillmark.plans.compare import compare, extract
from quillmark.sources import pdf

COPIED = ["The harbour keeps a list of tides and of wind warnings for all of the", "berths and lets small boats out only when the observed swell leaves", "room for them."]
OWN_A = ["Delay of remote ferries decides when our islanders eat today."]
OWN_B = ["When our islanders eat is mostly how late remote ferries are."]
OTHER = ["Nothing of this stands in the second of the two files."]


def paper(*paragraphs, image=None):
    shows, y = [("F2", 16, 54, 700, "A Paper With Enough Words")], 660
    for lines in paragraphs:
        for line in lines:
            shows.append(("F1", 9, 54, y, line))
            y -= 11
        y -= 30
    data = make_pdf([shows])
    if image is not None:
        h, w = image.shape[:2]
        packed = zlib.compress(image.tobytes())
        obj = b"90 0 obj << /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode >> stream\n%s\nendstream endobj\n" % (w, h, packed)
        draw = b"q 120 0 0 90 300 200 cm /Im1 Do Q"
        content = b"91 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(draw), draw)
        data = data.replace(b"/Contents 11 0 R", b"/Contents [11 0 R 91 0 R]").replace(b"/Resources << /Font", b"/Resources << /XObject << /Im1 90 0 R >> /Font").replace(b"trailer", obj + content + b"trailer")
    return data


def picture():
    r = np.random.default_rng(1)
    image = np.full((90, 120, 3), 255, np.uint8)
    for _ in range(8):
        y, x = r.integers(0, 60), r.integers(0, 90)
        image[y : y + 25, x : x + 25] = r.integers(0, 200, 3)
    return image


def test_three_layers(spark):
    def vectors():
        topics = {"remote": 0, "harbour": 1, "Nothing": 2}
        return lambda texts: np.array([[float(k in t) + 0.01 for k in topics] for t in texts])

    files = [(1, "/x/a.pdf", bytearray(paper(COPIED, OWN_A, OTHER, image=picture()))), (2, "/x/b.pdf", bytearray(paper(OWN_B, COPIED, image=picture())))]
    df = spark.createDataFrame(files, "doc_id long, path string, content binary")
    found = extract(df)
    assert sorted((r.name, r.n_pages, r.title) for r in found.docs.collect()) == [("a.pdf", 1, "A Paper With Enough Words"), ("b.pdf", 1, "A Paper With Enough Words")]
    pairs = spark.createDataFrame([(1, 2)], "a_doc long, b_doc long")
    got = compare(found, found, pairs, semantic=SemanticParams(min_paragraph_tokens=8), images=pdf_params(), model=vectors)
    run, = got.runs.collect()
    text = " ".join(COPIED)
    assert (run.verdict, run.a_text, run.a1 - run.a0) == ("exact", text.rstrip("."), len(text.split())) and len(run.a_locs[0].rects) == 3
    assert sorted((r.level, r.a_text, r.b_text) for r in got.semantic.collect()) == [(lv, OWN_A[0], OWN_B[0]) for lv in ("paragraph", "sentence")]
    assert {r.level: (r.n_a, r.n_b) for r in got.semantic_statistics.collect()} == {"sentence": (2, 1), "paragraph": (2, 1)}
    assert [(r.verdict, r.ncc) for r in got.figures.collect()] == [("exact", 1.0)]
    skipped = compare(found, found, pairs, semantic=SemanticParams())
    assert skipped.semantic is None and "not available" in skipped.notes["semantic"] and skipped.notes["images"] == "disabled"


def pdf_params():
    from quillmark.model import ImageParams

    return ImageParams()


def test_images_keep_their_colours(spark):
    (page, box, _, width, height, channels, data), = pdf.page_images(paper(COPIED, image=picture()))
    assert (page, box, width, height, channels) == (0, {"x0": 300.0, "y0": 502.0, "x1": 420.0, "y1": 592.0}, 120, 90, 3)
    assert (np.frombuffer(data, np.uint8).reshape(90, 120, 3)[..., ::-1] == picture()).all()


def test_figures_without_pixels_can_be_exact_copies(spark):
    jpeg = lambda data: data.replace(b"/Filter /FlateDecode >> stream\n" + zlib.compress(picture().tobytes()), b"/Filter /DCTDecode >> stream\nsame bytes")
    files = [(1, "a.pdf", bytearray(jpeg(paper(COPIED, image=picture())))), (2, "b.pdf", bytearray(jpeg(paper(OWN_B, image=picture())))), (3, "c.pdf", bytearray(paper(OWN_A, image=picture())))]
    found = extract(spark.createDataFrame(files, "doc_id long, path string, content binary"))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a_doc long, b_doc long")
    got = compare(found, found, pairs, images=pdf_params()).figures.collect()
    assert [(r.a_doc, r.b_doc, r.verdict) for r in got] == [(1, 2, "exact")]


def test_scanned_pages_go_to_the_recogniser(spark):
    asked = []

    def read(data, page, dpi):
        words = ["Scanned", "words", "that", "stand", "on", f"page{page}"]
        return ["level"] + [f"5\t1\t1\t1\t1\t{i}\t{300 + 90 * i}\t300\t80\t40\t90\t{w}" for i, w in enumerate(words)]

    files = spark.createDataFrame([(1, "a.pdf", bytearray(make_pdf([[("F1", 9, 54, 700, "A first page with text.")], []])))], "doc_id long, path string, content binary")
    found = extract(files, ExtractOptions(ocr="on"), read)
    assert sorted(r.text for r in found.paragraphs.collect()) == ["Scanned words that stand on page0", "Scanned words that stand on page1"]
    doc = found.docs.first()
    assert (doc.n_pages, doc.ocr_pages) == (2, [1, 2]) and not asked
    assert [r.text for r in extract(files, ExtractOptions(ocr="off"), read).paragraphs.collect()] == ["A first page with text."]


def test_command_line(spark, tmp_path, capsys):
    a, b = tmp_path / "a.pdf", tmp_path / "b.pdf"
    a.write_bytes(paper(COPIED, OWN_A))
    b.write_bytes(paper(OWN_B, COPIED))
    assert main([str(a), str(tmp_path / "none.pdf")]) == 2
    assert main([str(a), str(b), "--out", str(tmp_path / "out")]) == 0
    told = json.loads((tmp_path / "out/result.json").read_text())
    assert told["summary"]["exact_runs"] == 1 and told["semantic"] is None and told["images"] == []
    shown = capsys.readouterr().out
    assert "1 exact" in shown and "(0 vs 0 figures)" in shown and "report.html" in shown
    assert told["params"]["verbatim"]["min_run"] == 12 and told["a"]["n_pages"] == 1 and told["a"]["n_sentences"] > 0
    again = ["--cache-dir", str(tmp_path / "cache"), "--json-only", "--quiet", "--min-run", "9", "--no-semantic", "--out", str(tmp_path / "again")]
    for _ in range(2):  # the second time from the cache
        assert main([str(a), str(b), *again]) == 0
    kept = json.loads((tmp_path / "again/result.json").read_text())
    assert kept["verbatim"] == told["verbatim"] and kept["a"] == told["a"] and kept["semantic_note"] == "disabled" and len(list((tmp_path / "again").iterdir())) == 1
    assert len(list((tmp_path / "cache/docs").glob("cache_key=*"))) == 2
    assert capsys.readouterr().out == "" and (tmp_path / "out/report.html").read_text().startswith("<!DOCTYPE html>")
    marked = (tmp_path / "out/a_a.annotated.pdf").read_bytes()
    assert marked.count(b"/Highlight") == 3 and [x[4][0]["text"] for x in pdf.page_blocks(marked)] == [x[4][0]["text"] for x in pdf.page_blocks(a.read_bytes())]
    assert F is not None
