import json
import zlib

from pyspark.sql import functions as F

from quillmark import queries as Q
from quillmark.model import ExtractOptions
from quillmark.operators import layout as L
from quillmark.sources import cache, pdf, reports
from quillmark.streaming import ingest

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
RECTS = f"array<struct<page:int,bbox:{BOX}>>"


def make_pdf(pages):
    """A small PDF; each page is a list of (font, size, x, y, text)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /BaseFont /Times-Roman >>", 4: b"<< /Type /Font /BaseFont /Times-Bold >>"}
    kids = []
    for i, shows in enumerate(pages):
        n = 10 + 2 * i
        kids.append(n)
        body = b"".join(b"BT /%s %g Tf %g %g Td (%s) Tj ET\n" % (f.encode(), s, x, y, t.replace("(", "\\(").replace(")", "\\)").encode("cp1252")) for f, s, x, y, t in shows)
        body += b"q 0 1 -1 0 20 300 cm BT /F1 9 Tf (rotated) Tj ET Q"
        packed = zlib.compress(body)
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = b"<< /Length %d /Filter /FlateDecode >> stream\n%s\nendstream" % (len(packed), packed)
    objects[2] = b"<< /Type /Pages /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % k for k in kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (n, b) for n, b in sorted(objects.items())) + b"trailer << /Root 1 0 R >>"


PAGES = [
    [("F2", 16, 54, 700, "A Paper With Five Words"), ("F2", 11, 54, 660, "Abstract"), ("F1", 9, 54, 640, "We read low-"), ("F1", 9, 54, 629, "level files (all). It works."), ("F1", 8, 300, 15, "1")],
    [("F1", 9, 54, 700, "More text is here."), ("F1", 8, 300, 15, "2")],
]


def test_pdf_to_paragraphs(spark):
    files = spark.createDataFrame([(1, bytearray(make_pdf(PAGES))), (2, bytearray(b"not a pdf")), (3, None)], "doc_id long, content binary")
    blocks = pdf.read_blocks(files)
    pages = spark.createDataFrame([(1, 2)], "doc_id long, n_pages int")
    units = L.classify(blocks, None, pages)
    paras = [(p.kind, p.text, p.page) for p in L.paragraphs(units).orderBy("id").collect()]
    assert paras == [("heading", "A Paper With Five Words", 0), ("heading", "Abstract", 0), ("abstract", "We read lowlevel files (all). It works.", 0), ("body", "More text is here.", 1)]
    assert L.titles(units).first().title == "A Paper With Five Words"


def test_fonts_with_a_character_map():
    program = b"beginbfchar <0003> <0020> <0010> <00660069> endbfchar 1 beginbfrange <0024> <0026> <0041> <0030> <0031> [<0078> <D83DDE00>] endbfrange"
    content = b"BT /F1 10 Tf 50 700 Td <00240025000300260010003000310099> Tj ET BT /F2 10 Tf 50 600 Td (\001\002b) Tj ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 612 792] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 8 0 R >> >> >>", 4: b"<< >> stream\n%s\nendstream" % content,
        5: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>", 6: b"<< /Type /Font /BaseFont /X-Bold /DW 500 /W [3 [250] 36 38 600] >>",
        7: b"<< >> stream\n%s\nendstream" % program, 8: b"<< /Type /Font /FirstChar 1 /Widths [400 400] /ToUnicode 9 0 R >>", 9: b"<< >> stream\nbeginbfchar <01> <0416> <02> <6F22> endbfchar\nendstream",
    }
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % x for x in objects.items())
    lines = [ln for _, _, _, _, made in pdf.page_blocks(data) for ln in made]
    assert [ln["text"] for ln in lines] == ["AB Cfix\U0001f600", "\u0416\u6f22b"]
    assert lines[0]["bold_chars"] == len(lines[0]["text"]) and abs(lines[0]["bbox"]["x1"] - 50 - (3 * 6 + 2.5 + 4 * 5)) < 1e-6
    assert list(pdf.page_sizes(data)) == [(0, 612.0, 792.0)]


def test_png_can_be_read_back():
    rows = bytes(range(24))
    made = pdf.png(2, 4, 3, rows)
    at = made.index(b"IDAT")
    lines = zlib.decompress(made[at + 4 : at + 4 + int.from_bytes(made[at - 4 : at], "big")])
    assert lines[:4] == bytes([0, 2, 1, 0]) and len(lines) == 26 and made.startswith(b"\x89PNG")


def test_cache_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / f"in/{i}.pdf").write_bytes(make_pdf(PAGES[i:]))
    options, root = ExtractOptions(), str(tmp_path / "cache")
    files = cache.files(spark, str(tmp_path / "in"), options)
    assert cache.load(spark, root, "blocks", files) is None and cache.missing(files, root, "blocks").count() == 2
    keyed = pdf.read_blocks(files.withColumn("doc_id", F.crc32("content"))).join(files.select(F.crc32("content").alias("doc_id"), "cache_key"), "doc_id")
    for _ in range(2):  # a second write replaces the first
        cache.store(keyed, root, "blocks")
    assert cache.missing(files, root, "blocks").count() == 0 and cache.load(spark, root, "blocks", files).count() == keyed.count()
    other = cache.files(spark, str(tmp_path / "in"), ExtractOptions(include_references=True))
    assert cache.missing(other, root, "blocks").count() == 2
    key = files.first().cache_key
    assert key == f"{files.first().sha256[:16]}-v2-{options.digest()}"
    cache.clear(spark, root)
    assert cache.load(spark, root, "blocks", files) is None


def test_reports(spark):
    rect = [(0, (1.0, 1.0, 50.0, 9.0)), (0, (1.0, 1.0, 1.5, 9.0))]
    runs = spark.createDataFrame([(1, 2, 0, 0, 14, "near", 96.5, [(rect,)], [(rect,)], "the quick <fox>", "the slow <fox>")], f"a_doc long, b_doc long, run_id int, a0 int, a1 int, verdict string, score double, a_locs array<struct<rects:{RECTS}>>, b_locs array<struct<rects:{RECTS}>>, a_text string, b_text string")
    runs = runs.withColumn("a_locs", F.transform("a_locs", lambda x: x.withField("page", F.lit(0)))).withColumn("b_locs", F.transform("b_locs", lambda x: x.withField("page", F.lit(4))))
    sents = spark.createDataFrame([], f"a_doc long, b_doc long, verdict string, score double, a_text string, b_text string, a_page int, b_page int, a_rects {RECTS}, b_rects {RECTS}")
    figs = spark.createDataFrame([(1, 2, 0, 1, "same", 3, 0.9, 0, 6, (0.0, 0.0, 9.0, 9.0), (0.0, 0.0, 9.0, 9.0))], f"a_doc long, b_doc long, a_id int, b_id int, verdict string, phash_distance int, ncc double, a_page int, b_page int, a_bbox {BOX}, b_bbox {BOX}")
    cover = spark.createDataFrame([(1, 2, 100, 50, 0.14, 0.28, 14)], "a_doc long, b_doc long, tokens_a int, tokens_b int, coverage_a double, coverage_b double, longest_run int")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a_doc long, b_doc long")
    rows = {(r.a_doc, r.b_doc): r.asDict() for r in reports.summary(pairs, cover, runs, sents, figures=figs).collect()}
    assert rows[1, 2]["near_runs"] == 1 and rows[1, 2]["figures_same"] == 1 and rows[1, 3]["runs"] == 0 and "semantic_pairs" not in rows[1, 2]
    notes = sorted(r.note for r in reports.marks("a", runs, sents, None, figs).collect())
    assert notes == ["figure same: pHash 3, NCC 0.9; matches B p7", "near run #0: 14 words, score 96.5; matches B p5"]
    found = reports.result({"name": "a.pdf"}, {"name": "b.pdf"}, rows[1, 2], {"runs": runs, "sentence_pairs": sents}, None, figs, {"semantic": "no model"})
    assert json.loads(reports.to_json(found))["semantic"] is None
    assert reports.to_text(found).splitlines()[1:3] == ["  verbatim : 14.0% of A / 28.0% of B inside 1 runs (0 exact, 1 near; longest 14 words); 0 near-verbatim sentences", "  semantic : skipped (no model)"]
    page = reports.to_html(found, {("a", 0): b"png"})
    assert "<mark>quick</mark> &lt;fox&gt;" in page and "cG5n" in page


def test_stream_sees_every_pair_once(spark, tmp_path, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    for i in range(3):
        docs.where(F.col("doc_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ingest.watch(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out/pairs")).select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b"), "shared")
    prints = Q.V.usable(Q.V.fingerprints(Q.V.plain_streams(docs)))
    want = Q.V.shared_fingerprints(prints, prints, ordered=True).select("a_doc", "b_doc", "shared")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
