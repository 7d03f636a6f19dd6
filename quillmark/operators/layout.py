"""Page layout to paragraphs, sentences, titles and captioned figures, from a table of text blocks.

Rules that look at a whole document, the body font size and running headers, are aggregates joined
back to blocks; rules that look at the order of blocks are windows over ``(page, block_no)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import LINE, ExtractOptions
from .verbatim import clip_lines

#: What the start of a block says of its kind.
CAPTION = r"(?i)^(fig\.?|figure|table|tab\.?|listing|algorithm)\s*\d+"
REFERENCES = r"(?i)^(\d+\.?\s*|[ivx]+\.\s*)?(references|bibliography)\s*$"
NUMBERED = r"^(\d+(\.\d+)*\.?|[IVX]+\.?|[A-Z]\.)\s+[A-Z]"
ABSTRACT = r"(?i)^abstract\s*$"
ABSTRACT_INLINE = r"(?i)^abstract\b"
PAGE_NUMBER = r"(?i)^\s*(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?\s*$"
REAL_WORD = r"[\p{L}\p{Nl}\p{No}]{2,}"
#: Limits of the rules.
MARGIN, LABEL_TOKENS, HEADING_TOKENS, HEADING_SCALE = 0.08, 8, 15, 1.15

ORDER = ["page", "block_no"]


def body_font_size(blocks: DataFrame) -> DataFrame:
    """``doc_id, body_size``: the size with the most characters, the first seen on ties; 10 if there is none."""
    sizes = blocks.select("doc_id", *ORDER, F.posexplode("lines").alias("line_no", "ln")).select("doc_id", *ORDER, "line_no", F.posexplode("ln.sizes").alias("at", "s"))
    first = F.min(F.struct(*ORDER, "line_no", "at")).alias("first")
    total = sizes.groupBy("doc_id", F.col("s.size").alias("size")).agg(F.sum("s.n").alias("n"), first)
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))).where("rank = 1")
    return blocks.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("size", F.lit(10.0)).alias("body_size"))


def _sum(items: Column, value) -> Column:
    return F.aggregate(F.transform(items, value), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def block_stats(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``mean_size`` by characters, ``bold`` share and ``n_chars``; 0 where there is nothing."""
    sizes = F.flatten(F.transform("lines", lambda ln: ln.sizes))
    n, chars = _sum(sizes, lambda s: s.n), _sum(F.col("lines"), lambda ln: ln.chars)
    return blocks.withColumns({
        "mean_size": F.when(n > 0, _sum(sizes, lambda s: s.size * s.n) / n).otherwise(0.0),
        "bold": F.when(chars > 0, _sum(F.col("lines"), lambda ln: ln.bold_chars) / chars).otherwise(0.0),
        "n_chars": F.aggregate("lines", F.lit(0), lambda a, ln: a + F.length(ln.text)),
    })


def in_margin() -> Column:
    return (F.col("bbox.y1") < MARGIN * F.col("page_height")) | (F.col("bbox.y0") > (1 - MARGIN) * F.col("page_height"))


def _raw_text() -> Column:
    return F.array_join(F.transform("lines", lambda ln: ln.text), " ")


def running_headers(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, key``: margin texts, numbers apart, on three pages (two of a two-page document)."""
    keys = blocks.where(in_margin()).select("doc_id", "page", T.margin_key(_raw_text()).alias("key"))
    seen = keys.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("on")).join(pages.select("doc_id", "n_pages"), "doc_id")
    return seen.where((F.col("n_pages") >= 2) & (F.col("on") >= F.when(F.col("n_pages") >= 3, 3).otherwise(2))).select("doc_id", "key")


def without_margin_noise(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks but page numbers and running headers in the margins."""
    rows = blocks.withColumn("_margin", in_margin()).withColumn("_key", T.margin_key(_raw_text()))
    rows = rows.where(~(F.col("_margin") & T.normalize(_raw_text()).rlike(PAGE_NUMBER)))
    noise = running_headers(blocks, pages).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_noise"))
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("_key") == F.col("_noise")) & F.col("_margin")
    return rows.join(noise, same, "left_anti").drop("_margin", "_key")


def join_lines(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``text`` and ``spans``: lines joined, words broken over lines made whole.

    ``spans`` has the characters of each line that has any.
    """
    rows = blocks.withColumn("_texts", T.normalize_lines(F.transform("lines", lambda ln: ln.text)))
    pieces = F.filter(F.transform("lines", lambda ln, i: F.struct(F.get("_texts", i).alias("piece"), ln.bbox.alias("bbox"))), lambda p: p.piece != "")
    start = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{LINE}>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        broken = F.endswith(acc.text, F.lit("-")) & p.piece.rlike(r"^\p{Ll}")
        n = F.length(acc.text)
        begin = F.when(n == 0, 0).when(broken, n - 1).otherwise(n + 1)
        text = F.concat(F.when(n == 0, F.lit("")).when(broken, F.substring(acc.text, F.lit(1), n - 1)).otherwise(F.concat(acc.text, F.lit(" "))), p.piece)
        last = F.element_at(acc.spans, -1)
        shorter = F.struct(last.start.alias("start"), (last.end - 1).alias("end"), last.page.alias("page"), last.bbox.alias("bbox"))
        kept = F.when(broken & (n > 0), F.array_append(F.slice(acc.spans, 1, F.size(acc.spans) - 1), shorter)).otherwise(acc.spans)
        line = F.struct(begin.cast("int").alias("start"), F.length(text).alias("end"), F.col("page").cast("int").alias("page"), p.bbox.alias("bbox"))
        return F.struct(text.alias("text"), F.array_append(kept, line).alias("spans"))

    return rows.withColumn("_joined", F.aggregate(pieces, start, add)).withColumns({"text": F.col("_joined.text"), "spans": F.col("_joined.spans")}).drop("_texts", "_joined")


def overlap_share(a: Column, b: Column) -> Column:
    """Share of rectangle a inside b."""
    x = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    y = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return x * y / F.greatest((a.x1 - a.x0) * (a.y1 - a.y0), F.lit(1e-6))


def without_labels(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """Blocks but short texts that lie within a vector figure of their page."""
    vector = figures.where("kind = 'vector'").select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.col("bbox").alias("_box"))
    inside = (F.col("doc_id") == F.col("_doc")) & (F.col("page") == F.col("_page")) & (F.col("ntok") <= LABEL_TOKENS) & (overlap_share(F.col("bbox"), F.col("_box")) > 0.8)
    return blocks.join(vector, inside, "left_anti")


def figure_allowed(bbox: Column, page_width: Column, page_height: Column, options: ExtractOptions = ExtractOptions()) -> Column:
    """Whether a figure is neither too small nor nearly the page."""
    w, h = bbox.x1 - bbox.x0, bbox.y1 - bbox.y0
    return (w >= options.min_figure_pt) & (h >= options.min_figure_pt) & (w * h <= options.max_page_fraction * page_width * page_height)


def without_frames(figures: DataFrame) -> DataFrame:
    """Figures but vector ones that frame a raster figure or lie in it."""
    raster = figures.where("kind = 'raster'").select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.col("bbox").alias("_box"))
    over = (overlap_share(F.col("bbox"), F.col("_box")) > 0.8) | (overlap_share(F.col("_box"), F.col("bbox")) > 0.8)
    frame = (F.col("kind") == "vector") & (F.col("doc_id") == F.col("_doc")) & (F.col("page") == F.col("_page")) & over
    return figures.join(raster, frame, "left_anti")


def scanned_pages(blocks: DataFrame, images: DataFrame, pages: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """``doc_id, page``: pages with little text under an image of half the page; all or none by option.

    ``pages`` has ``doc_id, page, width, height``; ``images`` has ``doc_id, page, bbox``.
    """
    if options.ocr != "auto":
        return pages.select("doc_id", "page").where(F.lit(options.ocr == "on"))
    chars = block_stats(blocks).groupBy("doc_id", "page").agg(F.sum("n_chars").alias("chars"))
    area = (F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0"))
    full = images.join(pages, ["doc_id", "page"]).where(area >= 0.5 * F.col("width") * F.col("height")).select("doc_id", "page").distinct()
    return pages.join(full, ["doc_id", "page"], "left_semi").join(chars, ["doc_id", "page"], "left").where(F.coalesce("chars", F.lit(0)) < options.ocr_min_chars).select("doc_id", "page")


def classify(blocks: DataFrame, figures: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Text blocks in order with ``text, spans, ntok, size, is_heading, kind``; headings of references are dropped.

    Kinds are heading, caption, abstract, reference and body.  Without ``pages`` nothing is taken for
    margin noise, without ``figures`` nothing for a label.
    """
    rows = without_margin_noise(blocks, pages) if pages is not None else blocks
    rows = join_lines(rows).where((F.col("text") != "") & F.col("text").rlike(REAL_WORD)).withColumn("ntok", F.size(T.tokenize(F.col("text"))))
    if figures is not None:
        rows = without_labels(rows, figures)
    rows = block_stats(rows).join(body_font_size(blocks), "doc_id")
    heading = (F.col("ntok") <= HEADING_TOKENS) & ((F.col("mean_size") >= F.col("body_size") * HEADING_SCALE) | (F.col("bold") > 0.8) | F.col("text").rlike(NUMBERED))
    rows = rows.withColumn("is_heading", heading).withColumn("_caption", F.col("text").rlike(CAPTION)).withColumn("_head", F.col("is_heading") & ~F.col("_caption"))
    order = Window.partitionBy("doc_id").orderBy(*ORDER)
    rows = rows.withColumn("_refs", F.last(F.when(F.col("_head"), F.col("text").rlike(REFERENCES)), ignorenulls=True).over(order))
    rows = rows.withColumn("_abstract", F.last(F.when(F.col("_head"), F.col("text").rlike(ABSTRACT)), ignorenulls=True).over(order))
    rows = rows.withColumn("_section", F.sum(F.col("_head").cast("int")).over(order))
    plain = ~F.col("_head") & ~F.col("_caption")
    nth = F.sum(plain.cast("int")).over(Window.partitionBy("doc_id", "_section").orderBy(*ORDER))
    kind = (
        F.when(F.col("_caption"), "caption")
        .when(F.col("_head"), "heading")
        .when(F.coalesce("_refs", F.lit(False)), "reference")
        .when((F.coalesce("_abstract", F.lit(False)) & (nth == 1)) | (F.col("text").rlike(ABSTRACT_INLINE) & (F.col("ntok") >= 20)), "abstract")
        .otherwise("body")
    )
    rows = rows.withColumn("kind", kind).where(~(F.col("_head") & F.col("text").rlike(REFERENCES)))
    return rows.select("doc_id", *ORDER, "bbox", "text", "spans", "ntok", F.col("mean_size").alias("size"), "is_heading", "kind")


def titles(units: DataFrame) -> DataFrame:
    """``doc_id, title``: the largest heading of three tokens or more on the first page, first on ties."""
    heads = units.where("page = 0 and is_heading and ntok >= 3")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), "block_no"))
    best = heads.withColumn("rank", rank).where("rank = 1").select("doc_id", F.col("text").alias("title"))
    return units.select("doc_id").distinct().join(best, "doc_id", "left").fillna("", ["title"])


def paragraphs(units: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """Paragraphs of classified blocks: body text that a column or page break cut is joined again."""
    rows = units if options.include_references else units.where("kind <> 'reference'")
    order = Window.partitionBy("doc_id").orderBy(*ORDER)
    goes_on = (F.col("kind") == "body") & (F.lag("kind").over(order) == "body") & ~F.lag("text").over(order).rlike(r"[.!?:]$") & F.col("text").rlike(r"^\p{Ll}")
    rows = rows.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    rows = rows.withColumn("id", F.sum("_new").over(order) - 1)
    inside = Window.partitionBy("doc_id", "id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("text") + 1).over(inside), F.lit(0)).cast("int"))
    moved = F.transform("spans", lambda s: F.struct((s.start + F.col("_at")).alias("start"), (s.end + F.col("_at")).alias("end"), s.page.alias("page"), s.bbox.alias("bbox")))
    every = F.array_sort(F.collect_list(F.struct(*ORDER, "kind", "text", moved.alias("lines")))).alias("u")
    grouped = rows.groupBy("doc_id", F.col("id").cast("int").alias("id")).agg(every)
    text = F.array_join(F.transform("u", lambda x: x.text), " ")
    lines = F.flatten(F.transform("u", lambda x: x.lines))
    out = grouped.select("doc_id", "id", F.get("u", F.lit(0)).kind.alias("kind"), text.alias("text"), F.get("u", F.lit(0)).page.alias("page"), lines.alias("lines"))
    rects = F.transform("lines", lambda ln: F.struct(ln.page.alias("page"), ln.bbox.alias("bbox")))
    return out.withColumns({"n_tokens": F.size(T.tokenize(F.col("text"))), "rects": rects})


def sentences(paras: DataFrame) -> DataFrame:
    """Sentences of all paragraphs but headings, numbered through the document, with their rectangles."""
    found = paras.where("kind <> 'heading'").select("doc_id", F.col("id").alias("para"), "kind", "page", "lines", F.posexplode(T.split_sentences("text")).alias("nth", "s"))
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("para", "nth")) - 1).alias("id")
    span = F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end")).alias("span")
    return found.select("doc_id", number, "para", "kind", F.col("s.text").alias("text"), "page", span, clip_lines(F.col("lines"), F.col("s.start"), F.col("s.end")).alias("rects"))


def attach_captions(figures: DataFrame, paras: DataFrame) -> DataFrame:
    """``figures`` with ``caption``: the nearest caption under or over a figure, within 80 points."""
    caps = paras.where("kind = 'caption' and size(rects) > 0").select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.col("id").alias("_id"), F.col("text").alias("_text"), F.get("rects", F.lit(0)).bbox.alias("_box"))
    box = F.col("bbox")
    below, above = F.col("_box.y0") - box.y1, box.y0 - F.col("_box.y1")
    beside = F.least(F.col("_box.x1"), box.x1) - F.greatest(F.col("_box.x0"), box.x0)
    gap = F.when(below >= -5, below).when(above >= -5, above + 20)
    near = figures.join(caps, (F.col("doc_id") == F.col("_doc")) & (F.col("page") == F.col("_page")) & (beside > 0)).withColumn("_gap", gap).where("_gap >= 0 and _gap < 80")
    rank = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("_gap", "_id"))
    best = near.withColumn("_rank", rank).where("_rank = 1").select("doc_id", "id", F.col("_text").alias("caption"))
    return figures.drop("caption").join(best, ["doc_id", "id"], "left").fillna("", ["caption"])


def ocr_blocks(tsv: DataFrame, dpi: int = 300) -> DataFrame:
    """Blocks from ``doc_id, page, line_no, value``, the TSV lines of a recogniser, in points."""
    cols = F.split("value", "\t")
    word = F.regexp_replace(F.get(cols, F.lit(11)), rf"^{T.WS}+|{T.WS}+$", "")
    words = tsv.where((F.size(cols) >= 12) & (F.get(cols, F.lit(0)) == "5") & (word != ""))
    num = lambda i, kind: F.get(cols, F.lit(i)).cast(kind)
    scale = 72.0 / dpi
    words = words.select(
        "doc_id", "page", "line_no", num(2, "int").alias("block"), num(3, "int").alias("par"), num(4, "int").alias("line"), word.alias("word"),
        (num(6, "double") * scale).alias("x0"), (num(7, "double") * scale).alias("y0"), ((num(6, "double") + num(8, "double")) * scale).alias("x1"), ((num(7, "double") + num(9, "double")) * scale).alias("y1"),
    )
    box = F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    lines = words.groupBy("doc_id", "page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "word"))), lambda w: w.word), " ").alias("text"), box.alias("bbox"))
    chars = F.length("text")
    size = F.struct(F.round(F.col("bbox.y1") - F.col("bbox.y0"), 1).alias("size"), chars.alias("n"))
    lines = lines.withColumn("ln", F.struct("text", "bbox", F.array(size).alias("sizes"), F.lit(0).alias("bold_chars"), chars.alias("chars")))
    union = F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))
    blocks = lines.groupBy("doc_id", "page", "block", "par").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "ln"))), lambda x: x.ln).alias("lines"), union.alias("bbox"))
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block", "par")) - 1
    return blocks.select("doc_id", "page", number.alias("block_no"), "bbox", "lines")
