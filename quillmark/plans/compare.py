"""A whole comparison: extraction tables of two collections to the results of all three layers.

Layers keep their own results.  One that cannot run, as for want of vectors, is None and has a note.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BBOX, LEVELS, LINE, RECT, ExtractOptions, ImageParams, SemanticParams, VerbatimParams
from ..operators import figures as FG
from ..operators import layout as L
from ..operators import semantic as S
from ..operators import verbatim as V
from ..sources import cache, pdf
from .stash import stash

PAIR = ["a_doc", "b_doc"]


@dataclass
class Extraction:
    """Tables of a collection of documents."""

    docs: DataFrame
    paragraphs: DataFrame
    sentences: DataFrame
    figures: DataFrame | None = None


@dataclass
class Comparison:
    pairs: DataFrame
    runs: DataFrame
    sentence_pairs: DataFrame
    coverage: DataFrame
    semantic: DataFrame | None = None
    semantic_statistics: DataFrame | None = None
    figures: DataFrame | None = None
    notes: dict[str, str] = field(default_factory=dict)


Recognise = Callable[[bytes, int, int], list[str]]  # file, page and resolution to the TSV lines of a recogniser
OCR_DPI = 300


def _recognised(files: DataFrame, scanned: DataFrame, pages: DataFrame, recognise: Recognise) -> DataFrame:
    """Blocks of the pages in ``scanned``, read by ``recognise``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, p, i, line) for d, p, content in zip(frame["doc_id"], frame["page"], frame["content"], strict=True) for i, line in enumerate(recognise(bytes(content), p, OCR_DPI))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "line_no", "value"])

    ready = files.join(scanned, "doc_id").select("doc_id", "page", "content")
    tsv = ready.mapInPandas(run, "doc_id long, page int, line_no int, value string")
    return L.ocr_blocks(tsv, OCR_DPI).join(pages.select("doc_id", "page", F.col("height").alias("page_height")), ["doc_id", "page"])


def extract(files: DataFrame, options: ExtractOptions = ExtractOptions(), recognise: Recognise | None = None) -> Extraction:
    """Tables of PDF files given as ``doc_id, path, content``.

    Pages that look scanned, or all or none by ``options.ocr``, are read again by ``recognise``, if there is one.
    """
    files = stash(files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "content"), "files")
    sizes = stash(pdf.read_pages(files), "pages")
    blocks = stash(pdf.read_blocks(files), "blocks")
    pages = sizes.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))
    figures = stash(pdf.read_figures(files), "images")
    seen = None
    if recognise is not None and options.ocr != "off":
        scanned = stash(L.scanned_pages(blocks, figures, sizes, options), "scanned")
        seen = scanned.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("page") + 1)).alias("ocr_pages"))
        blocks = stash(blocks.join(scanned, ["doc_id", "page"], "left_anti").unionByName(_recognised(files, scanned, sizes, recognise).select(*blocks.columns)), "blocks")
    size = sizes.select("doc_id", "page", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    allowed = L.figure_allowed(F.col("bbox"), F.col("page_width"), F.col("page_height"), options) & (F.least("width", "height") >= options.min_image_px)
    shown = figures.join(size, ["doc_id", "page"]).where(allowed).select(*figures.columns)
    units = stash(L.classify(blocks, shown, pages), "units")
    paras = stash(L.paragraphs(units, options), "paragraphs")
    sents = stash(L.sentences(paras), "sentences")
    shown = stash(L.attach_captions(L.without_frames(shown), paras), "figures")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    docs = files.select("doc_id", "path", name, F.sha2("content", 256).alias("sha256")).join(pages, "doc_id", "left").join(L.titles(units), "doc_id", "left")
    docs = docs.join(seen, "doc_id", "left") if seen is not None else docs.withColumn("ocr_pages", F.array().cast("array<int>"))
    docs = docs.withColumns({"n_pages": F.coalesce("n_pages", F.lit(0)), "title": F.coalesce("title", F.lit("")), "ocr_pages": F.coalesce("ocr_pages", F.array().cast("array<int>"))})
    return Extraction(docs, paras, sents, shown)


#: What the cache has of a file; its doc_id and path are those of whoever asks.
PARTS = {
    "docs": "sha256 string, n_pages int, title string, ocr_pages array<int>",
    "paragraphs": f"id int, kind string, text string, page int, lines array<{LINE}>, n_tokens int, rects array<{RECT}>",
    "sentences": f"id int, para int, kind string, text string, page int, span struct<start:int,end:int>, rects array<{RECT}>",
    "figures": f"id int, page int, bbox {BBOX}, kind string, sha256 string, width int, height int, channels int, data binary, caption string",
}


def extract_cached(files: DataFrame, root: str, options: ExtractOptions = ExtractOptions(), recognise: Recognise | None = None) -> Extraction:
    """``extract``, with what the cache at ``root`` has of a file's bytes and these options; the rest is added to it."""
    spark = files.sparkSession
    keyed = files.withColumn("cache_key", cache.cache_key(F.sha2("content", 256), options))
    keyed = stash(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "content", "cache_key"), "keyed")
    once = keyed.groupBy("cache_key").agg(F.min("doc_id").alias("doc_id"))
    new = stash(cache.missing(keyed.join(once, ["cache_key", "doc_id"]), root, "docs"), "missing")
    if not new.isEmpty():
        made = extract(new, options, recognise)
        for part in reversed(PARTS):  # docs last: what they have is whole
            cache.store(getattr(made, part).join(new.select("doc_id", "cache_key"), "doc_id").drop("doc_id", "path", "name"), root, part)
    own = keyed.select("doc_id", "cache_key", "path")
    found = {}
    for part, schema in PARTS.items():
        rows = cache.load(spark, root, part, keyed, schema).join(own, "cache_key").drop("cache_key")
        if part == "docs":
            rows = rows.withColumn("name", F.element_at(F.split("path", "/"), -1))
        found[part] = stash(rows if part == "docs" else rows.drop("path"), part)
    return Extraction(**found)


def compare(
    a: Extraction, b: Extraction, pairs: DataFrame, verbatim: VerbatimParams = VerbatimParams(), semantic: SemanticParams | None = None, images: ImageParams | None = None,
    model: Callable | None = None, phrases: str | None = None,
) -> Comparison:
    """Compare the given pairs; ``semantic`` and ``images`` of None leave those layers out.

    ``model`` makes the embedding function of a worker; it is never fetched.
    """
    spark = pairs.sparkSession
    known = V.phrases(spark, phrases)
    sa = stash(V.streams(a.paragraphs, verbatim), "streams")
    sb = sa if a is b else stash(V.streams(b.paragraphs, verbatim), "streams")
    pa = stash(V.usable(V.fingerprints(sa, verbatim), verbatim), "prints")
    pb = pa if a is b else stash(V.usable(V.fingerprints(sb, verbatim), verbatim), "prints")
    seeds = V.seeds(pa, pb).join(pairs, PAIR, "left_semi")
    merged = V.merge_runs(V.exact_runs(sa, sb, stash(seeds, "seeds"), verbatim.kgram), verbatim.max_gap)
    runs = stash(V.score_runs(merged, sa, sb, known, verbatim), "runs")
    covered = [V.sentence_coverage(x.sentences, s, runs, side) for x, s, side in ((a, sa, "a"), (b, sb, "b"))]
    near = V.sentence_pairs(pairs, a.sentences, b.sentences, *covered, known, verbatim)
    for side, x in (("a", a), ("b", b)):
        places = V.run_places(runs, side, x.paragraphs).select(*PAIR, "run_id", F.col("locs").alias(f"{side}_locs"), F.col("text").alias(f"{side}_text"))
        runs = runs.join(places, [*PAIR, "run_id"], "left")
        rects = x.sentences.select(F.col("doc_id").alias(f"{side}_doc"), F.col("id").alias(f"{side}_sentence"), F.col("rects").alias(f"{side}_rects"))
        near = near.join(rects, [f"{side}_doc", f"{side}_sentence"], "left")
    runs, near = stash(runs.drop("ta", "tb"), "runs"), stash(near, "near")
    out = Comparison(pairs, runs, near, V.coverage(pairs, runs, sa, sb))
    if semantic is None:
        out.notes["semantic"] = "disabled"
    elif model is None:
        out.notes["semantic"] = f"embedding model {semantic.model} is not available here"
    else:
        out.semantic, out.semantic_statistics = _semantic(a, b, pairs, runs, near, semantic, model)
    if images is None:
        out.notes["images"] = "disabled"
    elif a.figures is None or b.figures is None:
        out.notes["images"] = "no figures were extracted"
    else:
        ha = stash(FG.hash_figures(a.figures, images), "hashes")
        hb = ha if a is b else stash(FG.hash_figures(b.figures, images), "hashes")
        out.figures = stash(FG.compare(ha, hb, pairs, images), "matches")
    return out


def _semantic(a: Extraction, b: Extraction, pairs: DataFrame, runs: DataFrame, near: DataFrame, params: SemanticParams, model: Callable) -> tuple[DataFrame, DataFrame]:
    """Pairs and statistics of both levels; what runs and near sentences explain is left out."""
    found, stats = [], []
    for level in LEVELS:
        sides = []
        for side, x in (("a", a), ("b", b)):
            own = f"{side}_doc"
            # a document's explained places depend on its partner, so units are taken pair by pair
            key = F.concat_ws(" ", *PAIR)
            cut = runs.select(key.alias("doc_id"), F.explode(f"{side}_locs").alias("l")).select("doc_id", "l.para", "l.start", "l.end")
            gone = near.select(key.alias("doc_id"), own, F.col(f"{side}_sentence").alias("id"))
            spans = gone.join(x.sentences.select(F.col("doc_id").alias(own), "id", "para", "span"), [own, "id"]).select("doc_id", "para", "span.start", "span.end")
            units = x.sentences if level == "sentence" else x.paragraphs.withColumns({"para": F.col("id"), "span": F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))})
            units = pairs.join(units.withColumnRenamed("doc_id", own), own).withColumn("doc_id", key).select("doc_id", *PAIR, "id", "para", "span", "kind", "text", "page", "rects")
            kept = S.eligible(units, cut.union(spans), gone.select("doc_id", "id"), level, params)
            sides.append(stash(S.embed(kept.select(*PAIR, "id", "text", "page", "rects"), model, params.batch_size), "vectors"))
        threshold = params.sentence_threshold if level == "sentence" else params.paragraph_threshold
        best = stash(S.nearest(*(s.select(*PAIR, "id", "vec") for s in sides)), "nearest")
        hits = S.matches(best, threshold, params.mutual)
        for side, s in zip("ab", sides, strict=True):
            hits = hits.join(s.select(*PAIR, F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in ("text", "page", "rects")]), [*PAIR, f"{side}_id"])
        found.append(hits.select(F.lit(level).alias("level"), *PAIR, "a_id", "b_id", F.round("sim", 3).alias("score"), "a_text", "b_text", "a_page", "b_page", "a_rects", "b_rects"))
        stats.append(S.statistics(best, threshold, pairs, *sides).withColumn("level", F.lit(level)))
    return found[0].unionByName(found[1]), stats[0].unionByName(stats[1])
