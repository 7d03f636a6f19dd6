"""Reports of comparisons: summary rows, marks, JSON, console text, HTML, and marks in PDFs.

The three layers are never blended into one number.  Tables come first; files are made on the driver for
one pair of documents, whose results are small.
"""

from __future__ import annotations

import base64
import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import marked_difference
from ..model import FIGURE_VERDICTS, LEVELS

PAIR = ["a_doc", "b_doc"]
VERSION = "1"
THUMB_WIDTH = 360  # of pictures in a page


def _count(condition) -> F.Column:
    return F.count_if(condition)


def summary(pairs: DataFrame, coverage: DataFrame, runs: DataFrame, sentences: DataFrame, semantic: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """A row for each of ``pairs``; columns of a layer that wasn't run are absent."""
    out = pairs.select(*PAIR).join(coverage.select(*PAIR, "tokens_a", "tokens_b", "coverage_a", "coverage_b", "longest_run"), PAIR, "left")
    counted = [
        runs.groupBy(*PAIR).agg(F.count("*").alias("runs"), _count(F.col("verdict") == "exact").alias("exact_runs"), _count(F.col("verdict") == "near").alias("near_runs")),
        sentences.groupBy(*PAIR).agg(F.count("*").alias("near_sentences")),
    ]
    if semantic is not None:
        counted.append(semantic.groupBy(*PAIR).agg(F.count("*").alias("semantic_pairs"), *[_count(F.col("level") == lv).alias(f"{lv}_pairs") for lv in LEVELS]))
    if figures is not None:
        counted.append(figures.groupBy(*PAIR).agg(*[_count(F.col("verdict") == v).alias(f"figures_{v}") for v in FIGURE_VERDICTS]))
    for c in counted:
        out = out.join(c, PAIR, "left")
    return out.fillna(0).withColumns({c: F.round(c, 4) for c in ("coverage_a", "coverage_b")})


def marks(side: str, runs: DataFrame | None = None, sentences: DataFrame | None = None, semantic: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """``a_doc, b_doc, page, bbox, layer, note``: every place to mark on one side; boxes under a point are left out.

    Runs have ``a_locs, b_locs``, sentences and semantic pairs ``a_rects, b_rects`` and pages.
    """
    other = "b" if side == "a" else "a"
    name = other.upper()
    page = lambda c: F.coalesce((c + 1).cast("string"), F.lit("?"))
    parts = []
    if runs is not None:
        first = F.get(f"{other}_locs", F.lit(0)).page
        note = F.format_string(f"%s run #%s: %s words, score %s; matches {name} p%s", "verdict", "run_id", F.col("a1") - F.col("a0"), F.col("score").cast("string"), page(first))
        rects = F.explode(F.flatten(F.transform(f"{side}_locs", lambda x: x.rects)))
        parts.append(runs.select(*PAIR, rects.alias("r"), F.col("verdict").alias("layer"), note.alias("note")))
    if sentences is not None:
        note = F.format_string(f"%s sentence, score %s; matches {name} p%s", "verdict", F.col("score").cast("string"), page(F.col(f"{other}_page")))
        parts.append(sentences.select(*PAIR, F.explode(f"{side}_rects").alias("r"), F.col("verdict").alias("layer"), note.alias("note")))
    if semantic is not None:
        note = F.format_string(f"paraphrase (%s), cosine %s; matches {name} p%s [weaker evidence]", "level", F.col("score").cast("string"), page(F.col(f"{other}_page")))
        parts.append(semantic.select(*PAIR, F.explode(f"{side}_rects").alias("r"), F.lit("semantic").alias("layer"), note.alias("note")))
    if figures is not None:
        note = F.format_string(f"figure %s: pHash %s, NCC %s; matches {name} p%s", "verdict", "phash_distance", F.col("ncc").cast("string"), page(F.col(f"{other}_page")))
        box = F.struct(F.col(f"{side}_page").alias("page"), F.col(f"{side}_bbox").alias("bbox"))
        parts.append(figures.select(*PAIR, box.alias("r"), F.lit("figure").alias("layer"), note.alias("note")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.select(*PAIR, "r.page", "r.bbox", "layer", "note")
    return out.where("bbox.x1 - bbox.x0 >= 1 and bbox.y1 - bbox.y0 >= 1")


def _rows(df: DataFrame | None) -> list[dict] | None:
    return None if df is None else [r.asDict(recursive=True) for r in df.collect()]


def result(
    a: dict, b: dict, summary_row: dict, verbatim: dict[str, DataFrame], semantic: DataFrame | None = None, images: DataFrame | None = None, notes: dict[str, str] | None = None,
    timings: dict[str, float] | None = None, generated: str = "", statistics: DataFrame | None = None, params: dict[str, dict] | None = None,
) -> dict:
    """Everything about one pair, as JSON holds it; a layer that wasn't run is null and has a note."""
    notes, params = notes or {}, params or {}
    told = {r["level"]: {k: v for k, v in r.items() if k not in (*PAIR, "level")} for r in _rows(statistics) or []}
    return {
        "version": VERSION, "generated": generated, "a": a, "b": b, "summary": summary_row, "params": params, "timings_s": {k: round(v, 2) for k, v in (timings or {}).items()},
        "verbatim": {k: _rows(v) for k, v in verbatim.items()}, "semantic": _rows(semantic), "semantic_statistics": told, "semantic_note": notes.get("semantic", ""),
        "images": _rows(images), "images_note": notes.get("images", ""),
    }


def to_json(found: dict) -> str:
    return json.dumps(found, indent=1, ensure_ascii=False, default=str)


def to_text(found: dict, files: dict[str, str] | None = None) -> str:
    """The console summary, and where the files are."""
    s, told = found["summary"], found.get("semantic_statistics") or {}
    mean = {lv: told.get(lv, {}).get("mean_max_sim", 0.0) for lv in LEVELS}
    shown = [found[side].get("n_figures") for side in "ab"]
    #: The wording of the summary's lines, a line each.
    wording = {
        "verbatim": "  verbatim : {coverage_a:.1%} of A / {coverage_b:.1%} of B inside {runs} runs ({exact_runs} exact, {near_runs} near; longest {longest_run} words); {near_sentences} near-verbatim sentences",
        "semantic": "  semantic : {semantic_pairs} paraphrase-only pairs ({sentence_pairs} sentences, {paragraph_pairs} paragraphs); mean max-sim sent {sentence:.2f} / para {paragraph:.2f}   [weaker evidence]",
        "images": "  figures  : {figures_exact} exact, {figures_same} same, {figures_cropped} cropped, {figures_similar} similar   ({n_a} vs {n_b} figures)",
        "skipped": "  {layer:8} : skipped ({note})",
        "file": "  {label:9}: {path}",
    }
    lines = [f"{found['a']['name']} vs {found['b']['name']}", wording["verbatim"].format(**s)]
    for layer, name, more in (("semantic", "semantic", mean), ("images", "figures", {"n_a": shown[0], "n_b": shown[1]})):
        if found[layer] is None:
            lines.append(wording["skipped"].format(layer=name, note=found[f"{layer}_note"] or "disabled"))
        else:
            lines.append(wording[layer].format(**s, **more))
    return "\n".join(lines + [wording["file"].format(label=k, path=v) for k, v in (files or {}).items()])


def to_html(found: dict, images: dict[tuple[str, int], bytes] | None = None) -> str:
    """A page with the summary, parameters, runs with their differences, near sentences, paraphrases and figures.

    ``images`` has PNG files by side and figure id; a figure without one is named only.
    """
    esc = lambda x: html.escape(str(x))
    out = ["<!DOCTYPE html><html lang=en><meta charset=utf-8><title>Shared material</title>", f"<pre>{esc(to_text(found))}</pre>"]
    for side in "ab":
        doc = found[side]
        facts = [f"{doc[k]} {k.removeprefix('n_')}" for k in ("n_pages", "n_paragraphs", "n_sentences", "n_figures") if k in doc]
        facts += [f"OCR on pages {', '.join(map(str, doc['ocr_pages']))}"] if doc.get("ocr_pages") else []
        out.append(f"<p>{side.upper()}: <b>{esc(doc.get('title') or '(no title found)')}</b> {esc(', '.join(facts))}</p>")

    def both(head: str, left: str, right: str) -> None:
        out.append(f"<section><h3>{head}</h3><div>{left}</div><div>{right}</div></section>")

    for r in found["verbatim"].get("runs") or []:
        a, b = (esc(r["a_text"]), esc(r["b_text"])) if r["verdict"] == "exact" else marked_difference(r["a_text"], r["b_text"])
        both(f"{r['verdict']} run, score {r['score']}", a, b)
    for r in found["verbatim"].get("sentence_pairs") or []:
        both(f"{r['verdict']} sentence, score {r['score']}", *marked_difference(r["a_text"], r["b_text"]))
    for r in sorted(found["semantic"] or [], key=lambda r: (r["level"] != "paragraph", -r["score"])):
        both(f"{r['level']}, cosine {r['score']}", esc(r["a_text"]), esc(r["b_text"]))

    def picture(side: str, r: dict) -> str:
        made = (images or {}).get((side, r[f"{side}_id"]))
        name = f"figure {r[f'{side}_id']}" + (f": {r[f'{side}_caption']}" if r.get(f"{side}_caption") else "")
        return (f'<img src="data:image/png;base64,{base64.b64encode(made).decode()}" width={THUMB_WIDTH}>' if made else "") + f"<p>{esc(name)}</p>"

    for r in found["images"] or []:
        both(f"figure {r['verdict']}, pHash {r['phash_distance']}", picture("a", r), picture("b", r))
    for level, told in (found.get("semantic_statistics") or {}).items():
        out.append(f"<p>{esc(level)} similarities: {esc(', '.join(f'{k} {v}' for k, v in told.items()))}</p>")
    out.append(f"<pre>{esc(json.dumps(found.get('params') or {}, indent=1))}</pre>")
    return "\n".join([*out, "</html>"])
