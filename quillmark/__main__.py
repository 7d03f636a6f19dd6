"""python -m quillmark A.pdf B.pdf: compare two files, print the summary, write JSON, HTML and marked PDFs."""

from __future__ import annotations

import argparse
import os
import shutil
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable
from contextlib import ExitStack
from datetime import datetime

import numpy as np
from pyspark import SparkConf
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import ExtractOptions, ImageParams, SemanticParams, VerbatimParams
from .plans.compare import compare, extract, extract_cached
from .plans.stash import in_memory
from .sources import pdf, reports

#: Settings of a session for one pair, whose tables fit in one partition: tasks and compiled code cost more than they save.
PAIR_SETTINGS = {
    "spark.sql.shuffle.partitions": "1", "spark.default.parallelism": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.inMemoryColumnarStorage.compressed": "false", "spark.python.worker.reuse": "true",
    "spark.sql.session.timeZone": "UTC", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1 -XX:+UseSerialGC", "spark.sql.constraintPropagation.enabled": "false",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmark", description=__doc__)
    p.add_argument("a", help="first PDF")
    p.add_argument("b", help="second PDF")
    p.add_argument("-o", "--out", help="output folder (default: outputs/<A>_vs_<B>)")
    p.add_argument("--cache-dir", help="keep extractions here and take them from here")
    for layer in ("semantic", "images", "html", "annotate"):
        p.add_argument(f"--no-{layer}", action="store_true")
    p.add_argument("--json-only", action="store_true", help="write result.json only")
    p.add_argument("--quiet", action="store_true", help="print no summary")
    p.add_argument("--include-references", action="store_true")
    p.add_argument("--ocr", choices=("auto", "on", "off"), default="auto", help="read scanned pages, every page or none with a recogniser, if one is installed")
    p.add_argument("--figure-dpi", type=int, default=ExtractOptions.figure_dpi)
    p.add_argument("--kgram", type=int, default=VerbatimParams.kgram)
    p.add_argument("--window", type=int, default=VerbatimParams.window)
    p.add_argument("--min-run", type=int, default=VerbatimParams.min_run)
    p.add_argument("--max-gap", type=int, default=VerbatimParams.max_gap)
    p.add_argument("--near-threshold", type=float, default=VerbatimParams.near_threshold)
    p.add_argument("--boilerplate", help="file of phrases, a line each")
    p.add_argument("--model", default=SemanticParams.model, help="name or folder of a sentence-transformers model that is here already")
    p.add_argument("--device")
    p.add_argument("--sem-threshold", type=float, default=SemanticParams.sentence_threshold)
    p.add_argument("--sem-para-threshold", type=float, default=SemanticParams.paragraph_threshold)
    p.add_argument("--no-mutual", action="store_true")
    p.add_argument("--phash-threshold", type=int, default=ImageParams.phash_threshold)
    p.add_argument("--similar-threshold", type=int, default=ImageParams.similar_threshold)
    p.add_argument("--crop-ncc", type=float, default=ImageParams.crop_ncc)
    return p


def session() -> SparkSession:
    """The session that is there, or one made for a pair."""
    found = SparkSession.getActiveSession()
    if found is not None:
        return found
    builder = SparkSession.builder.appName("quillmark")
    if not SparkConf().contains("spark.master"):
        builder = builder.master("local[2]")
        for k, v in PAIR_SETTINGS.items():
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def recogniser() -> Callable[[bytes, int, int], list[str]] | None:
    """The installed programs that draw a page and read it, if both are there."""
    if not (shutil.which("pdftoppm") and shutil.which("tesseract")):
        return None

    def read(data: bytes, page: int, dpi: int) -> list[str]:
        with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
            f.write(data)
            f.flush()
            number = str(page + 1)
            image = subprocess.run(["pdftoppm", "-r", str(dpi), "-f", number, "-l", number, "-png", f.name], capture_output=True, check=True).stdout
        return subprocess.run(["tesseract", "stdin", "stdout", "tsv"], input=image, capture_output=True, check=True).stdout.decode("utf-8", "replace").splitlines()

    return read


def embedder(name: str, device: str | None) -> Callable[[], Callable[[list[str]], np.ndarray]] | None:
    """Loads the model in a worker; None if it or its library isn't here.  Nothing is fetched."""
    try:
        from sentence_transformers import SentenceTransformer

        SentenceTransformer(name, device=device, local_files_only=True)
    except Exception:  # whatever the library raises for a model that isn't there
        return None

    def load() -> Callable[[list[str]], np.ndarray]:
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(name, device=device, local_files_only=True).encode

    return load


def _write(path: str, data: bytes | str) -> str:
    with open(path, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)
    return path


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    paths = [o.a, o.b]
    if lost := [p for p in paths if not os.path.isfile(p)]:
        print(f"no such file: {', '.join(lost)}", file=sys.stderr)
        return 2
    with ExitStack() as stack:
        stack.enter_context(in_memory())
        return _run(o, paths)


def _run(o: argparse.Namespace, paths: list[str]) -> int:
    spark = session()
    stems = [os.path.splitext(os.path.basename(p))[0] for p in paths]
    out = o.out or os.path.join("outputs", "_vs_".join(stems))
    options = ExtractOptions(include_references=o.include_references, ocr=o.ocr, figure_dpi=o.figure_dpi)
    verbatim = VerbatimParams(kgram=o.kgram, window=o.window, max_gap=o.max_gap, min_run=o.min_run, near_threshold=o.near_threshold, include_references=o.include_references)
    semantic = None if o.no_semantic else SemanticParams(model=o.model, device=o.device, sentence_threshold=o.sem_threshold, paragraph_threshold=o.sem_para_threshold, mutual=not o.no_mutual, include_references=o.include_references)
    images = None if o.no_images else ImageParams(phash_threshold=o.phash_threshold, similar_threshold=o.similar_threshold, crop_ncc=o.crop_ncc)
    began = time.time()
    raw = []
    for p in paths:
        with open(p, "rb") as f:
            raw.append(f.read())
    files = spark.createDataFrame([(i, p, bytearray(d)) for i, (p, d) in enumerate(zip(paths, raw, strict=True), 1)], "doc_id long, path string, content binary").coalesce(1)
    both = extract_cached(files, o.cache_dir, options, recogniser()) if o.cache_dir else extract(files, options, recogniser())
    counts = {k: dict(getattr(both, k).groupBy("doc_id").count().collect()) for k in ("paragraphs", "sentences", "figures")}
    meta = {r.doc_id: r.asDict() | {f"n_{k}": counts[k].get(r.doc_id, 0) for k in counts} for r in both.docs.collect()}
    for m in meta.values():
        del m["doc_id"]
    timings = {"extract": time.time() - began}
    began = time.time()
    pairs = spark.createDataFrame([(1, 2)], "a_doc long, b_doc long").coalesce(1)
    found = compare(both, both, pairs, verbatim, semantic, images, embedder(semantic.model, semantic.device) if semantic else None, o.boilerplate)
    row = reports.summary(found.pairs, found.coverage, found.runs, found.sentence_pairs, found.semantic, found.figures).first().asDict()
    timings["compare"] = time.time() - began
    params = {"extract": options.to_dict(), "verbatim": verbatim.to_dict()} | {k: v.to_dict() for k, v in (("semantic", semantic), ("images", images)) if v}
    told = reports.result(
        meta[1], meta[2], row, {"runs": found.runs, "sentence_pairs": found.sentence_pairs}, found.semantic, found.figures, found.notes, timings,
        datetime.now().isoformat(timespec="seconds"), found.semantic_statistics, params,
    )
    os.makedirs(out, exist_ok=True)
    made = {"json": _write(os.path.join(out, "result.json"), reports.to_json(told))}
    if not o.json_only:
        if not o.no_html:
            made["report"] = _write(os.path.join(out, "report.html"), reports.to_html(told, _pictures(both, told)))
        if not o.no_annotate:
            for side, stem, data in zip("ab", stems, raw, strict=True):
                rows = reports.marks(side, found.runs, found.sentence_pairs, found.semantic, found.figures).select("page", F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1").alias("box"), "layer", "note").collect()
                marked = pdf.annotate(data, [(r.page, tuple(r.box), r.layer, r.note) for r in rows])
                if marked is not None:
                    made[f"pdf {side.upper()}"] = _write(os.path.join(out, f"{side}_{stem}.annotated.pdf"), marked)
    if not o.quiet:
        print(reports.to_text(told, made))
    return 0


def _pictures(both, told: dict) -> dict[tuple[str, int], bytes]:
    """PNG files of the figures that matched and have pixels."""
    wanted = {(d, r[f"{side}_id"]): side for r in told["images"] or [] for d, side in ((1, "a"), (2, "b"))}
    if not wanted:
        return {}
    rows = both.figures.where("data is not null").select("doc_id", "id", "height", "width", "channels", "data").collect()  # of two files
    return {(wanted[r.doc_id, r.id], r.id): pdf.png(r.height, r.width, r.channels, bytes(r.data)) for r in rows if (r.doc_id, r.id) in wanted}


if __name__ == "__main__":
    sys.exit(main())
