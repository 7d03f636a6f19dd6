"""Verbatim layer: winnowed fingerprints, maximal exact runs, merged and scored runs, near sentences.

Everything is keyed by ``(a_doc, b_doc)``, so one pair of documents and two whole collections
are the same plan.  Token streams are a row for each document; winnowing stays inside that row, and
shuffles begin with the fingerprint join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import VerbatimParams, text_kinds
from ..plans.stash import stash
from .alike import near_sentences

PAIR = ["a_doc", "b_doc"]

#: Phrases whose sharing is no evidence.
BOILERPLATE = (
    "the rest of the paper is organized as follows",
    "the remainder of this paper is organized as follows",
    "this paper is organized as follows",
    "the rest of this paper is organized as follows",
    "to the best of our knowledge",
    "the contributions of this paper are as follows",
    "we make the following contributions",
    "this work was supported in part by",
    "the authors would like to thank",
    "section 2 describes",
    "the remainder of this paper",
)


# --- streams ----------------------------------------------------------------------


def streams(paragraphs: DataFrame, params: VerbatimParams = VerbatimParams()) -> DataFrame:
    """``doc_id, toks``: tokens of the compared paragraphs of each document, in order."""
    kept = paragraphs.where(F.col("kind").isin(text_kinds(params.include_references)))
    found = kept.select("doc_id", "id", T.tokens_with_offsets("text").alias("t"))
    own = F.transform("t", lambda x: F.struct(x.tok.alias("tok"), F.col("id").cast("int").alias("para"), x.start.alias("start"), x.end.alias("end")))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", own.alias("own")))).alias("p")).select(
        "doc_id", F.flatten(F.transform("p", lambda x: x.own)).alias("toks")
    )


def plain_streams(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, toks`` of whole texts as one paragraph without offsets, all in the JVM."""
    toks = F.transform(T.tokenize(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("tok"), F.lit(0).alias("para"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    return docs.select("doc_id", toks.alias("toks"))


def stream_key(toks: Column) -> Column:
    """A digest that equal token streams share."""
    return F.md5(F.array_join(F.transform(toks, lambda t: t.tok), " ").cast("binary"))


def classes(stream: DataFrame) -> DataFrame:
    """``doc_id, copies, toks``: each stream of tokens once, under its least doc_id, with how many documents have it."""
    keyed = stream.where(F.size("toks") > 0).select("doc_id", stream_key(F.col("toks")).alias("key"))
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return stream.join(least.drop("key"), "doc_id").select("doc_id", "copies", "toks")


def tokens(stream: DataFrame) -> DataFrame:
    """``doc_id, pos, tok, para, start, end``."""
    return stream.select("doc_id", F.posexplode("toks").alias("pos", "t")).select("doc_id", "pos", "t.*")


def _gram(i: Column, k: int) -> Column:
    return F.array_join(F.slice("words", i + 1, k), " ")


def _words(stream: DataFrame, k: int) -> DataFrame:
    """``doc_id, words, n``: the tokens and how many windows of k they have."""
    words = stream.select("doc_id", F.transform("toks", lambda t: t.tok).alias("words"))
    return words.withColumn("n", F.size("words") - k + 1)


def _each(n: Column, make, kind: str) -> Column:
    """``make`` of 0..n-1; nothing for n < 1.  No filter on n: it would be pushed down and count the tokens again."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast(f"array<{kind}>"))


def kgrams(stream: DataFrame, k: int = 6) -> DataFrame:
    """``doc_id, pos, gram, h``: every window of k tokens and its CRC-32."""
    grams = _each(F.col("n"), lambda i: _gram(i, k), "string")
    return _words(stream, k).select("doc_id", F.posexplode(grams).alias("pos", "gram")).withColumn("h", F.crc32(F.col("gram").cast("binary")))


_PLACE = 31  # bits of a position, below the 32 of a hash
_LAST = (1 << _PLACE) - 1


def fingerprints(stream: DataFrame, params: VerbatimParams = VerbatimParams()) -> DataFrame:
    """``doc_id, h, pos``: the rightmost least hash of every window of hashes.

    Hash and place are one whole number whose order is by hash and then from the right.
    """
    k, w = params.kgram, params.window
    code = lambda i: F.shiftleft(F.crc32(_gram(i, k).cast("binary")), _PLACE) + (_LAST - i)
    hashed = _words(stream, k).select("doc_id", "n", _each(F.col("n"), code, "bigint").alias("hs"))
    least = (lambda i: F.least(*[F.get("hs", i + j) for j in range(w)])) if w > 1 else (lambda i: F.get("hs", i))
    windows = F.when(F.col("n") > 0, F.greatest(F.col("n") - w + 1, F.lit(1))).otherwise(0)
    picked = hashed.select("doc_id", F.explode(F.array_distinct(_each(windows, least, "bigint"))).alias("f"))
    return picked.select("doc_id", F.shiftright("f", _PLACE).alias("h"), (_LAST - F.col("f").bitwiseAND(_LAST)).cast("int").alias("pos"))


def position_lists(prints: DataFrame) -> DataFrame:
    """``doc_id, h, positions``."""
    return prints.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def usable(prints: DataFrame, params: VerbatimParams = VerbatimParams()) -> DataFrame:
    """Position lists of the hashes that a document doesn't repeat too often."""
    return position_lists(prints).where(F.size("positions") <= params.max_fingerprint_positions)


def seeds(a: DataFrame, b: DataFrame, ordered: bool = False) -> DataFrame:
    """``a_doc, b_doc, h, i, j``: all places of shared hashes; ``ordered`` for a collection with itself."""
    left = a.select(F.col("doc_id").alias("a_doc"), "h", F.col("positions").alias("pa"))
    right = b.select(F.col("doc_id").alias("b_doc"), "h", F.col("positions").alias("pb"))
    met = left.join(right, "h")
    if ordered:
        met = met.where("a_doc < b_doc")
    return met.select(*PAIR, "h", F.explode("pa").alias("i"), "pb").select(*PAIR, "h", "i", F.explode("pb").alias("j"))


def shared_fingerprints(a: DataFrame, b: DataFrame, ordered: bool = False) -> DataFrame:
    """``a_doc, b_doc, shared, places``: distinct shared hashes and pairs of places."""
    left = a.select(F.col("doc_id").alias("a_doc"), "h", F.size("positions").alias("na"))
    right = b.select(F.col("doc_id").alias("b_doc"), "h", F.size("positions").alias("nb"))
    met = left.join(right, "h")
    if ordered:
        met = met.where("a_doc < b_doc")
    return met.groupBy(*PAIR).agg(F.count("*").alias("shared"), F.sum(F.col("na") * F.col("nb")).cast("long").alias("places"))


# --- runs -------------------------------------------------------------------------


def _stretches(a: np.ndarray, b: np.ndarray, seeds: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """Maximal equal stretches of k tokens and more that hold a seed; tokens are numbers, seeds pairs of places."""
    out = []
    diagonal = seeds[:, 0] - seeds[:, 1]
    for d in np.unique(diagonal):
        at = seeds[diagonal == d, 0]
        lo, hi = max(0, d), min(len(a), len(b) + d)
        edge = np.diff(np.concatenate([[0], a[lo:hi] == b[lo - d : hi - d], [0]]).astype(np.int8))
        start, stop = np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo
        nth = np.searchsorted(start, at, side="right") - 1
        if not len(start):
            continue
        good = (nth >= 0) & (at + k <= stop[np.maximum(nth, 0)])
        for i in np.unique(nth[good]):
            out.append((int(start[i]), int(stop[i]), int(start[i] - d), int(stop[i] - d)))
    return out


def exact_runs(sa: DataFrame, sb: DataFrame, found: DataFrame, k: int = 6) -> DataFrame:
    """``a_doc, b_doc, a0, a1, b0, b1``: maximal equal stretches that contain a seed.

    The tokens of a pair's documents come together in one row with the pair's seeds, and each seed is extended on its
    diagonal by comparing the tokens themselves, so equal hashes of other tokens never count.  Documents in no
    pair are not read further.
    """
    kinds = {c: found.schema[c].dataType.simpleString() for c in PAIR}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(lo, 256) for x in batches for lo in range(0, x.num_rows, 256)):
            sides = [batch.column(i) for i in (2, 3)]
            offs = [x.offsets.to_numpy() for x in sides]
            parts = [x.values.slice(o[0], o[-1] - o[0]) for x, o in zip(sides, offs, strict=True)]
            offs = [o - o[0] for o in offs]
            codes = pa.concat_arrays(parts).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            split = len(parts[0])
            places = batch.column(4)
            seed_off, flat = places.offsets.to_numpy(), np.stack([places.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1).astype(np.int64)
            who, made = [], []
            for r in range(batch.num_rows):
                a = codes[offs[0][r] : offs[0][r + 1]]
                b = codes[split + offs[1][r] : split + offs[1][r + 1]]
                rows = _stretches(a, b, flat[seed_off[r] : seed_off[r + 1]], k)
                who += [r] * len(rows)
                made += rows
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([m[i] for m in made], pa.int32()) for i in range(4))], [*PAIR, "a0", "a1", "b0", "b1"])

    words = lambda s, side: s.select(F.col("doc_id").alias(f"{side}_doc"), F.transform("toks", lambda t: t.tok).alias(f"w{side}"))
    pairs = found.groupBy(*PAIR).agg(F.collect_set(F.struct("i", "j")).alias("seeds"))
    both = pairs.join(words(sa, "a"), "a_doc").join(words(sb, "b"), "b_doc").select(*PAIR, "wa", "wb", "seeds")
    return both.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in PAIR) + ", a0 int, a1 int, b0 int, b1 int")


def merge_runs(exact: DataFrame, max_gap: int = 3) -> DataFrame:
    """Runs with small edits between them joined, and runs inside the one before dropped.

    A fold over a pair's runs in order of ``(a0, a1, b0, b1)``, against the last run kept only.
    """
    kind = "struct<a0:int,a1:int,b0:int,b1:int>"
    runs = F.array_sort(F.collect_list(F.struct("a0", "a1", "b0", "b1").cast(kind))).alias("runs")
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("last"))

    def fold(acc: Column, r: Column) -> Column:
        last = acc["last"]
        ga, gb = r.a0 - last.a1, r.b0 - last.b1
        joins = ga.between(-1, max_gap) & gb.between(-1, max_gap) & (F.abs(ga - gb) <= max_gap)
        inside = (r.a0 < last.a1) & (r.b0 < last.b1)
        longer = F.struct(last.a0.alias("a0"), F.greatest(last.a1, r.a1).alias("a1"), last.b0.alias("b0"), F.greatest(last.b1, r.b1).alias("b1"))
        state = lambda done, run: F.struct(done.alias("done"), run.alias("last"))
        return (
            F.when(last.isNull(), state(acc.done, r))
            .when(joins, state(acc.done, longer))
            .when(inside, acc)
            .otherwise(state(F.array_append(acc.done, last), r))
        )

    folded = F.aggregate("runs", start, fold, lambda acc: F.array_append(acc.done, acc["last"]))
    return exact.groupBy(*PAIR).agg(runs).select(*PAIR, F.explode(folded).alias("r")).select(*PAIR, "r.*")


def phrases(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``phrase``: the built-in phrases and those of a file, a line each; ``#`` begins a comment line."""
    found = spark.createDataFrame([(p,) for p in BOILERPLATE], "value string")
    if path:
        lines = spark.read.text(path).select(F.regexp_replace("value", rf"^{T.WS}+|{T.WS}+$", "").alias("value"))
        found = found.union(lines.where("value <> '' and not startswith(value, '#')"))
    return found.select(T.token_string(F.col("value")).alias("phrase")).distinct()


def without_boilerplate(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Rows whose token string is part of no phrase."""
    few = F.broadcast(known.select(F.col("phrase").alias("_phrase")))  # the built-in ones and those of a file
    return rows.join(few, F.contains(F.col("_phrase"), F.col(column)), "left_anti")


def score_runs(merged: DataFrame, sa: DataFrame, sb: DataFrame, known: DataFrame, params: VerbatimParams = VerbatimParams()) -> DataFrame:
    """Merged runs that are long enough, no boilerplate and alike enough, with score and verdict."""
    long_enough = merged.where(F.col("a1") - F.col("a0") >= params.min_run)
    rows = long_enough.join(sa.select(F.col("doc_id").alias("a_doc"), F.col("toks").alias("ta")), "a_doc").join(sb.select(F.col("doc_id").alias("b_doc"), F.col("toks").alias("tb")), "b_doc")
    part = lambda toks, lo, hi: F.slice(toks, F.col(lo) + 1, F.col(hi) - F.col(lo))
    rows = rows.select(*PAIR, "a0", "a1", "b0", "b1", part("ta", "a0", "a1").alias("ta"), part("tb", "b0", "b1").alias("tb"))
    joined = lambda toks: F.array_join(F.transform(toks, lambda t: t.tok), " ")
    rows = without_boilerplate(rows.withColumns({"a_tokens": joined("ta"), "b_tokens": joined("tb")}), "a_tokens", known)
    rows = rows.withColumn("ratio", T.indel_ratio("a_tokens", "b_tokens")).where(F.col("ratio") >= params.near_threshold)
    order = Window.partitionBy(*PAIR).orderBy("a0", "a1", "b0", "b1")
    return rows.select(
        *PAIR, (F.row_number().over(order) - 1).alias("run_id"), "a0", "a1", "b0", "b1", "ta", "tb", "a_tokens", "b_tokens", F.round("ratio", 1).alias("score"),
        F.when(F.col("ratio") >= params.exact_threshold, "exact").otherwise("near").alias("verdict"),
    )


def run_places(runs: DataFrame, side: str, paragraphs: DataFrame) -> DataFrame:
    """``a_doc, b_doc, run_id, locs, text``: the stretch of each paragraph that a run touches, in order."""
    own = f"{side}_doc"
    each = runs.select(*PAIR, "run_id", F.posexplode(f"t{side}").alias("at", "t")).groupBy(*PAIR, "run_id", "t.para").agg(
        F.min("at").alias("at"), F.min("t.start").alias("start"), F.max("t.end").alias("end")
    )
    para = paragraphs.select(F.col("doc_id").alias(own), F.col("id").alias("para"), "page", F.col("text").alias("body"), *[c for c in ("lines",) if c in paragraphs.columns])
    rows = each.join(para, [own, "para"])
    rects = clip_lines(F.col("lines"), F.col("start"), F.col("end")) if "lines" in para.columns else F.lit(None).cast("string")
    rows = rows.withColumn("piece", F.expr("substring(body, start + 1, end - start)")).withColumn("rects", rects)
    every = F.array_sort(F.collect_list(F.struct("at", "para", "start", "end", "page", "piece", "rects")))
    found = rows.groupBy(*PAIR, "run_id").agg(every.alias("l"))
    locs = F.transform("l", lambda x: F.struct(x.para.alias("para"), x.start.alias("start"), x.end.alias("end"), x.page.alias("page"), x.rects.alias("rects")))
    return found.select(*PAIR, "run_id", locs.alias("locs"), F.array_join(F.transform("l", lambda x: x.piece), " ").alias("text"))


def clip_lines(lines: Column, start: Column, end: Column) -> Column:
    """Rectangles of the characters start..end, cut from their lines in proportion to characters."""
    hit = F.filter(lines, lambda ln: (ln.end > start) & (ln.start < end))

    def cut(ln: Column) -> Column:
        n = F.greatest(ln.end - ln.start, F.lit(1))
        width = ln.bbox.x1 - ln.bbox.x0
        x0 = ln.bbox.x0 + width * (F.greatest(start, ln.start) - ln.start) / n
        x1 = ln.bbox.x0 + width * (F.least(end, ln.end) - ln.start) / n
        return F.struct(ln.page.alias("page"), F.struct(x0.alias("x0"), ln.bbox.y0.alias("y0"), x1.alias("x1"), ln.bbox.y1.alias("y1")).alias("bbox"))

    return F.transform(hit, cut)


# --- coverage ---------------------------------------------------------------------


def covered_positions(runs: DataFrame, side: str) -> DataFrame:
    """``a_doc, b_doc, pos``: tokens of one side inside any run."""
    return runs.select(*PAIR, F.explode(F.sequence(f"{side}0", F.col(f"{side}1") - 1)).alias("pos")).distinct()


def coverage(pairs: DataFrame, runs: DataFrame, sa: DataFrame, sb: DataFrame) -> DataFrame:
    """Token totals, covered tokens and shares, and the longest run, a row for each of ``pairs``."""
    out = pairs.select(*PAIR)
    for side, stream in (("a", sa), ("b", sb)):
        total = stream.select(F.col("doc_id").alias(f"{side}_doc"), F.size("toks").alias(f"tokens_{side}"))
        covered = covered_positions(runs, side).groupBy(*PAIR).agg(F.count("*").alias(f"covered_{side}"))
        out = out.join(total, f"{side}_doc", "left").join(covered, PAIR, "left")
    longest = runs.groupBy(*PAIR).agg(F.max(F.col("a1") - F.col("a0")).alias("longest_run"), F.count("*").alias("runs"))
    out = out.join(longest, PAIR, "left").fillna(0)
    share = lambda side: F.when(F.col(f"tokens_{side}") > 0, F.col(f"covered_{side}") / F.col(f"tokens_{side}")).otherwise(0.0)
    return out.withColumns({"coverage_a": share("a"), "coverage_b": share("b")})


# --- near sentences ---------------------------------------------------------------


def sentence_coverage(sents: DataFrame, stream: DataFrame, runs: DataFrame, side: str) -> DataFrame:
    """``a_doc, b_doc, id, covered``: share of a sentence's tokens inside runs, where there is any."""
    own = f"{side}_doc"
    span = sents.select(F.col("doc_id").alias(own), "id", "para", F.col("span.start").alias("s"), F.col("span.end").alias("e"))
    inside = tokens(stream).withColumnRenamed("doc_id", own).join(span, [own, "para"]).where("start >= s and end <= e")
    total = inside.groupBy(own, "id").agg(F.count("*").alias("n"))
    hit = covered_positions(runs, side).join(inside.select(own, "pos", "id"), [own, "pos"]).groupBy(*PAIR, "id").agg(F.count("*").alias("hit"))
    return hit.join(total, [own, "id"]).select(*PAIR, "id", (F.col("hit") / F.col("n")).alias("covered"))


def sentence_pairs(pairs: DataFrame, sents_a: DataFrame, sents_b: DataFrame, covered_a: DataFrame, covered_b: DataFrame, known: DataFrame, params: VerbatimParams = VerbatimParams()) -> DataFrame:
    """The best B sentence of each A sentence that runs don't explain, if alike enough.

    Kinds are those that A's compared paragraphs have; a B sentence may serve several of A.
    """
    kinds = text_kinds(params.include_references)
    present = sents_a.where(F.col("kind").isin(kinds)).select(F.col("doc_id").alias("a_doc"), "kind").distinct()

    def eligible(sents: DataFrame, covered: DataFrame, side: str) -> DataFrame:
        rows = sents.select(F.col("doc_id").alias(f"{side}_doc"), "id", "kind", "text", "page").withColumn("toks", T.token_string(F.col("text")))
        rows = rows.where(F.size(T.tokenize(F.col("text"))) >= params.min_sentence_tokens)
        rows = pairs.select(*PAIR).join(without_boilerplate(rows, "toks", known), f"{side}_doc").join(present, ["a_doc", "kind"])
        rows = rows.join(covered, [*PAIR, "id"], "left").where(F.coalesce("covered", F.lit(0.0)) < 0.8)
        return rows.select(*PAIR, *[F.col(c).alias(f"{side}_{c}") for c in ("id", "text", "page", "toks")])

    sides = [stash(eligible(x, c, side), "eligible") for x, c, side in ((sents_a, covered_a, "a"), (sents_b, covered_b, "b"))]
    units = [x.select(*PAIR, F.col(f"{side}_id").alias("id"), F.col(f"{side}_toks").alias("toks")) for x, side in zip(sides, "ab", strict=True)]
    near = near_sentences(*units, PAIR, params.near_threshold)
    best = near.groupBy(*PAIR, "a_id").agg(F.max(F.struct("ratio", (-F.col("b_id")).alias("minus"))).alias("m"))
    best = best.select(*PAIR, "a_id", (-F.col("m.minus")).alias("b_id"), F.col("m.ratio").alias("ratio"))
    for x, side in zip(sides, "ab", strict=True):
        best = best.join(x.drop(f"{side}_toks"), [*PAIR, f"{side}_id"])
    return best.select(
        *PAIR, F.col("a_id").cast("int").alias("a_sentence"), F.col("b_id").cast("int").alias("b_sentence"), "a_text", "b_text", F.round("ratio", 1).alias("score"),
        F.when(F.col("ratio") >= params.exact_threshold, "exact").otherwise("near").alias("verdict"), "a_page", "b_page",
    )
