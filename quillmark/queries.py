"""Registered queries of the document-overlap engine, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import text as T
from .model import ExtractOptions, VerbatimParams
from .operators import figures as FG
from .operators import layout as L
from .operators import semantic as S
from .operators import verbatim as V
from .operators.alike import near_pairs
from .operators.shared import shared_of_classes
from .plans.stash import spread, stash
from .sources import cache, reports

FLAGSHIP = "shared_fingerprints"
Query = Callable[[SparkSession, str], DataFrame]
P = VerbatimParams()

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


# --- shared SQL -------------------------------------------------------------------


def _tok(name: str, table: str, key: str) -> str:
    return f"{name} as (select {key} d, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') t from {table})"


#: The CRC-32 table by its rule, and the checksum of a string's bytes.
_CRC_TABLE = "crc as (select list(c order by i) ct from (select i, list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) c from range(256) r(i)))"


def _kg(name: str, tok: str) -> str:
    return f"{name} as (select d, unnest(range(len(t) - 5)) p, t, len(t) - 5 n from {tok} where len(t) >= 6), {name}_g as (select d, p, n, array_to_string(t[p + 1:p + 6], ' ') g from {name})"


def _crc(grams: str) -> str:
    step = "xor(a >> 8, ct[(xor(a, x) & 255)::int + 1])"
    return f"hashed as (select g, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, len(hex(g)) // 2), lambda i: ('0x' || substr(hex(g), (2 * i + 1)::int, 2))::ubigint)), lambda a, x: {step}), 4294967295::ubigint)::bigint h from (select distinct g from {grams}), crc)"


def _fp(name: str, kg: str) -> str:
    return f"{name} as (select distinct d, (m).h h, -(m).np p from (select d, p, n, min(struct_pack(h := h, np := -p)) over (partition by d order by p rows between current row and 3 following) m from {kg}_g join hashed using (g)) where p <= greatest(n - 4, 0)), {name}_u as (select d, h, list(p order by p) ps from {name} group by d, h having count(*) <= 50)"


_DOCS_FP = f"with {_tok('tk', 'documents', 'doc_id')}, {_CRC_TABLE}, {_kg('kg', 'tk')}, {_crc('kg_g')}, {_fp('fp', 'kg')}"
_BOTH_FP = (
    f"with recursive {_tok('tka', 'benchmark', 'item_id')}, {_tok('tkb', 'documents', 'doc_id')}, {_CRC_TABLE}, {_kg('kga', 'tka')}, {_kg('kgb', 'tkb')}, "
    f"gs as (select g from kga_g union all select g from kgb_g), {_crc('gs')}, {_fp('fa', 'kga')}, {_fp('fb', 'kgb')}"
)
_RUNS = """, sd as (select x.d a, y.d b, unnest(x.ps) i, y.ps q from fa_u x join fb_u y using (h)), sd2 as (select distinct a, b, i, unnest(q) j from sd),
mt as (select a, b, x.p i, y.p j from (select distinct a, b from sd2) join kga_g x on x.d = a join kgb_g y on y.d = b and x.g = y.g),
isl as (select a, b, i - j dg, min(i) lo, max(i) hi from (select *, i - row_number() over (partition by a, b, i - j order by i) k from mt) group by a, b, i - j, k),
rs as (select distinct isl.a, isl.b, lo a0, hi + 6 a1, lo - dg b0, hi - dg + 6 b1 from isl join sd2 on sd2.a = isl.a and sd2.b = isl.b and sd2.i - sd2.j = dg and sd2.i between lo and hi)"""
_FOLD = """, num as (select *, row_number() over (partition by a, b order by a0, a1, b0, b1) r from rs),
fold as (select a, b, r, a0, a1, b0, b1, a0 s0, a1 s1, b0 t0, b1 t1, 1 g from num where r = 1
union all
select n.a, n.b, n.r, n.a0, n.a1, n.b0, n.b1,
 case when jn then s0 when ins then s0 else n.a0 end, case when jn then greatest(s1, n.a1) when ins then s1 else n.a1 end,
 case when jn then t0 when ins then t0 else n.b0 end, case when jn then greatest(t1, n.b1) when ins then t1 else n.b1 end,
 case when jn or ins then g else g + 1 end
from (select n.*, f.s0, f.s1, f.t0, f.t1, f.g,
 n.a0 - f.s1 between -1 and 3 and n.b0 - f.t1 between -1 and 3 and abs((n.a0 - f.s1) - (n.b0 - f.t1)) <= 3 jn,
 n.a0 < f.s1 and n.b0 < f.t1 ins from fold f join num n on n.a = f.a and n.b = f.b and n.r = f.r + 1) n),
mg as (select a, b, s0 a0, max(s1) a1, t0 b0, max(t1) b1 from fold group by a, b, g, s0, t0)"""


#: Runs that are long enough, no boilerplate and alike enough; the common subsequence by its table, a row for each character of B.
_SCORED = (
    """, lg as (select mg.*, array_to_string(x.t[a0 + 1:a1], ' ') sa, array_to_string(y.t[b0 + 1:b1], ' ') sb from mg join tka x on x.d = a join tkb y on y.d = b where a1 - a0 >= 12),
ok as (select * from lg where not exists (select 1 from (select unnest([""" + ", ".join(f"'{p}'" for p in V.BOILERPLATE) + """]) p) where contains(p, sa))),
lcs as (select sa, sb, 0 k, list_transform(range(length(sa) + 1), lambda x: 0) r from (select distinct sa, sb from ok where sa <> sb)
union all
select sa, sb, k + 1, list_transform(range(1, length(sa) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda i: case when i > 1 and sa[i - 1] = sb[k + 1] then r[i - 1] + 1 else r[i] end))) from lcs where k < length(sb)),
rt as (select ok.*, case when ok.sa = ok.sb then 100.0::double else 200.0::double * r[-1] / (length(ok.sa) + length(ok.sb)) end ratio from ok left join lcs on lcs.sa = ok.sa and lcs.sb = ok.sb and lcs.k = length(ok.sb)),
sc as (select *, row_number() over (partition by a, b order by a0, a1, b0, b1) - 1 run_id from rt where ratio >= 85)"""
)


# --- tokens and fingerprints ------------------------------------------------------


@query(f"with {_tok('tk', 'documents', 'doc_id')} select d doc_id, (unnest(range(len(t))))::int pos, unnest(t) tok from tk")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tokens(V.plain_streams(_docs(spark, sf_dir))).select("doc_id", "pos", "tok")


@query(f"with {_tok('tk', 'documents', 'doc_id')} select d doc_id, len(t)::bigint n_tokens, len(list_distinct(t))::bigint n_distinct from tk")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = T.tokenize(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_distinct"))


@query(f"with {_tok('tk', 'documents', 'doc_id')}, {_kg('kg', 'tk')} select g gram, count(*)::bigint n, count(distinct d)::bigint docs from kg_g group by 1")
def kgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = V.kgrams(V.plain_streams(_docs(spark, sf_dir)), P.kgram)
    per_doc = grams.groupBy("gram", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"{_DOCS_FP} select d doc_id, h, p::bigint pos from fp")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.fingerprints(V.plain_streams(_docs(spark, sf_dir))).select("doc_id", "h", F.col("pos").cast("long").alias("pos"))


@query(f"{_DOCS_FP} select d doc_id, h, count(*)::bigint n from fp group by d, h having count(*) > 50")
def hot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = V.fingerprints(V.plain_streams(_docs(spark, sf_dir)))
    return prints.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where(F.col("n") > P.max_fingerprint_positions)


@query(f"{_DOCS_FP} select h, count(*)::bigint docs, sum(len(ps))::bigint places from fp_u group by h")
def fingerprint_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = V.usable(V.fingerprints(V.plain_streams(_docs(spark, sf_dir))))
    return prints.groupBy("h").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("places"))


@query(
    f"{_DOCS_FP}, cl as (select d, min(d) over (partition by t) rep, count(*) over (partition by t) copies from tk where len(t) > 0), fr as (select fp_u.*, copies from fp_u join cl using (d) where d = rep) "
    "select x.d a_doc, y.d b_doc, any_value(x.copies)::bigint a_copies, any_value(y.copies)::bigint b_copies, count(*)::bigint shared, sum(len(x.ps) * len(y.ps))::bigint places from fr x join fr y on x.h = y.h and x.d < y.d group by x.d, y.d"
)
def shared_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of token streams that share a fingerprint, each with its least document; ``document_classes`` has the members."""
    return shared_of_classes(_docs(spark, sf_dir))


@query(f"with {_tok('tk', 'documents', 'doc_id')} select d doc_id, min(d) over (partition by t) representative from tk where len(t) > 0")
def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least document with the same tokens, for every document that has any."""
    streams = V.plain_streams(_docs(spark, sf_dir)).where(F.size("toks") > 0).withColumn("key", V.stream_key(F.col("toks")))
    members = streams.select("doc_id", "key")
    return members.join(members.groupBy("key").agg(F.min("doc_id").alias("representative")), "key").select("doc_id", "representative")


# --- runs: benchmark items against documents --------------------------------------


class _Verbatim:
    """The verbatim layer over two collections, its stages written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.known = V.phrases(spark)
        self.sa, self.sb = (stash(V.plain_streams(d), "streams") for d in (_items(spark, sf_dir), _docs(spark, sf_dir)))
        self.seeds = stash(V.seeds(V.usable(V.fingerprints(self.sa)), V.usable(V.fingerprints(self.sb))), "seeds")
        self.pairs = self.seeds.select(*V.PAIR).distinct()
        self.exact = V.exact_runs(self.sa, self.sb, self.seeds, P.kgram)

    def merged(self) -> DataFrame:
        return V.merge_runs(self.exact, P.max_gap)

    def scored(self) -> DataFrame:
        return stash(V.score_runs(self.merged(), self.sa, self.sb, self.known), "runs")


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.select("a_doc", "b_doc", *[F.col(n).cast("long").alias(n) for n in names])


@query(f"{_BOTH_FP}{_RUNS} select a a_doc, b b_doc, a0::bigint a0, a1::bigint a1, b0::bigint b0, b1::bigint b1 from rs")
def exact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_Verbatim(spark, sf_dir).exact, "a0", "a1", "b0", "b1")


@query(f"{_BOTH_FP}{_RUNS} select a a_doc, b b_doc, max(a1 - a0)::bigint longest, count(*)::bigint runs from rs group by 1, 2")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Verbatim(spark, sf_dir).exact.groupBy("a_doc", "b_doc").agg(F.max(F.col("a1") - F.col("a0")).cast("long").alias("longest"), F.count("*").alias("runs"))


@query(f"{_BOTH_FP}{_RUNS}{_FOLD} select a a_doc, b b_doc, a0::bigint a0, a1::bigint a1, b0::bigint b0, b1::bigint b1 from mg")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_Verbatim(spark, sf_dir).merged(), "a0", "a1", "b0", "b1")


@query(
    f"{_BOTH_FP}{_RUNS}{_FOLD}, lg as (select * from mg where a1 - a0 >= 12), "
    "ca as (select a, b, count(distinct x) c from (select a, b, unnest(range(a0, a1)) x from lg) group by 1, 2), cb as (select a, b, count(distinct x) c from (select a, b, unnest(range(b0, b1)) x from lg) group by 1, 2) "
    "select ca.a a_doc, ca.b b_doc, len(tka.t)::bigint tokens_a, len(tkb.t)::bigint tokens_b, ca.c::bigint covered_a, cb.c::bigint covered_b, "
    "round(ca.c / len(tka.t), 6) coverage_a, round(cb.c / len(tkb.t), 6) coverage_b from ca join cb using (a, b) join tka on tka.d = ca.a join tkb on tkb.d = ca.b"
)
def long_run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by merged runs of twelve tokens and more, before they are scored."""
    v = _Verbatim(spark, sf_dir)
    runs = stash(v.merged().where(F.col("a1") - F.col("a0") >= P.min_run), "long")
    found = V.coverage(runs.select(*V.PAIR).distinct(), runs, v.sa, v.sb)
    names = [F.col(c).cast("long").alias(c) for c in ("tokens_a", "tokens_b", "covered_a", "covered_b")]
    return found.select("a_doc", "b_doc", *names, F.round("coverage_a", 6).alias("coverage_a"), F.round("coverage_b", 6).alias("coverage_b"))


@query(
    f"{_BOTH_FP}{_RUNS}{_FOLD}{_SCORED} select a a_doc, b b_doc, run_id::int run_id, a0::int a0, a1::int a1, b0::int b0, b1::int b1, sa a_tokens, sb b_tokens, round(ratio, 1) score, case when ratio >= 100 then 'exact' else 'near' end verdict from sc"
)
def scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Verbatim(spark, sf_dir).scored().drop("ta", "tb")


@query(
    f"{_BOTH_FP}{_RUNS}{_FOLD}{_SCORED}, ps as (select distinct a, b from sd2), ca as (select a, b, count(distinct x) c from (select a, b, unnest(range(a0, a1)) x from sc) group by 1, 2), cb as (select a, b, count(distinct x) c from (select a, b, unnest(range(b0, b1)) x from sc) group by 1, 2), "
    "rr as (select a, b, count(*) n, max(a1 - a0) mx from sc group by 1, 2) "
    "select ps.a a_doc, ps.b b_doc, len(tka.t)::int tokens_a, coalesce(ca.c, 0)::bigint covered_a, len(tkb.t)::int tokens_b, coalesce(cb.c, 0)::bigint covered_b, coalesce(mx, 0)::int longest_run, coalesce(n, 0)::bigint runs, "
    "coalesce(ca.c, 0) / len(tka.t) coverage_a, coalesce(cb.c, 0) / len(tkb.t) coverage_b from ps join tka on tka.d = ps.a join tkb on tkb.d = ps.b left join ca using (a, b) left join cb using (a, b) left join rr using (a, b)"
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _Verbatim(spark, sf_dir)
    return V.coverage(v.pairs, v.scored(), v.sa, v.sb)


def _line_paragraphs(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("id", "raw"))
    return lines.select("doc_id", "id", F.lit("body").alias("kind"), T.normalize(F.col("raw")).alias("text"), F.lit(0).alias("page")).where("text <> ''")


def _sentences(paras: DataFrame) -> DataFrame:
    found = paras.select("doc_id", F.col("id").alias("para"), "kind", "page", F.posexplode(T.split_sentences("text")).alias("nth", "s"))
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("para", "nth")) - 1).alias("id")
    return found.select("doc_id", number, "para", "kind", "page", F.col("s.text").alias("text"), F.struct("s.start", "s.end").alias("span"))


@query()
def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near sentences of all items and all documents, lines as paragraphs.

    Pairs are those with sentences alike enough, shared fingerprints or none; only their documents go on to runs.
    """
    known, items = V.phrases(spark), _items(spark, sf_dir)
    pa = stash(_line_paragraphs(items), "paragraphs")
    xa = stash(_sentences(pa), "sentences")
    asked = xa.where(F.size(T.tokenize(F.col("text"))) >= P.min_sentence_tokens).select("doc_id", T.token_string(F.col("text")).alias("toks"))
    asked = V.without_boilerplate(asked, "toks", known)
    pairs = stash(near_pairs(asked, _docs(spark, sf_dir), P.min_sentence_tokens, P.near_threshold), "pairs")
    met = _docs(spark, sf_dir).join(pairs.select(F.col("b_doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pb = stash(_line_paragraphs(met), "paragraphs")
    xb = stash(_sentences(pb), "sentences")
    sa, sb = (stash(V.streams(p), "streams") for p in (pa, pb))
    seeds = V.seeds(V.usable(V.fingerprints(sa)), V.usable(V.fingerprints(sb))).join(pairs, V.PAIR, "left_semi")
    runs = stash(V.score_runs(V.merge_runs(V.exact_runs(sa, sb, stash(seeds, "seeds"))), sa, sb, known), "runs")
    covered = (V.sentence_coverage(x, s, runs, side) for x, s, side in ((xa, sa, "a"), (xb, sb, "b")))
    return V.sentence_pairs(pairs, xa, xb, *covered, known)


@query(
    "with ph as (select unnest([" + ", ".join(f"'{p}'" for p in V.BOILERPLATE) + "]) p) select doc_id, n::bigint pos, l phrase from "
    "(select doc_id, unnest(ls) raw, unnest(range(len(ls))) n, array_to_string(regexp_extract_all(lower(unnest(ls)), '[\\p{L}\\p{N}]+'), ' ') l from (select doc_id, string_split(text, chr(10)) ls from documents)) "
    "where not exists (select 1 from ph where contains(p, l))"
)
def lines_without_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    rows = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), T.token_string(F.col("raw")).alias("phrase"))
    return V.without_boilerplate(rows, "phrase", V.phrases(spark)).select("doc_id", "pos", "phrase")


# --- text -------------------------------------------------------------------------


def _normal(t: str) -> str:
    """SQL of ``normalize`` for a text that has no compatibility characters but ligatures; a joined word's letter can't end another break."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    t = f"translate({t}, {quoted(''.join(T.ONE_TO_ONE))}, {quoted(''.join(T.ONE_TO_ONE.values()))})"
    for glyph, letters in [*((g, "") for g in T.DELETED), *T.LIGATURES.items()]:
        t = f"replace({t}, '{glyph}', '{letters}')"
    space = "[\\s\\x0B]"
    t = f"regexp_replace(nfc_normalize({t}), '([\\p{{L}}\\p{{N}}_])-{space}*\\n{space}*([a-z])', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '{space}*\\n{space}*', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, '[ \\t\\r\\f\\x0B]+', ' ', 'g'), '^{space}+|{space}+$', '', 'g')"


@query(f"select doc_id, {_normal('text')} text from documents")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("text"))


@query("select doc_id, (unnest(range(len(ls))))::bigint para, unnest(ls) line from (select doc_id, string_split(text, chr(10)) ls from documents)")
def line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "line"))
    return lines.select("doc_id", F.col("para").cast("long").alias("para"), "line")


_CLOSE = """[.!?]+["'')\\]]*$"""


@query(
    f"with ln as (select doc_id, para, {_normal('raw')} t from (select doc_id, unnest(ls) raw, unnest(range(len(ls))) para from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents))), "
    "wd as (select doc_id, para, unnest(w) w, unnest(range(len(w))) i from (select doc_id, para, string_split(t, ' ') w from ln where t <> '')), "
    f"""br as (select *, lower(rtrim(regexp_replace(w, '{_CLOSE}', ''), '.!?"'')]')) bare, lead(w) over (partition by doc_id, para order by i) nx from wd), """
    f"""ct as (select *, (regexp_matches(w, '{_CLOSE}') and regexp_matches(nx, '^["''(\\[]?[A-Z0-9]') and not regexp_matches(bare, '^\\p{{L}}$') and bare not in ({', '.join(f"'{x}'" for x in sorted(T.ABBREVIATIONS))}))::int cut from br), """
    "nm as (select *, coalesce(sum(cut) over (partition by doc_id, para order by i rows between unbounded preceding and 1 preceding), 0) nth, coalesce(sum(length(w) + 1) over (partition by doc_id, para order by i rows between unbounded preceding and 1 preceding), 0) ahead from ct), "
    "st as (select doc_id, para, nth, string_agg(w, ' ' order by i) text, min(ahead) start from nm group by 1, 2, 3) "
    "select doc_id, (row_number() over (partition by doc_id order by para, nth) - 1)::int id, para::int para, 'body' kind, 0::int page, text, start::int start, (start + length(text))::int stop from st"
)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sentences(_line_paragraphs(_docs(spark, sf_dir)))
    return found.select("doc_id", "id", "para", "kind", "page", "text", F.col("span.start").alias("start"), F.col("span.end").alias("stop"))


@query(
    "select source, regexp_replace(lower(l), '\\p{Nd}+', '#', 'g') key, count(distinct doc_id)::bigint docs from (select source, doc_id, unnest(string_split(text, chr(10))) l from documents) group by 1, 2 having count(distinct doc_id) >= 3"
)
def repeated_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur, numbers apart, in three documents of a source: the running-header rule."""
    lines = _table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("l"))
    keys = lines.select("source", "doc_id", F.regexp_replace(F.lower("l"), r"\p{Nd}+", "#").alias("key")).distinct()
    return keys.groupBy("source", "key").agg(F.count("*").alias("docs")).where("docs >= 3")


@query()
def difference_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item against the item before it."""
    items = _items(spark, sf_dir)
    prior = items.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before"))
    return items.join(prior, "doc_id").withColumn("m", T.diff_marks("before", "text")).select("doc_id", "m.a_html", "m.b_html")


# --- layout -----------------------------------------------------------------------


# The driver's tables have no page boxes, so documents are laid out by a rule that Spark and SQL share: the lines of a
# text, cleaned of what normalisation would change, follow one another as blocks, 16 a page; size, boldness and place
# follow from a line's length and number.  Blocks of the first document of the fixtures come beside them.

_LINES = 16  # blocks a page
_CLEAN = "[^A-Za-z0-9.,:!?()]+"


def _laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, page, block_no, h, x0, y0, x1, y1, size, bold, text`` of all documents and of the fixture's."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    lines = lines.select("doc_id", "n", F.btrim(F.regexp_replace("raw", _CLEAN, " ")).alias("text")).where("text <> ''").withColumn("k", F.length("text"))
    at = F.col("n") % _LINES
    size = F.when(F.col("k") % 5 == 0, 14.0).when(F.col("k") % 7 == 0, 11.0).otherwise(9.0)
    x0 = (54 + 10 * (F.col("n") % 3)).cast("double")
    rows = lines.select(
        "doc_id", F.floor(F.col("n") / _LINES).cast("int").alias("page"), at.cast("int").alias("block_no"), F.lit(792.0).alias("h"), x0.alias("x0"), (20 + 47 * at).cast("double").alias("y0"),
        (x0 + F.least(F.lit(4) * F.col("k"), F.lit(480))).alias("x1"), (32 + 47 * at).cast("double").alias("y1"), size.alias("size"), F.when(F.col("k") % 11 == 0, F.col("k")).otherwise(0).cast("int").alias("bold"), "text",
    )
    fixed = spark.createDataFrame(X.BLOCKS, "doc_id long, page int, block_no int, h double, x0 double, y0 double, x1 double, y1 double, size double, bold int, text string")
    return rows.union(fixed.withColumn("doc_id", -F.col("doc_id")))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _laid_out(spark, sf_dir)
    box = F.struct("x0", "y0", "x1", "y1")
    n = F.length("text")
    line = F.struct(F.col("text"), box.alias("bbox"), F.array(F.struct("size", n.alias("n"))).alias("sizes"), F.col("bold").alias("bold_chars"), n.alias("chars"))
    return stash(rows.select("doc_id", "page", "block_no", F.col("h").alias("page_height"), box.alias("bbox"), F.array(line).alias("lines")), "blocks")


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster figure over every page's block 4 and a vector one that frames it or stands alone; and the fixture's."""
    pages = _laid_out(spark, sf_dir).where("doc_id >= 0").select("doc_id", "page").distinct()
    drawn = lambda nth, kind, x0, y0, x1, y1: F.struct((2 * F.col("page") + nth).cast("int").alias("id"), *[F.lit(float(v)).alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))], F.lit(kind).alias("kind"))
    both = F.array(drawn(0, "raster", 60, 205, 300, 255), F.when(F.col("page") % 2 == 0, drawn(1, "vector", 50, 200, 310, 260)).otherwise(drawn(1, "vector", 50, 340, 420, 430)))
    rows = pages.select("doc_id", "page", F.explode(both).alias("f")).select("doc_id", "f.id", "page", "f.x0", "f.y0", "f.x1", "f.y1", "f.kind")
    fixed = spark.createDataFrame(X.FIGURES, "doc_id long, id int, page int, x0 double, y0 double, x1 double, y1 double, kind string")
    rows = rows.union(fixed.withColumn("doc_id", -F.col("doc_id")))
    return rows.select("doc_id", "id", "page", F.struct("x0", "y0", "x1", "y1").alias("bbox"), "kind")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid_out(spark, sf_dir).groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))


_B = f"""with ln as (select doc_id, n, trim(regexp_replace(raw, '{_CLEAN}', ' ', 'g')) text from (select doc_id, unnest(ls) raw, unnest(range(len(ls))) n from (select doc_id, string_split(text, chr(10)) ls from documents))),
b as (select doc_id, (n // {_LINES})::int page, (n % {_LINES})::int block_no, 792.0::double h, (54 + 10 * (n % 3))::double x0, (20 + 47 * (n % {_LINES}))::double y0, (54 + 10 * (n % 3) + least(4 * length(text), 480))::double x1,
 (32 + 47 * (n % {_LINES}))::double y1, case when length(text) % 5 = 0 then 14.0 when length(text) % 7 = 0 then 11.0 else 9.0 end::double size, case when length(text) % 11 = 0 then length(text) else 0 end::int bold, text from ln where text <> ''
 union all select -doc_id, page, block_no, h, x0, y0, x1, y1, size, bold, text from {X.values(X.BLOCKS)} t(doc_id, page, block_no, h, x0, y0, x1, y1, size, bold, text)),
pp as (select distinct doc_id, page from b where doc_id >= 0),
f as (select doc_id, (2 * page)::int id, page, 60.0::double x0, 205.0::double y0, 300.0::double x1, 255.0::double y1, 'raster' kind from pp
 union all select doc_id, (2 * page + 1)::int, page, 50.0, case when page % 2 = 0 then 200.0 else 340.0 end, case when page % 2 = 0 then 310.0 else 420.0 end, case when page % 2 = 0 then 260.0 else 430.0 end, 'vector' from pp
 union all select -doc_id, id, page, x0, y0, x1, y1, kind from {X.values(X.FIGURES)} t(doc_id, id, page, x0, y0, x1, y1, kind)),
pg as (select doc_id, max(page) + 1 n_pages from b group by 1)"""
_OVER = "greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) / greatest(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0), 1e-6)"


@query(f"{_B} select doc_id::bigint doc_id, size::double body_size from (select doc_id, size, row_number() over (partition by doc_id order by sum(length(text)) desc, min(page * 1000 + block_no)) r from b group by 1, 2) where r = 1")
def body_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.body_font_size(_blocks(spark, sf_dir))


@query(f"{_B} select doc_id::bigint doc_id, page::int page, block_no::int block_no, size::double mean_size, round(bold / length(text), 6) bold, length(text)::int n_chars from b")
def block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.block_stats(_blocks(spark, sf_dir)).select("doc_id", "page", "block_no", "mean_size", F.round("bold", 6).alias("bold"), F.col("n_chars").cast("int").alias("n_chars"))


_MARGIN = f"{_B}, m as (select *, y1 < 0.08 * h or y0 > 0.92 * h mg, regexp_replace(lower(text), '[0-9]+', '#', 'g') key from b), hf as (select m.doc_id, key from m join pg using (doc_id) where mg and n_pages >= 2 group by m.doc_id, key, n_pages having count(distinct page) >= case when n_pages >= 3 then 3 else 2 end), kp as (select m.* from m where not (mg and (regexp_matches(text, '(?i)^\\s*(page\\s*)?\\d{{1,4}}(\\s*(of|/)\\s*\\d{{1,4}})?\\s*$') or exists (select 1 from hf where hf.doc_id = m.doc_id and hf.key = m.key))))"


@query(f"{_MARGIN} select doc_id::bigint doc_id, key from hf")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.running_headers(_blocks(spark, sf_dir), _pages(spark, sf_dir))


_CLASS = f"""{_MARGIN}, tk as (select *, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) nt from kp where regexp_matches(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}}')),
lb as (select tk.* from tk where not exists (select 1 from f where f.kind = 'vector' and f.doc_id = tk.doc_id and f.page = tk.page and nt <= 8 and {_OVER.format(a='tk', b='f')} > 0.8)),
bs as (select doc_id, size bsz from (select doc_id, size, row_number() over (partition by doc_id order by sum(length(text)) desc, min(page * 1000 + block_no)) r from b group by 1, 2) where r = 1),
hd as (select lb.*, nt <= 15 and (size >= bsz * 1.15 or bold / length(text) > 0.8 or regexp_matches(text, '^(\\d+(\\.\\d+)*\\.?|[IVX]+\\.?|[A-Z]\\.)\\s+[A-Z]')) ih, regexp_matches(text, '(?i)^(fig\\.?|figure|table|tab\\.?|listing|algorithm)\\s*\\d+') cp from lb join bs using (doc_id)),
st as (select *, ih and not cp hh, regexp_matches(text, '(?i)^(\\d+\\.?\\s*|[ivx]+\\.\\s*)?(references|bibliography)\\s*$') rf, regexp_matches(text, '(?i)^abstract\\s*$') ab from hd),
wd as (select *, last_value(case when hh then rf end ignore nulls) over o inr, last_value(case when hh then ab end ignore nulls) over o ina, sum(hh::int) over o sec from st window o as (partition by doc_id order by page, block_no)),
kd as (select *, case when cp then 'caption' when hh then 'heading' when coalesce(inr, false) then 'reference'
 when (coalesce(ina, false) and sum((not hh and not cp)::int) over (partition by doc_id, sec order by page, block_no) = 1) or (regexp_matches(text, '(?i)^abstract\\b') and nt >= 20) then 'abstract' else 'body' end kind from wd),
un as (select * from kd where not (hh and rf))"""


@query(f"{_CLASS} select doc_id::bigint doc_id, page::int page, block_no::int block_no, text, nt::int ntok, kind, ih is_heading from un")
def classified_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classify(_blocks(spark, sf_dir), _figures(spark, sf_dir), _pages(spark, sf_dir)).select("doc_id", "page", "block_no", "text", "ntok", "kind", "is_heading")


@query(f"{_CLASS} select doc_id::bigint doc_id, coalesce(max(case when r = 1 then text end), '') title from (select doc_id, text, ok, row_number() over (partition by doc_id, ok order by size desc, block_no) * ok r from (select *, (page = 0 and ih and nt >= 3)::int ok from un)) group by 1")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.titles(L.classify(_blocks(spark, sf_dir), _figures(spark, sf_dir), _pages(spark, sf_dir)))


@query(
    f"{_CLASS}, nr as (select *, not coalesce(kind = 'body' and lag(kind) over o = 'body' and not regexp_matches(lag(text) over o, '[.!?:]$') and regexp_matches(text, '^\\p{{Ll}}'), false) nw from un where kind <> 'reference' window o as (partition by doc_id order by page, block_no)), "
    "gp as (select *, sum(nw::int) over (partition by doc_id order by page, block_no) - 1 id from nr) select doc_id::bigint doc_id, id::int id, first(kind order by page, block_no) kind, string_agg(text, ' ' order by page, block_no) text, first(page order by page, block_no)::int page, count(*)::int n_lines from gp group by 1, 2"
)
def merged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = L.paragraphs(L.classify(_blocks(spark, sf_dir), _figures(spark, sf_dir), _pages(spark, sf_dir)))
    return paras.select("doc_id", "id", "kind", "text", "page", F.size("lines").alias("n_lines"))


@query(
    f"{_B}, c as (select doc_id, page, block_no id, text, x0, y0, x1, y1 from b where regexp_matches(text, '(?i)^(fig\\.?|figure|table|tab\\.?|listing|algorithm)\\s*\\d+')), "
    "g as (select f.doc_id, f.id, c.text, c.id cid, case when c.y0 - f.y1 >= -5 then c.y0 - f.y1 when f.y0 - c.y1 >= -5 then f.y0 - c.y1 + 20 end gap from f join c on c.doc_id = f.doc_id and c.page = f.page and least(c.x1, f.x1) - greatest(c.x0, f.x0) > 0), "
    "r as (select *, row_number() over (partition by doc_id, id order by gap, cid) k from g where gap >= 0 and gap < 80) select f.doc_id::bigint doc_id, f.id::int id, coalesce(r.text, '') caption from f left join r on r.doc_id = f.doc_id and r.id = f.id and k = 1"
)
def captioned_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = L.paragraphs(L.classify(_blocks(spark, sf_dir), _figures(spark, sf_dir), _pages(spark, sf_dir)))
    return L.attach_captions(_figures(spark, sf_dir), paras).select("doc_id", "id", "caption")


@query(f"{_B} select f.doc_id::bigint doc_id, f.id::int id, f.kind from f where not (f.kind = 'vector' and exists (select 1 from f r where r.kind = 'raster' and r.doc_id = f.doc_id and r.page = f.page and ({_OVER.format(a='f', b='r')} > 0.8 or {_OVER.format(a='r', b='f')} > 0.8))) and f.x1 - f.x0 >= 40 and f.y1 - f.y0 >= 40 and (f.x1 - f.x0) * (f.y1 - f.y0) <= 0.9 * 612 * 792")
def allowed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = L.without_frames(_figures(spark, sf_dir)).where(L.figure_allowed(F.col("bbox"), F.lit(612.0), F.lit(792.0)))
    return kept.select("doc_id", "id", "kind")


@query(f"{_B} select b.doc_id::bigint doc_id, b.page::int page, b.block_no::int block_no, f.id::int id, round({_OVER.format(a='b', b='f')}, 6) share from b join f on f.doc_id = b.doc_id and f.page = b.page where {_OVER.format(a='b', b='f')} > 0")
def rectangle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    figs = _figures(spark, sf_dir).select("doc_id", "page", "id", F.col("bbox").alias("fig"))
    both = _blocks(spark, sf_dir).join(figs, ["doc_id", "page"]).withColumn("share", L.overlap_share(F.col("bbox"), F.col("fig")))
    return both.where("share > 0").select("doc_id", "page", "block_no", "id", F.round("share", 6).alias("share"))


@query(
    f"with wd as (select doc_id, n, unnest(ws) w, unnest(range(len(ws))) i from (select doc_id, n, string_split(trim(regexp_replace(raw, '{_CLEAN}', ' ', 'g')), ' ') ws from (select doc_id, unnest(ls) raw, unnest(range(len(ls))) n from (select doc_id, string_split(text, chr(10)) ls from documents)))), "
    f"o as (select *, string_split(value, chr(9)) c from {X.values(X.OCR)} t(doc_id, page, line_no, value) union all select -1 - doc_id, 0, n * 10000 + i, '', [(case when w = '' then '4' else '5' end), '1', (n // 4 + 1)::varchar, '1', (n % 4 + 1)::varchar, (i + 1)::varchar, (300 + 90 * i)::varchar, (300 + 50 * n)::varchar, (10 * length(w))::varchar, '40', '96', w] from wd), w as (select doc_id, page, line_no, c[3]::int bl, c[4]::int pr, c[5]::int ln, trim(c[12]) word, c[7]::double x, c[8]::double y, c[9]::double wd, c[10]::double ht from o where len(c) >= 12 and c[1] = '5' and trim(c[12]) <> ''), "
    "l as (select doc_id, page, bl, pr, ln, string_agg(word, ' ' order by line_no) text, min(x) * 0.24 x0, min(y) * 0.24 y0, max(x + wd) * 0.24 x1, max(y + ht) * 0.24 y1 from w group by all) "
    "select doc_id::bigint doc_id, page::int page, (row_number() over (partition by doc_id, page order by bl, pr) - 1)::int block_no, string_agg(text, ' / ' order by ln) text, round(min(x0), 6) x0, round(min(y0), 6) y0, round(max(x1), 6) x1, round(max(y1), 6) y1 from l group by doc_id, page, bl, pr"
)
def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    found = lines.select("doc_id", "n", F.posexplode(F.split(F.btrim(F.regexp_replace("raw", _CLEAN, " ")), " ")).alias("i", "w"))
    cells = [F.when(F.col("w") == "", "4").otherwise("5"), F.lit(1), F.floor(F.col("n") / 4) + 1, F.lit(1), F.col("n") % 4 + 1, F.col("i") + 1, 300 + 90 * F.col("i"), 300 + 50 * F.col("n"), 10 * F.length("w"), F.lit(40), F.lit(96)]
    told = found.select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(0).alias("page"), (F.col("n") * 10000 + F.col("i")).alias("line_no"), F.concat_ws("\t", *[c.cast("string") for c in cells], "w").alias("value"))
    rows = told.union(spark.createDataFrame(X.OCR, "doc_id long, page int, line_no int, value string"))
    box = [F.round(f"bbox.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return L.ocr_blocks(rows).select("doc_id", "page", "block_no", F.array_join(F.transform("lines", lambda x: x.text), " / ").alias("text"), *box)


@query(f"{_B} select doc_id::bigint doc_id, page::int page, block_no::int block_no, round(x0 + (x1 - x0) * 2 / length(text), 6) x0, round(x0 + (x1 - x0) * least(9, length(text)) / length(text), 6) x1 from b where length(text) > 2")
def clipped_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of characters 2 to 9 of each block."""
    rows = L.join_lines(_blocks(spark, sf_dir)).withColumn("r", F.explode(V.clip_lines(F.col("spans"), F.lit(2), F.lit(9))))
    return rows.select("doc_id", "page", "block_no", F.round("r.bbox.x0", 6).alias("x0"), F.round("r.bbox.x1", 6).alias("x1"))


# --- semantic: vectors of a label against each other ------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of every label as two collections: those of even and of odd number."""
    rows = _table(spark, sf_dir, "embeddings")
    place = F.col("vec_id") % 2
    rows = rows.select(F.col("label").alias("a_doc"), F.col("label").alias("b_doc"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), place.alias("side"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = stash(rows.withColumn("vec", F.transform("vec", lambda x: x / norm(F.col("vec")))), "vectors")
    return rows.where("side = 1").drop("side"), rows.where("side = 0").drop("side")


_SIM = (
    "with e as (select label, vec_id id, embedding::double[] v, vec_id % 2 side from embeddings), "
    "s as (select a.label, a.id i, b.id j, round(list_cosine_similarity(a.v, b.v), 9) sim from e a join e b on a.label = b.label and a.side = 1 and b.side = 0), "
    "ra as (select label, i, arg_min(j, (-sim, j)) j, max(sim) sim from s group by 1, 2), rb as (select label, j, arg_min(i, (-sim, i)) i, max(sim) sim from s group by 1, 2) "
)


@query(_SIM + "select label::int label, i a_id, j b_id, round(sim, 6) sim from ra")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = S.nearest(*_vectors(spark, sf_dir)).where("left")
    return best.select(F.col("a_doc").alias("label"), F.col("id").alias("a_id"), F.col("other").alias("b_id"), F.round("sim", 6).alias("sim"))


@query(_SIM + "select ra.label::int label, ra.i a_id, ra.j b_id, round(ra.sim, 6) sim from ra join rb on ra.label = rb.label and ra.i = rb.i and ra.j = rb.j where ra.sim >= 0.3")
def mutual_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.matches(S.nearest(*_vectors(spark, sf_dir)), 0.3)
    return found.select(F.col("a_doc").alias("label"), "a_id", "b_id", F.round("sim", 6).alias("sim"))


@query(
    _SIM + ", ".join([""]) + "select ra.label::int label, count(*)::bigint n_a, any_value(nb)::bigint n_b, round(avg(sim), 4) mean_max_sim, round(avg((sim >= 0.4)::int), 4) fraction_matched_a, round(any_value(fb), 4) fraction_matched_b, "
    + ", ".join(f"count(*) filter (where least(floor(least(greatest(sim, 0), 1) * 10), 9) = {i})::bigint bin{i}" for i in range(10))
    + " from ra join (select label, count(*) nb, avg((sim >= 0.4)::int) fb from rb group by 1) using (label) group by 1"
)
def similarity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.statistics(S.nearest(*_vectors(spark, sf_dir)), 0.4)
    return got.select(F.col("a_doc").alias("label"), "n_a", "n_b", "mean_max_sim", "fraction_matched_a", "fraction_matched_b", *[F.get("histogram", F.lit(i)).alias(f"bin{i}") for i in range(10)])


@query(
    "with u as (select doc_id, length(text) n from documents where length(text) > 0), iv as (select doc_id, unnest([0, 10, 40]) s, unnest([20, 30, 90]) e from documents) "
    "select u.doc_id, round(sum(greatest(0, least(e, n) - greatest(s, 0))) / any_value(n), 6) covered from u join iv using (doc_id) group by 1"
)
def covered_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of three intervals, two overlapping, over the text's length."""
    docs = _docs(spark, sf_dir).where(F.length("text") > 0)
    units = docs.select("doc_id", F.lit(0).alias("id"), F.lit(0).alias("para"), F.struct(F.lit(0).alias("start"), F.length("text").alias("end")).alias("span"))
    cuts = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 20), (10, 30), (40, 90))])
    intervals = docs.select("doc_id", F.lit(0).alias("para"), F.inline(cuts))
    return S.covered_fraction(units, intervals).select("doc_id", F.round("covered", 6).alias("covered"))


# --- figures ----------------------------------------------------------------------


#: The signs of a 64-vector as the bits of a whole number: a stand-in for a perceptual hash.
SIGN_HASH = "aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"


@query(
    "with e as (select label, vec_id, embedding v from embeddings) select a.label::int label, a.vec_id a_id, b.vec_id b_id, "
    "(select count(*) from (select unnest(a.v) x, unnest(b.v) y) where (x > 0) <> (y > 0))::int distance from e a join e b on a.label = b.label and a.vec_id < b.vec_id "
    "where (select count(*) from (select unnest(a.v) x, unnest(b.v) y) where (x > 0) <> (y > 0)) <= 24"
)
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("label", "vec_id", F.expr(SIGN_HASH).alias("sign_hash"))
    a = rows.select("label", F.col("vec_id").alias("a_id"), F.col("sign_hash").alias("ha"))
    b = rows.select("label", F.col("vec_id").alias("b_id"), F.col("sign_hash").alias("hb"))
    both = a.join(b, "label").where("a_id < b_id").withColumn("distance", FG.hamming(F.col("ha"), F.col("hb")))
    return both.where(F.col("distance") <= 24).select("label", "a_id", "b_id", "distance")


@query(
    f"with h as (select * from {X.values(X.HASHES)} t(doc_id, id, sha, ph, dh, crop)), p as (select a.id a_id, b.id b_id, bit_count(xor(a.ph::bigint, b.ph::bigint))::int pd, bit_count(xor(a.dh::bigint, b.dh::bigint))::int dd, a.sha = b.sha sb, greatest(a.crop, b.crop)::double cr from h a join h b on a.doc_id = 1 and b.doc_id = 2), "
    "v as (select *, case when sb then 'exact' when pd <= 10 and dd <= 16 then 'same' when cr >= 0.85 then 'cropped' when pd <= 16 then 'similar' end verdict from p), "
    "r as (select *, row_number() over (partition by a_id order by list_position(['exact', 'same', 'cropped', 'similar'], verdict), pd, cr desc, b_id) rk from v where verdict is not null) "
    "select a_id::int a_id, b_id::int b_id, verdict, pd phash_distance, dd dhash_distance from r where rk = 1 or verdict <> 'similar'"
)
def figure_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(X.HASHES, "doc_id long, id int, sha string, ph long, dh long, crop double")
    side = lambda n, s: rows.where(F.col("doc_id") == n).select(F.col("doc_id").alias(f"{s}_doc"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "sha", "ph", "dh", "crop")])
    both = side(1, "a").join(side(2, "b"), F.lit(1) + F.col("a_doc") == F.col("b_doc"))
    both = both.withColumns({"phash_distance": FG.hamming(F.col("a_ph"), F.col("b_ph")), "dhash_distance": FG.hamming(F.col("a_dh"), F.col("b_dh")), "crop_ncc": F.greatest("a_crop", "b_crop")})
    quick = FG.quick_verdict(F.col("phash_distance"), F.col("dhash_distance"), F.col("a_sha") == F.col("b_sha"))
    verdict = F.coalesce(quick, F.when(F.col("crop_ncc") >= 0.85, "cropped").when(F.col("phash_distance") <= 16, "similar"))
    return FG.rank_candidates(both.withColumn("verdict", verdict).where("verdict is not null")).select("a_id", "b_id", "verdict", "phash_distance", "dhash_distance")


# --- results ----------------------------------------------------------------------


@query(
    f"{_BOTH_FP}{_RUNS}{_FOLD}, lg as (select mg.*, array_to_string(x.t[a0 + 1:a1], ' ') = array_to_string(y.t[b0 + 1:b1], ' ') ex, array_to_string(x.t[a0 + 1:a1], ' ') s from mg join tka x on x.d = a join tkb y on y.d = b where a1 - a0 >= 12), "
    "ok as (select * from lg where not exists (select 1 from (select unnest([" + ", ".join(f"'{p}'" for p in V.BOILERPLATE) + "]) p) where contains(p, s))), "
    "ps as (select distinct a, b from sd2), ca as (select a, b, count(distinct x) c from (select a, b, unnest(range(a0, a1)) x from ok) group by 1, 2), cb as (select a, b, count(distinct x) c from (select a, b, unnest(range(b0, b1)) x from ok) group by 1, 2), "
    "rr as (select a, b, count(*) n, count(*) filter (ex) e, max(a1 - a0) mx from ok group by 1, 2) "
    "select ps.a a_doc, ps.b b_doc, len(tka.t)::bigint tokens_a, len(tkb.t)::bigint tokens_b, round(coalesce(ca.c, 0) / len(tka.t), 4) coverage_a, round(coalesce(cb.c, 0) / len(tkb.t), 4) coverage_b, "
    "coalesce(mx, 0)::bigint longest_run, coalesce(n, 0)::bigint runs, coalesce(e, 0)::bigint exact_runs, coalesce(n - e, 0)::bigint near_runs "
    "from ps join tka on tka.d = ps.a join tkb on tkb.d = ps.b left join ca using (a, b) left join cb using (a, b) left join rr using (a, b)"
)
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of runs at any score, and coverage, of every pair that shares a fingerprint."""
    v = _Verbatim(spark, sf_dir)
    runs = stash(V.score_runs(v.merged(), v.sa, v.sb, v.known, VerbatimParams(near_threshold=0)), "runs")
    none = runs.select(*V.PAIR).where("false")
    found = reports.summary(v.pairs, V.coverage(v.pairs, runs, v.sa, v.sb), runs, none).drop("near_sentences")
    return found.select("a_doc", "b_doc", "coverage_a", "coverage_b", *[F.col(c).cast("long").alias(c) for c in ("tokens_a", "tokens_b", "longest_run", "runs", "exact_runs", "near_runs")])


@query(f"select doc_id, substr(sha256(text), 1, 16) || '-v2-{ExtractOptions().digest()}' cache_key from documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", cache.cache_key(F.sha2("text", 256), ExtractOptions()).alias("cache_key"))


@query(f"{_B} select doc_id::bigint a_doc, 2::bigint b_doc, page::int page, round(x0::double, 3) x0, round(y1::double, 3) y1, 'figure' layer, 'figure same: pHash ' || id || ', NCC 0.5; matches B p' || (page + 1) note from f where x1 - x0 >= 1 and y1 - y0 >= 1")
def figure_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    figs = _figures(spark, sf_dir).select(F.col("doc_id").alias("a_doc"), F.lit(2).cast("long").alias("b_doc"), F.lit("same").alias("verdict"), F.col("id").alias("phash_distance"), F.lit(0.5).alias("ncc"), F.col("page").alias("a_page"), F.col("page").alias("b_page"), F.col("bbox").alias("a_bbox"))
    return reports.marks("a", figures=figs).select("a_doc", "b_doc", "page", F.round("bbox.x0", 3).alias("x0"), F.round("bbox.y1", 3).alias("y1"), "layer", "note")
