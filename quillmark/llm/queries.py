"""Registered queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..plans.stash import spread
from . import decontaminate, language_id, lm_score, near_dup, piece_sampler, quality, sharding, suffix_dedup, token_store, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_docs(spark, sf_dir))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_store.write_blocks(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_blocks(*written).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("held_out", language_id.held_out(parts=5, part=1))
    vocab, tail = lm_score.fit(docs.where("not held_out"))
    return lm_score.score(docs, vocab, tail)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    langs, weights = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, langs, weights)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shuffle_into_shards(_docs(spark, sf_dir), 40))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.derivatives(warc.responses(pages)).drop("record")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
    return quality.assess(_docs(spark, sf_dir)).select(*names)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampler.round_trip(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array": op1_suffix_array,
        "op2_token_store": op2_token_store,
        "op3_lm_score": op3_lm_score,
        "op4_language_id": op4_language_id,
        "op5_decontaminate": op5_decontaminate,
        "op6_sharding": op6_sharding,
        "op7_warc": op7_warc,
        "op8_quality": op8_quality,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_minhash": op10_minhash,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') t"

#: Windows by their MD5; the earliest place of each, and runs of the later ones.
_OP1 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') t from documents),
win as (select doc_id, p, md5(array_to_string(t[p + 1:p + 50], ' ')) h from (select doc_id, t, unnest(range(0, len(t) - 49)) p from w where len(t) >= 50)),
f as (select doc_id, p, min({'d': doc_id, 'p': p}) over (partition by h) low from win),
r as (select doc_id, p, low.d first_doc, case when p - lag(p) over (partition by doc_id order by p) <= 50 then 0 else 1 end new from f where doc_id <> low.d or p <> low.p),
i as (select *, sum(new) over (partition by doc_id order by p) island from r)
select doc_id, min(p)::bigint start, (max(p) + 50)::bigint stop, (max(p) + 50 - min(p))::bigint n_words, arg_min(first_doc, p)::bigint first_doc_id from i group by doc_id, island
"""

#: Windows as strings, joined; words have no space, so a string is one window.
_OP5 = f"""
with iw as (select item_id, {_ALNUM} from benchmark where item_id is not null),
win as (select distinct item_id, least(10, len(t)) m, unnest(list_transform(range(0, len(t) - least(10, len(t)) + 1), lambda i: array_to_string(t[i + 1:i + least(10, len(t))], ' '))) w from iw where len(t) > 0),
dw as (select doc_id, {_ALNUM} from documents),
dat as (select doc_id, m, unnest(range(0, len(t) - m + 1)) p, t from dw, (select distinct m from win) where len(t) >= m),
hit as (select doc_id, p, dat.m, item_id from dat join win on win.m = dat.m and win.w = array_to_string(dat.t[p + 1:p + dat.m], ' ')),
n as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + m)) q from hit) group by 1),
i as (select doc_id, list_sort(list(distinct item_id::varchar)) items from hit group by 1)
select doc_id, len(t)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(len(items), 0)::bigint n_items,
  sha256(coalesce(array_to_string(items, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join n using (doc_id) left join i using (doc_id)
"""

#: All pairs that share a shingle, counted, and the closure of their links.
_OP10 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') t from documents),
sh as (select distinct doc_id, unnest(case when len(t) >= 5 then list_transform(range(0, len(t) - 4), lambda i: array_to_string(t[i + 1:i + 5], ' ')) when len(t) > 0 then [array_to_string(t, ' ')] else [] end) s from w),
n as (select doc_id, count(*) n from sh group by 1),
cnt as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from cnt join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id d, doc_id r from w union select reach.d, edge.b from reach join edge on edge.a = reach.r)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, c component_id, c = w.doc_id kept
from w left join n using (doc_id) join (select d, min(r) c from reach group by 1) on d = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force."""
    return {"op1_suffix_array": _OP1, "op5_decontaminate": _OP5, "op10_minhash": _OP10}
