"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good (1) or bad (-1) on a document or abstains (0).  Votes are counted by pattern, at
most 3**rules rows whatever the corpus, and expectation-maximisation over the pattern counts estimates
the share of good documents and, for every rule, how often it casts either vote on good and on bad ones.
That is its accuracy: a rule is as strong as those rates differ, and abstaining says nothing.
A document's posterior probability of being good replaces the test that all rules pass.  All rounds
of EM are one expression over the patterns in one row; texts are read once.

Three-word windows are told apart by a 64-bit hash within their document.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stash import stash

#: Fixed value: the white space that separates words, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]+"
ROUNDS = 25
START = {1: (0.8, 0.05), -1: (0.01, 0.3)}  # rates of a vote on good and on bad documents, before any are seen
LEAST = 1e-4  # no vote is taken to be rarer
THRESHOLD = 0.5


def _chars(pattern: str) -> Column:
    """Characters of the text in a class given by its complement."""
    return F.length(F.regexp_replace("_text", pattern, ""))


def features(docs: DataFrame) -> DataFrame:
    """Counts that base rules and votes use, beside the columns of ``docs``; null text has no words."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    bare = F.btrim(F.col("_text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    rows = rows.withColumn("_n", F.size("_words"))
    window = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 3),
        lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")),
    )
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("_sorted", F.when(F.col("_n") < 3, empty).otherwise(F.sort_array(window)))
    again = F.filter(
        "_sorted",
        lambda s, i: F.coalesce(s.h == F.get("_sorted", i - 1).h, F.lit(False)) | F.coalesce(s.h == F.get("_sorted", i + 1).h, F.lit(False)),
    )
    rows = rows.withColumn("_places", F.sort_array(F.transform(again, lambda s: s.i)))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a.n + F.least(F.lit(3), p - a["at"])).alias("n")),
        lambda a: a.n,
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_lines", lines)
    return rows.select(
        *docs.columns,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _chars(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _chars("[^A-Z]+").cast("long").alias("n_capitals"),
        _chars("[^0-9]+").cast("long").alias("n_digits"),
        _chars("[^.!?]+").cast("long").alias("n_ends"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    )


def votes() -> dict[str, Column]:
    """The rules, over the columns of ``features``.

    A sign of junk votes bad and its absence is no merit, so those rules abstain else; the merits of
    prose vote good together, for each alone is common in junk of another kind.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    bad = {
        "v_length": n < 50,
        "v_symbols": 10 * F.col("n_symbols") > n,
        "v_repeats": 10 * F.col("n_repeat_words") > 3 * n,
        "v_lines": (F.col("n_lines") >= 8) & (4 * F.col("n_dup_lines") > F.col("n_lines")),
        "v_word_length": (chars < 2 * n) | (chars > 12 * n),
        "v_capitals": 10 * F.col("n_capitals") > 4 * chars,
        "v_digits": 5 * F.col("n_digits") > chars,
        "v_ends": (n >= 30) & ((F.col("n_ends") == 0) | (2 * F.col("n_ends") > n)),
        "v_distinct": 5 * F.col("n_distinct") < n,
    }
    prose = (n >= 30) & (50 * F.col("n_ends") >= n) & (3 * F.col("n_ends") <= n) & (chars >= 3 * n) & (chars <= 9 * n)
    plain = (20 * F.col("n_symbols") <= n) & (100 * F.col("n_capitals") <= 20 * chars) & (10 * F.col("n_digits") <= chars)
    varied = (10 * F.col("n_repeat_words") <= 3 * n) & (20 * F.col("n_distinct") >= 3 * n)
    return {k: F.when((n > 0) & x, -1).otherwise(0) for k, x in bad.items()} | {"v_prose": F.when(prose & plain & varied, 1).otherwise(0)}


def base_failed() -> Column:
    """The two base rules of the contract."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Rates = dict[tuple[str, int], tuple[float, float]]


def posterior(names: list[str], share: float, rates: Rates) -> Column:
    """Probability of good given the vote columns; abstentions say nothing."""
    terms = [F.lit(math.log(share / (1 - share)))]
    for v in names:
        up, down = (math.log(rates[v, vote][0] / rates[v, vote][1]) for vote in (1, -1))
        terms.append(F.when(F.col(v) == 1, up).when(F.col(v) == -1, down).otherwise(0.0))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


_STATE = "struct<share:double,rates:array<struct<up_good:double,up_bad:double,down_good:double,down_bad:double>>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(items: Column, value) -> Column:
    return F.aggregate(F.transform(items, value), F.lit(0.0), lambda a, x: a + x)


def _round(state: Column, rules: int) -> Column:
    """The next parameters, from those in ``state`` and the column ``patterns``."""

    def scored(x: Column) -> Column:
        term = lambda v, r: F.when(v == 1, F.log(r.up_good / r.up_bad)).when(v == -1, F.log(r.down_good / r.down_bad)).otherwise(0.0)
        logit = F.log(state.share / (1 - state.share)) + F.aggregate(F.zip_with(x.v, state.rates, term), F.lit(0.0), lambda a, t: a + t)
        return _let(1 / (1 + F.exp(-logit)), lambda p: F.struct(x.v.alias("v"), (x.n * p).alias("good"), (x.n * (1 - p)).alias("bad")))

    def rate(rows: Column, j: Column, vote: int, kind: str, of: Column) -> Column:
        cast = _total(rows, lambda x: F.when(F.get(x.v, j) == vote, x[kind]).otherwise(0.0))
        return F.greatest(F.lit(LEAST), (cast + 10 * START[vote][kind == "bad"]) / (of + 10))

    def ordered(r: Column) -> Column:
        up, down = r.up_good >= r.up_bad, r.down_good <= r.down_bad
        mean = lambda ok, x, a, b: F.when(ok, x).otherwise((a + b) / 2)
        return F.struct(
            mean(up, r.up_good, r.up_good, r.up_bad).alias("up_good"), mean(up, r.up_bad, r.up_good, r.up_bad).alias("up_bad"),
            mean(down, r.down_good, r.down_good, r.down_bad).alias("down_good"), mean(down, r.down_bad, r.down_good, r.down_bad).alias("down_bad"),
        )

    def update(rows: Column, n: Column) -> Column:
        each = lambda j: F.struct(*[rate(rows, j, vote, kind, n[kind]).alias(f"{name}_{kind}") for name, vote in (("up", 1), ("down", -1)) for kind in ("good", "bad")])
        rates = F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), lambda j: _let(each(j), ordered))
        return F.struct(((n.good + 8.5) / (n.good + n.bad + 10)).alias("share"), rates.alias("rates")).cast(_STATE)

    sums = lambda rows: F.struct(_total(rows, lambda x: x.good).alias("good"), _total(rows, lambda x: x.bad).alias("bad"))
    return _let(F.transform("patterns", scored), lambda rows: _let(sums(rows), lambda n: update(rows, n)))


def estimate(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, Rates]:
    """EM over ``names, n``: the share of good documents, and the rates of each rule's votes.

    It starts from ``START`` for all rules alike, and counts ten documents of that kind beside those
    seen.  A vote never counts against its own meaning: where its rates come out in the wrong
    order, both are set to their mean and the vote says nothing.
    """
    one = F.struct(*[F.lit(START[vote][i]).alias(f"{name}_{kind}") for name, vote in (("up", 1), ("down", -1)) for i, kind in enumerate(("good", "bad"))])
    start = F.struct(F.lit(0.85).alias("share"), F.array_repeat(one, len(names)).alias("rates")).cast(_STATE)
    whole = patterns.agg(F.collect_list(F.struct(F.array(*names).alias("v"), F.col("n").cast("double").alias("n"))).alias("patterns"))  # 3**rules at most
    got = whole.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: _round(s, len(names))).alias("s")).first().s
    rates = {}
    for v, r in zip(names, got.rates, strict=True):
        rates[v, 1], rates[v, -1] = (r.up_good, r.up_bad), (r.down_good, r.down_bad)
    return got.share, rates


def _judged(rows: DataFrame) -> DataFrame:
    """``rows``, a written table with votes, and ``base_failed, quality, kept``."""
    names = list(votes())
    patterns = rows.groupBy(*names).agg(F.count("*").alias("n"))
    share, rates = estimate(patterns, names)
    rows = rows.withColumn("base_failed", base_failed()).withColumn("quality", posterior(names, share, rates))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))


def assess(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts and votes, ``base_failed, quality, kept`` for every row.

    ``quality`` is the posterior probability of being good; ``kept`` is false if a base rule fails,
    else whether quality reaches 0.5.  A null or wordless text fails.  Rows with a null doc_id or
    that repeat others are judged like any; an empty table gives no rows.  Other columns are ignored.
    """
    rows = features(docs.select("doc_id", "text")).drop("text").withColumns(votes())
    return _judged(stash(rows, "votes"))


def keep_good(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that ``assess`` keeps, all columns as they are.

    Columns travel with the votes, under names of their own, so no row has to be found again.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index("text")
    ready = docs.toDF(*own).withColumnRenamed(own[place], "text")
    rows = _judged(stash(features(ready).withColumns(votes()), "votes"))
    return rows.where("kept").select(*["text" if i == place else c for i, c in enumerate(own)]).toDF(*docs.columns)
