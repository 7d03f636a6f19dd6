import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import figures


def column(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


TEXTS = [
    "A ﬂat sur-\nface — “so called” — of glass.", "Baden-\nBaden", "half-\nway", "  a\t b \n\n c ", "é-\nx", "①²ﬀ Ａ", None, "", "a​b",
]


def test_normalize(spark):
    got = column(spark, TEXTS, T.normalize)
    assert got[:3] == ['A flat surface - "so called" - of glass.', "Baden- Baden", "halfway"]
    assert got == [None if t is None else T.normalized(t) for t in TEXTS]


def test_tokens(spark):
    text = "Half-open Doors (no_17b) of 2.5m?"
    assert column(spark, [text, None], T.tokenize) == [["half", "open", "doors", "no", "17b", "of", "2", "5m"], None]
    found = column(spark, [text], T.tokens_with_offsets)[0]
    assert [text[t.start : t.end].lower() for t in found] == [t.tok for t in found] == "half open doors no 17b of 2 5m".split()


def test_sentences(spark):
    text = "Cf. Fig. 9 on this. In Ch. 4.2 Jones et al. differ! Do they? They do."
    found = column(spark, [text, None, " "], T.sentences)
    assert [s.text for s in found[0]] == ["Cf. Fig. 9 on this.", "In Ch. 4.2 Jones et al. differ!", "Do they?", "They do."]
    assert all(text[s.start : s.end] == s.text for s in found[0]) and found[1] is None and found[2] == []
    assert [s.text for s in column(spark, ["Too few. Here are four or more of them."], lambda c: T.sentences(c, 4))[0]] == ["Here are four or more of them."]


@pytest.mark.parametrize("seed", range(4))
def test_ratio_matches_a_table(seed):
    r = random.Random(seed)
    for _ in range(60):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(14))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *row[1:]] if False else _next(row, x, b)
        want = 200 * row[-1] / (len(a) + len(b)) if a or b else 100
        assert T.ratio(a, b) == want


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_length_bound_loses_nothing(spark):
    r = random.Random(3)
    pairs = [("".join(r.choice("ab") for _ in range(r.randrange(1, 20))), "".join(r.choice("ab") for _ in range(r.randrange(1, 20)))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(T.can_reach(F.col("a"), F.col("b"), 85).alias("may"), T.indel_ratio("a", "b").alias("r")).collect()
    assert all(x.may for x in rows if x.r >= 85) and not all(x.may for x in rows)


def test_difference_marks():
    """Taking the marks away gives the words; what is unmarked is the same on both sides but for case and marks around words."""
    r = random.Random(11)
    plain = lambda side: re.sub(r"<mark>.*?</mark> ?", "", side).lower().replace(",", "").split()
    for _ in range(40):
        a = [r.choice(["red", "Blue", "green,", "a<b", "x&y"]) for _ in range(r.randrange(9))]
        b = [w.lower() if r.random() < 0.2 else w for w in a if r.random() < 0.8]
        left, right = T.marked_difference(" ".join(a), " ".join(b))
        assert unescape(left.replace("<mark>", "").replace("</mark>", "")) == " ".join(a) and "<b" not in left
        assert unescape(right.replace("<mark>", "").replace("</mark>", "")) == " ".join(b)
        assert plain(left) == plain(right)
    assert T.marked_difference("one two", "one two")[0] == "one two" and "<mark>" in T.marked_difference("one", "two")[1]


def test_sql_names(spark):
    T.register(spark)
    assert spark.sql("select round(indel_ratio('abcd', 'abed'), 1)").first()[0] == 75.0
    assert spark.sql("select normalize_text('a  b\n c')").first()[0] == "a b c"
    figures.register(spark)
    even = spark.createDataFrame([(20, 30, 1, bytearray(600))], "height int, width int, channels int, data binary")
    even.createOrReplaceTempView("even_figures")
    assert spark.sql("select figure_hash(height, width, channels, data).blank from even_figures").first()[0]
