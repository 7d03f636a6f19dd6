"""Text functions as Column expressions; Arrow UDFs only where the JVM lacks the operation.

Null in, null out.  Offsets are code points.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Typographic characters and what they count as.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"'}
DASHES = dict.fromkeys("‐‑‒–—−", "-")
SPACES = dict.fromkeys("    ", " ")
ONE_TO_ONE = QUOTES | DASHES | SPACES
DELETED = "​­"

#: Words before a full stop that doesn't end a sentence.
ABBREVIATIONS = frozenset(
    "fig figs eq eqs eqn sec secs ref refs tab e.g i.e et al vs cf no approx etc resp dr prof mr mrs ms vol pp ch dept"
    " univ inc ltd corp jan feb mar apr jun jul aug sep sept oct nov dec st nd rd th".split()
)

#: Python's white space, letters and digits as Java regular expression classes.
WS = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
WORD = r"[\p{L}\p{N}]+"

#: Fixed value: terminal punctuation, white space, and something that can begin a sentence.
BOUNDARY = r"[.!?]+[\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9])"


def _struct(**fields):
    return StructType([StructField(k, t) for k, t in fields.items()])


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function does."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize(text: Column) -> Column:
    """Fold typography, compose, rejoin words broken over lines, and collapse white space."""
    text = F.translate(text, "".join(ONE_TO_ONE) + DELETED, "".join(ONE_TO_ONE.values()))
    for glyph, letters in LIGATURES.items():
        text = F.replace(text, F.lit(glyph), F.lit(letters))
    text = nfkc(text)
    text = F.regexp_replace(text, rf"(?<=[\p{{L}}\p{{N}}_])-{WS}*\n{WS}*(?=[a-z])", "")
    text = F.regexp_replace(text, rf"{WS}*\n{WS}*", " ")
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


_FOLDED = str.maketrans(LIGATURES | ONE_TO_ONE | dict.fromkeys(DELETED, ""))


def normalized(text: str) -> str:
    """``normalize`` of one string."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_FOLDED))
    if "\n" in text:
        text = re.sub(r"(?<=\w)-\s*\n\s*(?=[a-z])", "", text)
        text = re.sub(r"\s*\n\s*", " ", text)
    return re.sub(r"[ \t\r\f\v]+", " ", text).strip() if re.search(r"[\t\r\f\v]|  ", text) else text.strip()


@F.pandas_udf(StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    """``normalized`` of a column, for SQL."""
    return text.map(lambda t: None if t is None else normalized(t))


@F.pandas_udf(ArrayType(StringType()))
def normalize_lines(lines: pd.Series) -> pd.Series:
    """Control characters taken out of each line, and the rest normalised."""
    return lines.map(lambda ls: None if ls is None else [normalized(re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", x or "")) for x in ls])


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def token_string(text: Column) -> Column:
    return F.array_join(tokenize(text), " ")


@F.pandas_udf(ArrayType(_struct(tok=StringType(), start=IntegerType(), end=IntegerType())))
def tokens_with_offsets(text: pd.Series) -> pd.Series:
    """Tokens and where they stand in the text as written."""
    word = re.compile(r"[^\W_]+")
    return text.map(lambda t: None if t is None else [{"tok": m[0].lower(), "start": m.start(), "end": m.end()} for m in word.finditer(t)])


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Offsets of the sentences of a normalised text."""
    cuts, begin = [], 0
    for mark in re.finditer(BOUNDARY, text):
        before = text[begin : mark.start()].rsplit(maxsplit=1)[-1:]
        word = before[0].rstrip(".!?\"')]").lower() if before else ""
        if word not in ABBREVIATIONS and not (len(word) == 1 and word.isalpha()):
            cuts.append((begin, mark.start() + len(mark[0].rstrip())))
            begin = mark.end()
    spans = []
    for a, b in [*cuts, (begin, len(text))]:
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip())
        if piece.strip():
            spans.append((a, a + len(piece.strip())))
    return spans


@F.pandas_udf(ArrayType(_struct(text=StringType(), start=IntegerType(), end=IntegerType())))
def split_sentences(text: pd.Series) -> pd.Series:
    """Sentences with their offsets."""
    return text.map(lambda t: None if t is None else [{"text": t[a:b], "start": a, "end": b} for a, b in sentence_spans(t)])


def sentences(text: Column, min_tokens: int = 1) -> Column:
    """Sentences of at least ``min_tokens`` tokens."""
    found = split_sentences(text)
    return found if min_tokens <= 1 else F.filter(found, lambda s: F.size(tokenize(s.text)) >= min_tokens)


def margin_key(text: Column) -> Column:
    """Text with its numbers blotted out, for lines that differ in a page number."""
    return F.regexp_replace(F.lower(normalize(text)), r"\p{Nd}+", "#")


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f]", "")


# --- similarity -------------------------------------------------------------------


def masks(a: str) -> dict[str, int]:
    """Where each character stands in ``a``, a bit for each place."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    return at


_STEP = 16  # characters between looks at what can still be reached


def common_length(a: str, b: str, at: dict[str, int] | None = None, least: int = 0) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``; ``at`` are its masks.

    -1 as soon as no ``least`` characters can be reached, whatever the rest of ``b``.  Such a subsequence leaves out
    so few characters of ``a`` that none of it pairs with one of ``b`` more than ``ahead`` places before its own.
    """
    if a == b:
        return len(a)
    at = masks(a) if at is None else at
    ahead = len(a) - least
    row = size = found = 0
    for lo in range(0, len(b), _STEP):
        wider = min(len(a), max(size, lo + _STEP + ahead))
        row |= (1 << wider) - (1 << size)
        size = wider
        for places in map(at.get, b[lo : lo + _STEP]):
            if places:
                hit = row & places
                row = (row + hit) | (row - hit)
        row &= (1 << size) - 1
        found = size - row.bit_count()
        if found + max(0, len(b) - lo - _STEP) < least:
            return -1
    return found


def ratio(a: str, b: str, at: dict[str, int] | None = None, threshold: float = 0.0) -> float:
    """Share of characters in a longest common subsequence, 0 to 100; two empty texts are alike.

    A share below ``threshold`` may come as a negative number.
    """
    total = len(a) + len(b)
    return 200.0 * common_length(a, b, at, int(threshold * total / 200)) / total if total else 100.0


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two columns."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def can_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether lengths alone let two texts have this ratio; drops no pair that has it."""
    return F.least(F.length(a), F.length(b)) * 200.0 >= (F.length(a) + F.length(b)) * float(threshold)


def marked_difference(a: str, b: str) -> tuple[str, str]:
    """Both texts as HTML, words that have no equal in the other in <mark>."""
    left, right = a.split(), b.split()
    plain = lambda words: [w.lower().strip(".,;:()[]\"'") for w in words]
    sides: tuple[list[str], list[str]] = ([], [])
    blocks = difflib.SequenceMatcher(None, plain(left), plain(right), autojunk=False).get_matching_blocks()
    x = y = 0
    for block in blocks:
        for side, words, start, stop in ((0, left, x, block.a), (1, right, y, block.b)):
            if stop > start:
                sides[side].append(f"<mark>{html.escape(' '.join(words[start:stop]))}</mark>")
            if block.size:
                sides[side].append(html.escape(" ".join(words[stop : stop + block.size])))
        x, y = block.a + block.size, block.b + block.size
    return " ".join(sides[0]), " ".join(sides[1])


@F.pandas_udf(_struct(a_html=StringType(), b_html=StringType()))
def diff_marks(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """``marked_difference`` of two columns."""
    return pd.DataFrame([marked_difference(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["a_html", "b_html"])


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL by name."""
    for name, function in {
        "nfkc": nfkc, "normalize_text": normalize_text, "tokens_with_offsets": tokens_with_offsets, "split_sentences": split_sentences, "indel_ratio": indel_ratio, "diff_marks": diff_marks,
    }.items():
        spark.udf.register(name, function)
