"""Plain restatements of the contracts, for small tables."""

import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, pattern=SPACE_WORD, fold=True):
    return pattern.findall(lower(text) if fold else text or "")


def prose(seed, n, vocabulary=400):
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


#: Rows that every operator must take: null and empty texts, short and repeated ones, odd characters.
ODD = [None, "", " \n\t ", "a", "a b c", "a b c", "É ç x", "\U0001f600 z", "<|endoftext|> A'S", "x" * 5000, "<b>#*$%&|", "\x00 \x1c y"]


def table(spark, texts, first=0):
    """documents with clashing extra columns; ids are null for the last row."""
    rows = [(first + i, t, None if i % 3 else "en", None, i, "x", i) for i, t in enumerate(texts)]
    rows.append((None, "a row without an id", None, None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, n int")


def empty(spark):
    return table(spark, []).where("doc_id is not null")
