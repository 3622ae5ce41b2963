"""Small documents with every awkward case, and plain-Python twins of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, d struct<x:int>, key string, size int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def documents(n=60, seed=5):
    """Plain texts, copies, near copies, repeated rows, nulls, empty and very long texts; names that clash."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(400)] + ["the", "of", "und", "la"] * 20
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts = [make(rng.randint(1, 120)) for _ in range(n)]
    for k in range(0, n, 6):
        w = texts[k].split()
        for _ in range(3):
            v = list(w)
            if len(v) > 20:
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
        texts.append(texts[k].upper())
    texts += [None, "", "   ", "one", "ONE", "Line a b\nLine a b\nother\n\n", "# $ % & | < > words", "ÄÖ äö İ ß " * 30, make(6000), "x" * 9000, "a b　c", "same words " * 60]
    rows = [(k, t, "en", None if k % 11 == 0 else f"s{k % 4}", None if t is None else len(t), "h", (1,), "key", 3) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
