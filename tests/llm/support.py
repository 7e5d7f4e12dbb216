"""Documents that every operator has to get through, and plain versions of shared definitions."""

import hashlib
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, __id2 long, kept boolean, n double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the old house of the valley was small and quiet, and the people that lived in it were kind to all of us"


def frame(spark, rows):
    """rows: (doc_id, text, source); the other columns clash with names that operators use."""
    made = [(i, t, "en", s, None if t is None else len(t), 7, "w", None, None, 0.5) for i, t, s in rows]
    return spark.createDataFrame(made, SCHEMA)


def varied():
    """Nulls, empty texts, ties, repeated rows, very long texts and odd characters."""
    long = " ".join(f"word{i % 997} {i}" for i in range(30_000))
    return [
        (1, PROSE, "a"),
        (2, PROSE, "a"),
        (2, PROSE, "a"),
        (3, None, "b"),
        (4, "", None),
        (None, PROSE + " more", None),
        (5, " \n\t ", "b"),
        (6, long, "a"),
        (7, long + " end", "é"),
        (8, "x" * 50_000, "a"),
        (9, "É é   \U0001f600 ä\nline\n\nline " + PROSE, "b"),
        (10, "one two three", "b"),
        (10, "another text under the same id as the row before " + PROSE, "b"),
    ]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width, lower=True):
    w = words(fold(text or "") if lower else text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
