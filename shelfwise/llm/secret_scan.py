"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

Base kinds (leftmost, non-overlapping per kind, failing matches dropped): ``assign``, ``access`` and ``hex``. The kind
``markov`` adds stretches of at least ``MIN_RUN`` token characters outside base spans whose mean log-likelihood ratio
between a model of random strings and a model of ordinary identifiers reaches ``MIN_RATIO`` a character. A run of token
characters may glue paths, keys and values: base spans are cut out, and of a rest that as a whole is below the bound the
maximal stretches above it count, widened to the next separators where they stay above it.

Both models are first-order Markov chains over 69 character classes, trained by counting pairs in labelled samples
(``train``; the counts are a Spark aggregate of at most 2 * 69 * 69 rows). ``labelled_samples`` makes samples from a
corpus: label 1 are the values that the base kinds find and digests of the rows in several notations, label 0 the
corpus's words in the spellings that identifiers have. It draws about ``TRAIN_DOCS`` documents by a hash of the id.

Spans are code points, end exclusive, of the whole match. NULL and empty texts have no spans. Rows are scanned one by
one, so ties, repeated rows and extra columns have no influence; without any sample the models are uniform and add
nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import text_of

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
MIN_RUN = 20
MIN_RATIO = 0.8
TRAIN_DOCS = 4_000
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_SEPARATORS = "+/_=-"
_CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
_N = len(_CLASSES) + 1  # the last one: start of a string, and any other character
_CODE = np.full(128, _N - 1, np.int64)
_CODE[[ord(c) for c in _CLASSES]] = np.arange(len(_CLASSES))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base kinds, by kind and start."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """By start, then by the order of the kinds."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end``, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _codes(token: str) -> np.ndarray:
    raw = np.frombuffer(token.encode("ascii", "replace"), np.uint8)
    return _CODE[np.minimum(raw, 127)]


def _pairs(token: str) -> np.ndarray:
    codes = np.concatenate(([_N - 1], _codes(token)))
    return codes[:-1] * _N + codes[1:]


def ratio(model: np.ndarray, token: str) -> float:
    """Mean log-likelihood ratio a character: positive when random is likelier."""
    return float(model[_pairs(token)].mean())


def train(samples: DataFrame) -> np.ndarray:
    """The log-likelihood ratio of every character pair, from rows (``token``, ``label``: 1 random, 0 ordinary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _N * _N), np.int64)
        for b in batches:
            for token, label in zip(b.column("token").to_pylist(), b.column("label").to_pylist()):
                if token and label in (0, 1):
                    np.add.at(total[label], _pairs(token), 1)
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[label, pair])], ["label", "pair", "n"])

    rows = samples.select("token", "label").mapInArrow(count, "label int, pair int, n long")
    rows = rows.groupBy("label", "pair").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * 69 * 69
    counts = np.zeros((2, _N * _N))
    counts[rows["label"], rows["pair"]] = rows["n"]
    logs = []
    for one in counts:
        grid = one.reshape(_N, _N) + 0.5
        logs.append(np.log(grid / grid.sum(axis=1, keepdims=True)))
    return (logs[1] - logs[0]).ravel()


def labelled_samples(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(``token``, ``label``) from about ``train_docs`` documents (columns doc_id, text), drawn by a hash of the id."""
    total = docs.count()
    share = min(1.0, train_docs / max(1, total))
    drawn = docs.filter(F.pmod(F.xxhash64(F.lit("secret sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000 + 1))
    word = re.compile(r"[A-Za-z]{4,}")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, labels = [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                text = text or ""
                places = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
                places += [m.span() for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
                places += [m.span() for m in _HEX.finditer(text)]
                values = [text[x:y] for x, y in places] + _random_strings(f"{i}")
                # Ordinary words are those that no value touches: what is left of each has to be the whole.
                found = {m.span() for m in word.finditer(text)}
                words = [text[x:y] for x, y in _outside(iter(sorted(found)), _covered(sorted(places))) if (x, y) in found]
                names = [x for four in zip(*[iter(words)] * 4) for x in _identifiers(four)]
                tokens += values + names
                labels += [1] * len(values) + [0] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(labels, pa.int32())], ["token", "label"])

    return drawn.select("doc_id", "text").mapInArrow(label, "token string, label int")


def _random_strings(seed: str) -> list[str]:
    """Four keyed strings: hexadecimal, upper case with digits, letters with digits, base 64."""
    import base64

    d = [hashlib.sha256(f"{n}:{seed}".encode()).digest() for n in range(4)]
    spread = lambda raw, letters: "".join(letters[x % len(letters)] for x in raw)
    return [d[0].hex()[:40], spread(d[1], _CLASSES[26:62]), spread(d[2], _CLASSES[:62]), base64.b64encode(d[3]).decode()]


def _identifiers(words: tuple[str, ...]) -> Iterator[str]:
    """Four words as identifiers write them."""
    a, b, c, d = words
    low = [w.lower() for w in words]
    yield "_".join(low)
    yield "-".join(low)
    yield low[0] + "".join(w.capitalize() for w in low[1:])
    yield "_".join(w.upper() for w in (a, b)) + f"_{len(c) + len(d)}"
    yield "/".join(low)
    yield "".join(low)
    yield "".join(words).upper()


def _stretches(scores: list[float]) -> list[tuple[int, int]]:
    """The disjoint stretches of maximal sum (Ruzzo and Tompa), in linear time."""
    done, open_, total = [], [], 0.0  # open_: (start, end, sum before, sum after)
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, low = i, before
        while True:
            while open_ and open_[-1][2] >= low:
                done.append(open_.pop()[:2])
            if not open_ or open_[-1][3] >= total:
                break
            start, _, low, _ = open_.pop()
        open_.append((start, i + 1, low, total))
    found: list[tuple[int, int]] = []
    for a, b in sorted(done + [s[:2] for s in open_], key=lambda s: (s[0], -s[1])):
        if not found or a >= found[-1][1]:  # else it is part of the one before
            found.append((a, b))
    return found


def random_stretches(model: np.ndarray, token: str, min_ratio: float = MIN_RATIO) -> list[tuple[int, int]]:
    """The stretches of a string that are likelier random, at least ``MIN_RUN`` long, in order."""
    if len(token) < MIN_RUN:
        return []
    above = model[_pairs(token)] - min_ratio
    if above.mean() >= 0:
        return [(0, len(token))]
    sums = np.concatenate(([0.0], np.cumsum(above)))
    edges = [-1, *(i for i, c in enumerate(token) if c in _SEPARATORS), len(token)]
    found: list[tuple[int, int]] = []
    for a, b in _stretches(above.tolist()):
        if found and b <= found[-1][1]:
            continue
        # The parts between separators that its ends lie in.
        left = edges[bisect_right(edges, a) - 1] + 1
        right = edges[bisect_left(edges, b - 1)]
        wide = (max(min(left, a), found[-1][1] if found else 0), max(right, b))
        for x, y in (wide, (max(a, wide[0]), b)):
            if y - x >= MIN_RUN and sums[y] >= sums[x]:
                found.append((x, y))
                break
    return found


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order of their starts as disjoint stretches."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _outside(parts: Iterator[tuple[int, int]], covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What disjoint stretches leave of disjoint parts; both are in order, and each is passed once."""
    at = 0
    for a, b in parts:
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        i = at
        while i < len(covered) and covered[i][0] < b:
            if a < covered[i][0]:
                yield a, covered[i][0]
            a = max(a, covered[i][1])
            i += 1
        at = max(at, i - 1)  # the last one may reach into the next part
        if a < b:
            yield a, b


def scan_text(text: str, model: np.ndarray, min_ratio: float = MIN_RATIO) -> tuple[list, list]:
    """(base spans, all spans) of a text, in order."""
    base = in_order(base_spans(text))
    spans = list(base)
    for a, b in _outside((m.span() for m in _RUN.finditer(text)), _covered([s[1:] for s in base])):
        spans += [("markov", a + x, a + y) for x, y in random_stretches(model, text[a:b], min_ratio)]
    return base, in_order(spans)


def scan(docs: DataFrame, model: np.ndarray, id_col="doc_id", text_col="text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 69 * 69 numbers

    @F.pandas_udf("array<struct<kind: string, start: long, end: long>>")
    def spans(texts: pd.Series) -> pd.Series:
        found = (scan_text(t, shared.value, min_ratio)[1] for t in texts)
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found])

    return docs.select(F.col(id_col).alias("doc_id"), spans(text_of(text_col)).alias("spans"))


def secret_report(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans, from the scan's spans."""
    found = scan(docs, train(labelled_samples(docs.select("doc_id", "text"), train_docs)))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of("markov")
    )
