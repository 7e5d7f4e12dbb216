"""Toxicity: a noisy-channel decoder restores disguised words, then the restored text is scored.

Decoding. A disguised stretch is a lattice of readings: digits and signs for letters (``1d10t``, ``m@r0n``), look-alikes of
other scripts, letters said again and again (``idiooot``), letters set apart by blanks or marks (``i d i o t``, ``id-iot``) and
starred letters (``id*ot``). Each reading has a channel cost; ``Decoder.decode`` finds the most likely one by Viterbi over the
lattice, with the last two characters as state, under a character trigram model counted over ALL texts (``count_trigrams``: one
map-side table a task, summed by Spark, 64 cubed counts at any size of the corpus). A stretch without a second reading is its own
decoding, so only the stretches that ``_CORE`` and ``_SPACED`` find are searched; every text is read whole.

Scoring. Every word of the restored text and its beginnings of 4, 5 and 6 bytes are hashed into ``BUCKETS``. A bucket weighs
what its document frequencies in toxic and other labelled texts prove: the log odds less one standard error. A text's evidence is
the largest weight in it and the number of its words above ``STRONG``; a logistic curve over both, fitted where weights come
from the other half of the labelled rows, gives the score.

``fit`` learns from the rows of about ``TRAIN_ROWS`` labelled ids, chosen by a hash of the id; counts meet as sums by bucket, the
curve is fitted on a histogram, and the driver gets the buckets that two or more toxic rows hold. Everything else covers all rows.

NULL and empty texts have no evidence and get the score of such. Rows without a label and labels without a row train nothing; of
several labels of one id the largest counts; repeated rows count one by one. Without both labels every score is the share of
toxic rows, 0.1 without any. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import ship, text_of
from shelfwise.llm.hashing import buffers, mix

BUCKETS = 1 << 22
TRAIN_ROWS = 20_000
STRONG = 1.5
PREFIXES = (4, 5, 6)

# The alphabet of the language model: letters, blank (and marks), digits, and other letters by their code point.
_SIZE, _BLANK, _DIGIT, _OTHER = 64, 26, 27, 28
_TABLE = np.full(0x3002, _BLANK, np.uint32)
for _c in range(0x3001):
    if chr(_c).isdigit():
        _TABLE[_c] = _DIGIT
    elif chr(_c).isalpha():
        _TABLE[_c] = _c - 97 if 97 <= _c < 123 else _OTHER + _c % (_SIZE - _OTHER)
_TABLE[0x3001] = _OTHER

#: Fixed values of the channel: what a character may stand for, besides itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
LOOKS = dict(zip("аеорсухікѕԁαεικνορτυ", "aeopcyxiksdaeikvoptu"))
_FREE = "­​‌‍‎‏⁠﻿"
#: Log probabilities of the channel.
_KEPT, _MEANT, _LOOK = -1.0, -1.6, -0.3
_RUN = {2: ((2, -0.1), (1, -1.8))}
_LONG_RUN = ((1, -0.3), (2, -1.0))
_STAR = tuple((v, -1.8) for v in "aeiou") + (("", -1.6),)
_APART, _JOINT, _WIDE = (("", -0.3), (" ", -4.0)), ((" ", -0.7), ("", -1.2)), ((" ", -0.1), ("", -8.0))
_EDGE = (("", -0.3), (" ", -1.5))  # a word of one letter may stand beside

_L = r"[^\W\d_]"
_SIGNS = r"@$!|+€"
_SPACED = re.compile(rf"(?<![\w{_SIGNS}])[^\W_](?:[ ._\-*]{{1,2}}(?:[^\W_]|[{_SIGNS}])){{3,}}(?![\w{_SIGNS}])")
_CORE = re.compile(
    rf"{_L}[0-9{_SIGNS}*._\-~{_FREE}]+{_L}"  # something between two letters
    rf"|(?<![\w{_SIGNS}])[0-9{_SIGNS}]+{_L}"  # a sign before the first letter
    rf"|{_L}[0-9](?![\w{_SIGNS}])"  # a digit after the last letter
    rf"|({_L})\1\1"  # a letter three times
    r"|[a-z][Ͱ-ԯ]|[Ͱ-ԯ][a-z]"  # two scripts in one word
)
_TOKEN = re.compile(rf"[\w{_SIGNS}*.\-~{_FREE}]*")
_BEFORE = re.compile(rf"[\w{_SIGNS}*.\-~{_FREE}]*\Z")


def symbols(text: str) -> np.ndarray:
    """The text in the alphabet of the language model."""
    return _TABLE[np.minimum(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32), 0x3001)]


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all character trigrams of all texts, as a flat table of 64 cubed numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for b in batches:
            for raws in buffers(b.column(0).to_pylist()):
                s = symbols("  " + "  ".join(r.decode("utf-8", "surrogatepass") for r in raws) + "  ")
                total += np.bincount((s[:-2] * _SIZE + s[1:-1]) * _SIZE + s[2:], minlength=_SIZE**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["k", "n"])

    made = docs.select(text_col).mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_SIZE**3, np.int64)
    counts[made["k"].to_numpy(np.int64)] = made["n"].to_numpy(np.int64)
    return counts


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), backed off to pairs and single characters.

    It is the model of what is meant, so trigrams of letters with digits count as unseen: disguised words that occur often
    would otherwise vouch for themselves.
    """
    c = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
    place = np.indices(c.shape)
    c[(place == _DIGIT).any(0) & ((place != _DIGIT) & (place != _BLANK)).any(0)] = 0
    one = c.sum((0, 1)) + 0.5
    two = c.sum(0)
    pair = (two + 5 * (one / one.sum())) / (two.sum(1, keepdims=True) + 5)
    return np.log((c + 5 * pair) / (c.sum(2, keepdims=True) + 5)).reshape(-1)


class Decoder:
    """Restores texts under a language model."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.decode = lru_cache(maxsize=1 << 16)(self._decode)

    def _readings(self, stretch: str, spaced: bool) -> Iterator[tuple[tuple[str, float], ...]]:
        """For each place of the lattice its readings and their costs."""
        at, end = 0, len(stretch)
        marks = [c for c in stretch if not c.isalnum() and c not in LEET]
        main = max(sorted(set(marks)), key=marks.count) if marks else ""  # what sets the letters apart; other marks part words
        while at < end:
            c, go = stretch[at], at + 1
            while go < end and stretch[go] == c:
                go += 1
            n, at = go - at, go
            if c in _FREE:
                yield (("", 0.0),)
            elif c.isalpha():
                look = LOOKS.get(c)
                runs = ((1, 0.0),) if n == 1 else _RUN.get(n, _LONG_RUN)
                yield tuple((x * k, p + q) for k, p in runs for x, q in (((c, 0.0),) if look is None else ((c, -2.0), (look, _LOOK))))
            elif c in LEET:
                for _ in range(n):
                    yield ((c, _KEPT), *((x, _MEANT) for x in LEET[c]))
            elif c == "*" and not spaced:
                yield _STAR if n == 1 else _WIDE
            elif c.isalnum():
                yield ((c * n, 0.0),)
            else:
                apart = _EDGE if at <= 2 or at >= end - 1 else _APART
                yield (apart if n == 1 and c == main else _WIDE) if spaced else (_JOINT if n == 1 else _WIDE)

    def _decode(self, stretch: str, spaced: bool) -> str:
        """The most likely reading of a stretch: Viterbi with the last two characters as state."""
        model = self.model
        states = {_BLANK * _SIZE + _BLANK: (0.0, None)}
        for readings in self._readings(stretch, spaced):
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, link) in states.items():
                for out, cost in readings:
                    s, total = state, score + cost
                    for c in out:
                        code = ord(c)
                        k = s * _SIZE + int(_TABLE[code if code < 0x3001 else 0x3001])
                        total += model[k]
                        s = k % (_SIZE * _SIZE)
                    if s not in after or total > after[s][0]:
                        after[s] = (total, (link, out) if out else link)
            states = after
        _, (_, link) = max(states.items(), key=lambda x: (x[1][0] + model[x[0] * _SIZE + _BLANK], -x[0]))
        parts = []
        while link is not None:
            link, out = link
            parts.append(out)
        return "".join(reversed(parts))

    def restore(self, text: str | None) -> str:
        """The text in small letters, with every disguised stretch as its most likely reading."""
        text = (text or "").lower()
        text = _SPACED.sub(lambda m: self.decode(m[0], True), text)
        parts, at = [], 0
        found = _CORE.search(text)
        while found:
            a, b = found.span()
            a -= len(_BEFORE.search(text, max(at, a - 64), a)[0])
            b = _TOKEN.match(text, b).end()
            while b > found.end() and not text[b - 1].isalnum():
                b -= 1  # a full stop ends a sentence
            parts.append(text[at:a])
            parts.append(self.decode(text[a:b], False))
            at = b
            found = _CORE.search(text, b)
        parts.append(text[at:])
        return "".join(parts)


_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BYTE_KEY = mix(np.arange(2001, 2257, dtype=np.uint64))


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part of the texts: the buckets of all words and beginnings, and how many each text has."""
    for raws in buffers(texts):
        data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        solid = _SOLID[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        place = np.arange(len(data), dtype=np.int64)
        first = np.zeros(len(data), np.int64)
        first[starts] = starts
        np.maximum.accumulate(first, out=first)
        weight = mix((place - first + 1).astype(np.uint64)) | np.uint64(1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_KEY[data] * weight, out=sums[1:], dtype=np.uint64)
        text_ends = np.cumsum([len(r) + 1 for r in raws])
        owner = np.searchsorted(text_ends, starts, "right")
        hashes, owners = [mix(sums[ends] - sums[starts])], [owner]
        for k in PREFIXES:
            longer = ends - starts > k
            hashes.append(mix(sums[starts[longer] + k] - sums[starts[longer]] + np.uint64(k)))
            owners.append(owner[longer])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        bucket = (np.concatenate(hashes) >> np.uint64(64 - 22)).astype(np.int64)[order]
        yield bucket, np.bincount(owner, minlength=len(raws))


def evidence(decoder: Decoder, weights: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Per text the largest weight and the log of the number of words and beginnings above ``STRONG``; weights has a row per text's fold or one row."""
    made = []
    for bucket, counts in features([decoder.restore(t) for t in texts]):
        w = np.concatenate((weights[bucket], [0]))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        top = np.where(counts > 0, np.maximum.reduceat(w, starts), 0.0)
        strong = np.where(counts > 0, np.add.reduceat((w >= STRONG).astype(np.float64), starts), 0.0)
        made.append(np.stack((np.maximum(top, 0.0), np.log1p(strong)), axis=1))
    return np.concatenate(made) if made else np.empty((0, 2))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def bucket_weights(bucket: np.ndarray, toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """Weights of all buckets: log odds of the document frequencies, less a standard error; 0 where less than two toxic rows speak."""
    out = np.zeros(BUCKETS, np.float32)
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    out[bucket] = np.where(toxic >= 2, np.maximum(0, odds - np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))), 0)
    return out


def curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bias and slopes of a logistic curve over (largest weight, log number), by Newton's method on counted rows."""
    a = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    beta, ridge = np.array([-3.0, 1.0, 0.5]), np.diag([0.01, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hessian = (a * (n * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(hessian, a.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return np.concatenate(([beta[0]], np.maximum(beta[1:], 0)))


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray | None, np.ndarray]:
    """(weights of the buckets, curve) from labelled rows; (None, [share]) where a label is missing."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).alias("__y"))
    known = known.filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1)).groupBy("__id").agg(F.max("__y").alias("__y"))
    share = min(1.0, train_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit("toxicity sample"), "__id"), F.lit(1_000_000))
    drawn = F.broadcast(known.filter(draw < int(share * 1_000_000 + 1)))  # about train_rows rows of two numbers
    sample = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("__id"))
    # Copies of a text are in one half, or a half would be tested on what it learned.
    half = F.pmod(F.xxhash64(F.lit("half"), F.substring(text_of(), 1, 100)), F.lit(2)).cast("int")
    sample = sample.select(F.col("__y").cast("int").alias("y"), half.alias("half"), text_of().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            group = b.column("y").to_numpy() * 2 + b.column("half").to_numpy()
            texts, at, found = b.column("text").to_pylist(), 0, []
            for bucket, counts in features([decoder.restore(t) for t in texts]):
                for one, g in zip(np.split(bucket, np.cumsum(counts)[:-1]), group[at : at + len(counts)]):
                    found.append(np.unique(one) * 4 + int(g))
                at += len(counts)
            found.append(4 * BUCKETS + group)  # rows of each kind, as one more bucket
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // 4, pa.int32()), pa.array(key % 4, pa.int32()), pa.array(n, pa.int64())], ["bucket", "g", "n"])

    by_group = [F.sum(F.when(F.col("g") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in range(4)]
    counts = sample.mapInArrow(describe, "bucket int, g int, n long").groupBy("bucket").agg(*by_group)
    got = counts.filter((F.col("n2") + F.col("n3") >= 2) | (F.col("bucket") == BUCKETS)).toPandas().sort_values("bucket").to_numpy(np.int64)
    rows = got[got[:, 0] == BUCKETS, 1:].sum(0).astype(float)
    toxic, other = rows[2] + rows[3], rows[0] + rows[1]
    if not toxic or not other:
        return None, np.array([(toxic + 0.1) / (toxic + other + 1)])
    got = got[got[:, 0] < BUCKETS]
    whole = bucket_weights(got[:, 0], got[:, 3] + got[:, 4], got[:, 1] + got[:, 2], toxic, other)
    # Weights for a half come from the other one.
    crossed = docs.sparkSession.sparkContext.broadcast([bucket_weights(got[:, 0], got[:, 4 - h], got[:, 2 - h], rows[3 - h], rows[1 - h]) for h in (0, 1)])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            halves, texts = b.column("half").to_numpy(), b.column("text").to_pylist()
            for h in (0, 1):
                of = np.flatnonzero(halves == h)
                seen = np.round(evidence(decoder, crossed.value[h], [texts[i] for i in of]) * 10) / 10
                yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0], pa.float64()), pa.array(seen[:, 1], pa.float64()), b.column("y").take(pa.array(of))], ["top", "strong", "y"])

    histogram = sample.mapInArrow(weigh, "top double, strong double, y int").groupBy("top", "strong", "y").count().toPandas()
    histogram = histogram.sort_values(["top", "strong", "y"]).to_numpy(float)
    return whole, curve(histogram[:, :2], histogram[:, 2], histogram[:, 3])


def score(docs: DataFrame, model: np.ndarray, weights: np.ndarray | None, beta: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns with the score of a text column."""
    if weights is None:
        return docs.withColumn(out, F.lit(float(beta[0])))
    used = np.flatnonzero(weights).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((model.astype(np.float32), used, weights[used], beta))
    held: dict[str, object] = {}

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not held:
            model, used, values, _ = shared.value
            held["weights"] = np.zeros(BUCKETS, np.float32)
            held["weights"][used] = values
            held["decoder"] = Decoder(model)
        x, beta = evidence(held["decoder"], held["weights"], list(texts)), shared.value[3]
        return pd.Series(1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30))))

    return docs.withColumn(out, of(text_of(text_col)))


def restored(docs: DataFrame, text_col: str = "text", out: str = "restored") -> DataFrame:
    """All rows and columns with the decoded text; the language model is counted over the same rows."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trigram_model(count_trigrams(docs, text_col)))

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        decoder = Decoder(shared.value)
        return pd.Series([decoder.restore(t) for t in texts], dtype=object)

    return docs.withColumn(out, of(text_of(text_col)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learned from the rows that are not held out."""
    ship(docs.sparkSession)
    model = trigram_model(count_trigrams(docs))
    weights, beta = fit(docs, labels.filter(~held_out("doc_id")), model, "toxic", train_rows)
    scored = score(docs.select("doc_id", "text"), model, weights, beta)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
