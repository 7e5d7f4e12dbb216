"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is ``sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))``: all pairwise
interactions, in time linear in the features. Features are

- words, hashed to ``BUCKETS`` dimensions, ``log(1 + count)`` scaled to unit length,
- structure statistics of the text (word length, symbols, capitals, exclamation marks, distinct words, repeated
  five-word windows, repeated lines, ...), each as a one-hot bin,
- metadata of the record as one-hot bins: the length of the text in code points and lines. Label, language, source and
  id are never features.

``fit`` trains on at most about ``TRAIN_ROWS`` labelled rows, drawn by a hash of the id: features are made in parallel,
the rows meet in one task (the bound makes that task the same size for any corpus), the model (``BUCKETS`` times
``RANK + 1`` numbers) goes to the driver and is broadcast for scoring. The order of the rows is fixed, so reruns agree.

NULL and empty texts have bins only and get a score too. Rows without a label and labels without a row train nothing;
of several labels of one id the largest counts. Without any training row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import text_of
from shelfwise.llm.hashing import buffers, shingle_sets, word_hashes

BUCKETS = 1 << 15
RANK = 8
EPOCHS = 6
#: Few rows are gone over more often, up to this number of steps.
STEPS = 600
BATCH = 64
RATE = 0.08
TRAIN_ROWS = 8_000

#: Upper edges of the bins of each statistic.
BINS: dict[str, tuple[float, ...]] = {
    "words": (1, 5, 10, 20, 50, 100, 200, 500, 1000, 5000),
    "mean_word": (2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10),
    "symbols": (0.001, 0.01, 0.03, 0.1, 0.2, 0.5, 1, 2),
    "capitals": (0.005, 0.02, 0.04, 0.08, 0.2, 0.4, 0.7),
    "exclamations": (0.001, 0.01, 0.05, 0.2, 0.5, 1),
    "digits": (0.001, 0.01, 0.03, 0.1, 0.3),
    "stops": (0.02, 0.05, 0.1, 0.15, 0.2, 0.4),
    "distinct": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeats": (0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.5, 0.8),
    "lines_repeated": (0.01, 0.1, 0.3, 0.6),
    "chars": (1, 20, 60, 200, 500, 1000, 3000, 10000, 50000),
    "line_count": (1, 2, 4, 8, 16, 64, 256),
}
_FIRST = dict(zip(BINS, np.cumsum([0, *[len(e) + 1 for e in BINS.values()]])))
N_FEATURES = BUCKETS + sum(len(e) + 1 for e in BINS.values())
_SIZE = N_FEATURES * (RANK + 1) + 1


def _statistics(text: str, n: int, distinct: int, windows: int) -> dict[str, float]:
    chars = len(text) or 1
    inside = max(1, len("".join(text.split())))
    words = max(1, n)
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "words": n,
        "mean_word": inside / words,
        "symbols": sum(map(text.count, "#*$%&|<>")) / words,
        "capitals": sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / inside,
        "exclamations": text.count("!") / words,
        "digits": sum(map(text.count, "0123456789")) / inside,
        "stops": (text.count(".") + text.count(",")) / words,
        "distinct": distinct / words,
        "repeats": 1 - windows / max(1, n - 4) if n > 4 else 0.0,
        "lines_repeated": 1 - len(set(lines)) / max(1, len(lines)),
        "chars": chars if text else 0,
        "line_count": len(lines),
    }


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text; indices are distinct."""
    at = 0
    for raws in buffers(texts):
        hashes, offsets = word_hashes(raws)
        for a, b, windows in zip(offsets[:-1], offsets[1:], shingle_sets(raws, 5)):
            text = texts[at] or ""
            at += 1
            bucket, count = np.unique(hashes[a:b] % np.uint64(BUCKETS), return_counts=True)
            value = np.log1p(count)
            value /= max(1e-9, np.sqrt((value**2).sum()))
            stats = _statistics(text, int(b - a), len(np.unique(hashes[a:b])), len(windows))
            bins = [BUCKETS + _FIRST[k] + int(np.searchsorted(BINS[k], v, "right")) for k, v in stats.items()]
            yield (
                np.concatenate((bucket.astype(np.int64), bins)).astype(np.int32),
                np.concatenate((value, np.full(len(bins), 0.5))).astype(np.float32),
            )


class Machine:
    """Weights of the factorisation machine, with gradients of the logistic loss."""

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(7)
            flat = np.zeros(_SIZE, np.float32)
            flat[1 + N_FEATURES :] = rng.normal(0, 0.02, N_FEATURES * RANK)
        self.flat = flat
        self.bias, self.w, self.v = flat[:1], flat[1 : 1 + N_FEATURES], flat[1 + N_FEATURES :].reshape(N_FEATURES, RANK)

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, sums of v x) of rows that begin at ``starts``; no row is empty."""
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx**2).sum(1), starts)
        linear = np.add.reduceat(self.w[index] * value, starts)
        return self.bias[0] + linear + 0.5 * ((total**2).sum(1) - squares), total

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Adagrad over shuffled mini-batches."""
        rng, seen = np.random.default_rng(11), np.full(_SIZE, 1e-2, np.float32)
        seen_w, seen_v = seen[1 : 1 + N_FEATURES], seen[1 + N_FEATURES :].reshape(N_FEATURES, RANK)
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                index = np.concatenate([rows[i][0] for i in part])
                value = np.concatenate([rows[i][1] for i in part])
                lengths = np.array([len(rows[i][0]) for i in part])
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                margin, total = self.margins(index, value, starts)
                error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]
                e = np.repeat(error, lengths) / len(part)
                used, place = np.unique(index, return_inverse=True)
                g_w = np.bincount(place, e * value, len(used)) + 1e-6 * self.w[used]
                each = (e * value)[:, None] * (np.repeat(total, lengths, axis=0) - self.v[index] * value[:, None])
                g_v = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(RANK)], axis=1) + 1e-5 * self.v[used]
                g_0 = error.mean()
                seen[0] += g_0**2
                seen_w[used] += g_w**2
                seen_v[used] += g_v**2
                self.bias -= RATE * g_0 / np.sqrt(seen[0])
                self.w[used] -= RATE * g_w / np.sqrt(seen_w[used])
                self.v[used] -= RATE * g_v / np.sqrt(seen_v[used])

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of label 1."""
        index = np.concatenate([r[0] for r in rows])
        value = np.concatenate([r[1] for r in rows])
        starts = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])[:-1]))
        return 1 / (1 + np.exp(-np.clip(self.margins(index, value, starts)[0].astype(np.float64), -30, 30)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """The weights learned from labelled rows (``doc_id``, ``text``; ``doc_id``, label); None without rows."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).alias("__y"))
    known = known.filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1)).groupBy("__id").agg(F.max("__y").alias("__y"))
    share = min(1.0, train_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit("quality sample"), "__id"), F.lit(1_000_000))
    drawn = F.broadcast(known.filter(draw < int(share * 1_000_000 + 1)))  # about train_rows rows of two numbers
    sample = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("__id")).select("doc_id", "__y", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                index, value = zip(*features(b.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__y").cast(pa.int32()), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["id", "y", "index", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]
        if rows:
            rows.sort(key=lambda r: (r[0], len(r[2]), r[2]))
            machine = Machine()
            machine.fit([(np.array(r[2], np.int64), np.array(r[3], np.float32)) for r in rows], np.array([r[1] for r in rows], np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([machine.flat.tobytes()], pa.binary())], ["model"])

    described = sample.mapInArrow(describe, "id long, y int, index array<int>, value array<float>")
    made = described.repartition(1).mapInArrow(learn, "model binary").collect()
    return np.frombuffer(made[0][0], np.float32).copy() if made else None


def score(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns with the score of a text column."""
    if weights is None:
        return docs.withColumn(out, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        machine, texts, found = Machine(shared.value), list(texts), []
        for a in range(0, len(texts), 512):
            found.append(machine.scores(list(features(texts[a : a + 512]))))
        return pd.Series(np.concatenate(found) if found else np.empty(0))

    return docs.withColumn(out, of(text_of(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learned from the rows that are not held out."""
    weights = fit(docs, labels.filter(~held_out("doc_id")), "quality", train_rows)
    scored = score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
