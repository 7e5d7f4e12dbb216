"""Document fingerprints: bottom-k sketches of shingle hashes.

The fingerprint of a text is the ``k`` smallest distinct 64-bit hashes of its five-word shingles, sorted, as base64 of
big-endian numbers. Fewer than ``k`` hashes are the whole set. Two fingerprints merge into the fingerprint of the
union (the ``k`` smallest of both), and estimate

- resemblance: the share of the union's bottom k that both hold,
- containment of a in b: resemblance times distinct(union) / distinct(a),
- the number of distinct shingles: (k - 1) / k-th smallest hash as a fraction, or the exact count below k.

Texts without words (NULL, empty) have the empty fingerprint; two empty ones are alike (1), an empty and another one
are not (0). Words are split at ASCII white space, A-Z folded; a text of fewer than five words is one shingle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import text_of
from shelfwise.llm.hashing import buffers, shingle_sets

K = 128
WIDTH = 5
_SPAN = float(1 << 64)


def encode(hashes: np.ndarray) -> str:
    """A fingerprint as text."""
    return base64.b64encode(hashes.astype(">u8").tobytes()).decode()


def decode(fingerprint: str | None) -> np.ndarray:
    """The hashes of a fingerprint."""
    return np.frombuffer(base64.b64decode(fingerprint or ""), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The fingerprint of the union of both texts' shingles."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPAN / float(a[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact when both fingerprints hold their whole sets."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    union = np.delete(both, np.flatnonzero(twice) + 1)
    # Beyond a full fingerprint's last hash nothing is known of its set.
    if len(a) >= k or len(b) >= k:
        union = union[:k]
    if not len(union):
        return 0.0
    shared = both[1:][twice]
    return float(np.count_nonzero(shared <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def sketches(texts: list[str | None], k: int = K, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The hashes of each text's fingerprint."""
    for raws in buffers(texts):
        for found in shingle_sets(raws, width):
            yield found[:k]


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", k: int = K, width: int = WIDTH) -> DataFrame:
    """All rows and columns with the fingerprint of a text column."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(s) for s in sketches(list(texts), k, width)], dtype=object)

    return docs.withColumn(out, of(text_of(text_col)))


def merge_fingerprints(prints: DataFrame, keys: list[str], col: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per key: every task merges its own rows first, then the tasks' sketches meet.

    A key gets at most one row a task, so a key with a third of all rows is a group of bounded size.
    """
    schema = prints.select(*keys, col).schema

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for *key, value in frame.itertuples(index=False):
                key = tuple(None if pd.isna(x) else x for x in key)
                held[key] = merge(held.get(key, np.empty(0, np.uint64)), decode(value), k)
        if held:
            yield pd.DataFrame([(*key, encode(s)) for key, s in held.items()], columns=schema.names)

    def final(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.empty(0, np.uint64)
        for value in frame[col]:
            total = merge(total, decode(value), k)
        return frame.head(1)[schema.names].assign(**{col: encode(total)})

    partials = prints.select(*keys, col).mapInPandas(partial, schema)
    return partials.groupBy(*keys).applyInPandas(final, schema)


def with_neighbours(docs: DataFrame, zones: int) -> DataFrame:
    """Rows (``zone``, ``copy``, ``id``, ``text``): every row in its zone of ids, and each zone's first row once more
    (``copy`` 1) in the zone before it, so that in descending id order each row's successor is in its own zone.

    Zones are cut at quantiles of the ids (at most ``zones``), so the driver holds a few numbers per zone, and one
    shuffle of the texts suffices.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), text_of("text").alias("text"))
    ids = docs.select("id")
    at = [i / zones for i in range(1, zones)]
    cuts = ids.agg(F.percentile_approx("id", F.lit(at), F.lit(100 * zones))).first()[0] if at else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def zone_of(i: pd.Series) -> pd.Series:
        # Descending ids: zone 0 holds the largest. NULL ids come last.
        known = i.notna().to_numpy()
        out = np.full(len(i), len(cuts), np.int32)
        out[known] = len(cuts) - np.searchsorted(cuts, i[known].to_numpy(np.int64), "left")
        return pd.Series(out)

    heads = ids.groupBy(zone_of("id").alias("zone")).agg(F.max("id").alias("head")).collect()  # a row per zone
    heads = sorted(((r["zone"], r["head"]) for r in heads))
    before = {zone: heads[i - 1][0] for i, (zone, _) in enumerate(heads)}
    head_of = dict(heads)

    @F.pandas_udf("array<int>")
    def places(zone: pd.Series, i: pd.Series) -> pd.Series:
        out = []
        for z, x in zip(zone, i):
            x = None if pd.isna(x) else int(x)
            out.append([z, before[z]] if head_of.get(z) == x and z in head_of else [z])
        return pd.Series(out)

    zoned = docs.withColumn("zone", zone_of("id"))
    return zoned.select(F.posexplode(places("zone", "id")).alias("copy", "zone"), "id", "text")


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, containment_in_next double, distinct_shingles double"
)


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many first code points of the following text, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_report(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text, in descending order of doc_id (the last one's next is the first)."""
    spark = docs.sparkSession
    zones = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_neighbours(docs, zones).repartition(zones, "zone")
    rows = rows.sortWithinPartitions("zone", "copy", F.col("id").desc_nulls_last(), "text")

    def finished(pending: list[tuple]) -> pd.DataFrame:
        """pending: (id, text, next text)"""
        texts = [t for _, t, _ in pending]
        changed = [edited(t, n) for _, t, n in pending]
        # The next text is the following row's own text, but for the last one.
        own = list(sketches([*texts, pending[-1][2]], k, width))
        new = list(sketches(changed, k, width))
        return pd.DataFrame(
            {
                "doc_id": pd.array([i for i, _, _ in pending], "Int64"),
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                "fingerprint": [encode(s) for s in own[:-1]],
                "edited_fingerprint": [encode(s) for s in new],
                "near_edited": [resemblance(a, b, k) for a, b in zip(own, new)],
                "near_next": [resemblance(a, b, k) for a, b in zip(own, own[1:])],
                "containment_in_next": [containment(a, b, k) for a, b in zip(own, own[1:])],
                "distinct_shingles": [distinct(a, k) for a in own[:-1]],
            }
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the latest own row, whose next is still to come
        pending, size = [], 0
        for batch in batches:
            for zone, copy, i, text in zip(*[batch.column(c).to_pylist() for c in ("zone", "copy", "id", "text")]):
                if last is not None and last[0] == zone:
                    pending.append((last[1], last[2], text))
                    size += len(last[2])
                last = None if copy else (zone, i, text)
                # A zone's first copy ends its chain of texts, in which each next text is the following row's own.
                if pending and (copy or size > 4_000_000):
                    yield out_batch(finished(pending))
                    pending, size = [], 0
        if pending:
            yield out_batch(finished(pending))

    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in _OUT.split(", ")])

    def out_batch(frame: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)

    return rows.mapInArrow(walk, _OUT)
