"""Line deduplication over levelled sorted runs of line hashes.

A *run* is a table sorted by line hash (128 bits) with one row per key: number of documents that hold it and the
largest doc_id among them, in the batch that brought the key. ``LineRuns`` keeps the runs in levels, as a log-structured
tree does:

- ``add`` merge-anti-joins the keys of a new batch with the runs. Keys that no run holds become a run of level 0, so runs
  have no key in common; the others are *repeats*, kept aside with what the run says of them;
- when a level holds ``fanout`` runs they are merged into one run of the next level, so a key is rewritten once per level,
  not once per batch;
- ``frequent`` adds up the repeats: the keys of ``min_docs`` documents or more, without a pass over the other keys;
- ``stale`` gives the (document, line) pairs that the frequent keys do not let stand.

``ingest`` is the incremental form: the batch loses what the runs hold already and is then added. ``dedup_lines`` takes a
whole table: its parts go through the runs batch after batch, and a closing pass drops the lines, since only then the
number of documents and the largest id of every key are known.

A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of fewer than ``min_chars``
code points are never dropped. A key held by ``min_docs`` documents or more keeps its lines only in the largest doc_id
that holds it (all of them there); every row counts as a document, so of repeated rows with that doc_id all keep it. A
NULL doc_id is smaller than any other. A NULL or empty text is one empty line and stays empty. A text of any length is
hashed whole, line by line, in one task.

Hot lines: a document counts a key once, partial aggregates meet in the shuffle before a batch meets the runs, and only
narrow rows (hash, doc_id) move; the documents of one frequent line are dealt to ``SALTS`` tasks of the closing join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch, text_of
from shelfwise.llm.hashing import buffers, line_hashes

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 4
BATCHES = 8
_KEY = ["__h1", "__h2"]
#: Tasks that the documents of one frequent line are dealt to.
SALTS = 16
#: Order of a NULL doc_id among the ids.
_LOWEST = -(2**63)


def _rank_id(col: str = "__id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(_LOWEST))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (``__id``, key hashes) with each long key of a document once. ``docs`` has ``__id`` (long) and ``__text``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__id").to_pylist()
            at = 0
            for raws in buffers(batch.column("__text").to_pylist()):
                of, rows = [], []
                for hashes, lengths in line_hashes(raws):
                    long = hashes[lengths >= min_chars]
                    if len(long):
                        long = np.unique(long, axis=0) if len(long) > 1 else long
                        rows.append(long)
                        of += [ids[at]] * len(long)
                    at += 1
                if rows:
                    made = np.concatenate(rows).view(np.int64)
                    columns = [pa.array(of, pa.int64()), pa.array(made[:, 0]), pa.array(made[:, 1])]
                    yield pa.RecordBatch.from_arrays(columns, ["__id", *_KEY])

    return docs.select("__id", "__text").mapInArrow(keys, "__id long, __h1 long, __h2 long")


class LineRuns:
    """Levels of sorted runs in the shared folder, no two with a common key, and the repeats that met them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.scratch = Scratch(spark, "line-runs")
        self.fanout, self.min_chars, self.min_docs = fanout, min_chars, min_docs
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        full = self.levels[level]
        if len(full) >= self.fanout:
            self.levels[level] = []
            self._push(self.scratch.store(_merged(full).sortWithinPartitions(*_KEY)), level + 1)
            for old in full:
                self.scratch.drop(old)

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, keys: DataFrame) -> None:
        """Anti-join the line keys of one batch of documents with the runs and add what is left as a run."""
        batch = keys.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("docs"), F.max(_rank_id()).alias("last"))
        runs = self._runs()
        if not runs:
            self._push(self.scratch.store(batch.sortWithinPartitions(*_KEY)), 0)
            return
        held = _all(runs).select(*_KEY, F.col("docs").alias("run_docs"), F.col("last").alias("run_last"))
        met = batch.join(held, _KEY, "left").withColumn("__new", F.col("run_docs").isNull())
        # One write for both: new keys and repeats are folders of their own.
        stored = self.scratch.store(met.sortWithinPartitions("__new", *_KEY), partition_by="__new")
        self.repeats.append(stored.filter(~F.col("__new")).drop("__new"))
        run = stored.filter("__new").select(*_KEY, "docs", "last")
        run._scratch_path = f"{stored._scratch_path}/__new=true"
        self._push(run, 0)

    def add_batches(self, keys: DataFrame, batches: int) -> DataFrame:
        """Add the line keys of many documents, the parts of the table as ``batches`` batches one after the other.

        Every task hashes documents of one batch, so the keys are stored by batch without a shuffle. They are returned as stored.
        """
        keys = keys.withColumn("__batch", F.pmod(F.spark_partition_id(), F.lit(batches)))
        stored = self.scratch.store(keys, partition_by="__batch")
        for (batch,) in sorted(stored.select("__batch").distinct().collect()):  # ``batches`` numbers at most
            self.add(stored.filter(F.col("__batch") == batch))
        return stored.drop("__batch")

    def current(self) -> DataFrame | None:
        """All runs and repeats as one: a row per key, with all its documents."""
        runs = self._runs()
        return _merged(runs + self.repeats) if runs else None

    def frequent(self) -> DataFrame | None:
        """The keys of ``min_docs`` documents or more. A key that no later batch repeats is frequent by its run alone."""
        runs = self._runs()
        if not runs:
            return None
        alone = _all(runs).filter(F.col("docs") >= self.min_docs)
        alone = alone.select(*_KEY, F.lit(0).cast("long").alias("docs"), "last", F.col("docs").alias("run_docs"), F.col("last").alias("run_last"))
        rows = alone
        for r in self.repeats:
            rows = rows.unionByName(r)
        summed = rows.groupBy(*_KEY).agg(
            (F.sum("docs") + F.max("run_docs")).alias("docs"), F.greatest(F.max("last"), F.max("run_last")).alias("last")
        )
        return summed.filter(F.col("docs") >= self.min_docs)

    def stale(self, keys: DataFrame) -> DataFrame:
        """The line keys (``__id``, hashes) that the frequent keys do not let stand."""
        frequent = self.frequent()
        if frequent is None:
            return keys.limit(0)
        # A line that a third of all documents hold is dealt to SALTS tasks by its documents; the few frequent keys are repeated.
        frequent = frequent.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = keys.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
        return salted.join(frequent, [*_KEY, "__salt"]).filter(_rank_id() < F.col("last")).select("__id", *_KEY)

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Drop from a batch (``__id``, ``__text``) the lines that ``min_docs`` or more documents of earlier batches hold,
        whatever their ids, then add the batch. The result is stored."""
        keys = self.scratch.store(line_keys(docs, self.min_chars))
        frequent = self.frequent()
        held = keys.limit(0) if frequent is None else keys.join(frequent, _KEY).select("__id", *_KEY)
        out = self.scratch.store(without_lines(docs, held, self.min_chars))
        self.add(keys)
        return out


def _all(runs: list[DataFrame]) -> DataFrame:
    out = runs[0].select(*_KEY, "docs", "last")
    for r in runs[1:]:
        out = out.unionByName(r.select(*_KEY, "docs", "last"))
    return out


def _merged(runs: list[DataFrame]) -> DataFrame:
    return _all(runs).groupBy(*_KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))


def without_lines(docs: DataFrame, stale: DataFrame, min_chars: int) -> DataFrame:
    """``docs`` with ``__kept`` (the text without its stale lines), ``__lines`` and ``__dropped``."""
    per_doc = stale.groupBy(F.col("__id").alias("__of")).agg(F.collect_set(F.struct(*_KEY)).alias("__stale"))
    joined = docs.join(per_doc, F.col("__id").eqNullSafe(F.col("__of")), "left").drop("__of")

    @F.pandas_udf("struct<kept: string, lines: long, dropped: long>")
    def drop(texts: pd.Series, stales: pd.Series) -> pd.DataFrame:
        kept, count, dropped = [], [], []
        stales = list(stales)
        for raws in buffers(texts):
            # Only texts with stale lines are hashed again.
            some = [raw for raw, stale in zip(raws, stales[len(kept) :]) if stale is not None]
            hashed = line_hashes(some) if some else iter(())
            for raw, stale in zip(raws, stales[len(kept) : len(kept) + len(raws)]):
                lines = raw.count(b"\n") + 1
                gone = 0
                if stale is not None:
                    out = {(s["__h1"], s["__h2"]) for s in stale}
                    hashes, lengths = next(hashed)
                    stays = [n < min_chars or tuple(h) not in out for h, n in zip(hashes.view(np.int64).tolist(), lengths)]
                    gone = lines - sum(stays)
                    raw = b"\n".join(x for x, stay in zip(raw.split(b"\n"), stays) if stay)
                kept.append(raw.decode("utf-8", "surrogatepass"))
                count.append(lines)
                dropped.append(gone)
        return pd.DataFrame({"kept": kept, "lines": count, "dropped": dropped})

    done = joined.withColumn("__done", drop("__text", "__stale"))
    return done.select(
        *docs.columns,
        F.col("__done")["kept"].alias("__kept"),
        F.col("__done")["lines"].alias("__lines"),
        F.col("__done")["dropped"].alias("__dropped"),
    )


def dedup_lines(
    docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS, batches=BATCHES, fanout=FANOUT
) -> DataFrame:
    """All rows with ``__kept``, ``__lines`` and ``__dropped``: batch after batch meets the runs, then frequent lines go."""
    docs = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__text", text_of(text_col))
    runs = LineRuns(docs.sparkSession, fanout, min_chars, min_docs)
    keys = runs.add_batches(line_keys(docs, min_chars), batches)
    return without_lines(docs, runs.stale(keys), min_chars).drop("__id", "__text")


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text of every row."""
    done = dedup_lines(docs.select("doc_id", "text"), **options)
    return done.select(
        "doc_id",
        F.col("__lines").alias("n_lines"),
        F.col("__dropped").cast("long").alias("n_dropped"),
        F.sha2(F.encode("__kept", "UTF-8"), 256).alias("kept_sha256"),
    )


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with their repeated lines gone and ``n_chars`` (where there is one) counted anew; columns as before."""
    done = dedup_lines(docs, **options).withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("__kept").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)
