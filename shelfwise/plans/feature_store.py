"""The feature table of P3, made once per application and read by P4-P8.

The table is written as Parquet to the shared folder (readers take only the columns they use), or persisted where no shared
folder is configured. Its key is the input (name and files) and the code that makes it, so other input or other code never
meets an old table. ``FeatureStore`` counts the open readers of each table: a table without readers is deleted as soon as a
table of another key is opened, and all are deleted by ``release_all``.
"""

from __future__ import annotations

import hashlib
import inspect
import threading
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from shelfwise.session import ensure_checkpoint_dir


class _Table:
    def __init__(self, frame: DataFrame, path: str | None):
        self.frame, self.path, self.readers = frame, path, 0

    def delete(self, spark: SparkSession) -> None:
        if self.path is None:
            self.frame.unpersist()
            return
        target = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class FeatureStore:
    """Tables by key, with their readers."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, _Table] = {}
        self._lock = threading.RLock()

    def key(self, name: str, source: DataFrame, code: Callable) -> str:
        """Content key: the name and files of the input and the source of the module that makes the table."""
        said = [name, *sorted(source.inputFiles()), inspect.getsource(inspect.getmodule(code))]
        return hashlib.sha256("\n".join(said).encode()).hexdigest()[:16]

    def open(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a key, made by ``build`` if it is not there; the returned frame is a reader until it is dropped."""
        with self._lock:
            if key not in self._tables:
                for old in [k for k, t in self._tables.items() if not t.readers]:
                    self._tables.pop(old).delete(self.spark)
                self._tables[key] = self._write(key, build())
            table = self._tables[key]
            table.readers += 1
            reader = table.frame.select("*")
            weakref.finalize(reader, self._closed, table)
            return reader

    def _write(self, key: str, made: DataFrame) -> _Table:
        folder = ensure_checkpoint_dir(self.spark)
        if folder is None:
            kept = made.persist(StorageLevel.MEMORY_AND_DISK)
            return _Table(kept, None)
        path = f"{folder.rstrip('/')}/features-{key}-{uuid.uuid4().hex}"
        made.write.parquet(path)
        return _Table(self.spark.read.schema(made.schema).parquet(path), path)

    def _closed(self, table: _Table) -> None:
        table.readers -= 1

    def tables(self) -> dict[str, int]:
        """Open tables and their numbers of readers."""
        return {k: t.readers for k, t in self._tables.items()}

    def release_all(self) -> None:
        """Delete every table."""
        with self._lock:
            for key in list(self._tables):
                self._tables.pop(key).delete(self.spark)


_stores: dict[str, FeatureStore] = {}


def store_of(spark: SparkSession) -> FeatureStore:
    """The store of the running application."""
    app = spark.sparkContext.applicationId
    if app not in _stores:
        _stores.clear()  # tables of an ended application are gone with its session
        _stores[app] = FeatureStore(spark)
    return _stores[app]
