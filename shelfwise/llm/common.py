"""Small helpers shared by the operators of this subpackage.

Words and lines follow one definition everywhere: white space is the ASCII set
``[\\x20\\x09-\\x0D]``, a word is a maximal run of other characters, and a NULL
text counts as the empty text.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as characters and as regular expressions.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application (as ``--py-files`` does)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="shelfwise-py-")) / "shelfwise.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters unchanged."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing, the checkpoint folder of the context is
    used; a local session without either (tests) gets a temporary folder. A
    cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shelfwise-llm-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables that one query writes to the shared folder and reads again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def store(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write a frame as Parquet and read it back: its lineage ends here."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a stored table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
