"""Session helpers for tests, benchmarks and scripts (library code never builds a session)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, app: str = "shelfwise") -> SparkSession:
    """A local session configured the way the analyses expect (tests / bench)."""
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Return the shared checkpoint directory, configuring the context from ``spark.checkpoint.dir``.

    The cluster names the shared folder in ``spark.checkpoint.dir``; it is
    only set here from ``fallback`` when nothing is configured (tests).
    Returns None when there is no shared folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    target = configured or fallback
    if target:
        sc.setCheckpointDir(target)
        return sc.getCheckpointDir()
    return None


def test_checkpoint_dir() -> str:
    """A fresh private folder for local tests only (never used on a cluster)."""
    return tempfile.mkdtemp(prefix="shelfwise-ckpt-", dir="/tmp")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage for a frame that is reused many times (model fitting).

    Uses a reliable checkpoint in the shared checkpoint folder when one is
    configured; otherwise persists to memory and disk (recomputable from
    lineage if an executor is lost). Never a local checkpoint.
    """
    if ensure_checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
