"""File-stream ingestion of raw catalogue CSV files into a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.functions import (
    parse_count,
    parse_money,
    parse_rating,
    valid_count,
    valid_price,
    valid_rating,
)
from shelfwise.schema import PRODUCT_ID, RAW_COLUMNS, RAW_SCHEMA

# product_id = batch_id << 42 | row number within the micro-batch (dense, so any number of partitions fits).
_BATCH_SHIFT = 42
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def catalogue_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame over CSV files (header line, all-text schema) landing in ``source_dir``.

    A file whose header differs from the raw schema fails the stream instead of filling the wrong columns.
    """
    reader = spark.readStream.schema(RAW_SCHEMA).option("header", True).option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(source_dir)


def _with_row_number(batch: DataFrame) -> DataFrame:
    """``_row``: 0, 1, 2, ... over the batch. The partition sizes (one row each) give each partition its start."""
    rows = batch.withColumn("_part", F.spark_partition_id())
    rows = rows.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn("_row", F.col("_start") + F.col("_row"))


def _prepare(batch: DataFrame, batch_id: int) -> DataFrame:
    pid = F.lit(batch_id).cast("bigint") * F.lit(1 << _BATCH_SHIFT) + F.col("_row")
    return _with_row_number(batch).select(
        pid.alias(PRODUCT_ID),
        *RAW_COLUMNS,
        parse_money("discount_price").alias("price"),
        parse_money("actual_price").alias("original_price"),
        parse_rating("ratings", "sql").alias("rating"),
        parse_count("no_of_ratings").alias("review_count"),
        valid_price("discount_price").alias("v_price"),
        valid_rating("ratings", "sql").alias("v_rating"),
        valid_count("no_of_ratings").alias("v_count"),
    )


def ingest_catalogue(
    spark: SparkSession,
    source_dir: str,
    table_path: str,
    checkpoint_location: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start appending new catalogue files to the Parquet table at ``table_path``.

    Each micro-batch has its own folder (``batch_id=N``), which a retry of the
    batch overwrites; the stream's checkpoint (by default under the cluster's
    shared ``spark.checkpoint.dir``) records the files already taken, so a
    restarted query resumes without duplicates.
    ``available_now`` processes what is there and stops (batch-like runs).
    """
    if checkpoint_location is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("set spark.checkpoint.dir or pass checkpoint_location")
        checkpoint_location = f"{shared.rstrip('/')}/shelfwise-ingest"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        _prepare(batch, batch_id).write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}")

    writer = (
        catalogue_stream(spark, source_dir, max_files_per_trigger)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_location)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
