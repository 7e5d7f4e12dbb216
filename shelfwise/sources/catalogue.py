"""Readers for a raw product catalogue (text-typed columns, see ``schema.RAW_SCHEMA``)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.schema import PRODUCT_ID, RAW_COLUMNS, RAW_SCHEMA


def with_product_id(df: DataFrame) -> DataFrame:
    """Add a unique BIGINT ``product_id`` (tie-breaker only) when it is missing.

    ``monotonically_increasing_id`` is computed per partition on the executors:
    no driver round trip and no shuffle. It is stable for a given input split.
    """
    if PRODUCT_ID in df.columns:
        return df
    return df.withColumn(PRODUCT_ID, F.monotonically_increasing_id())


def _conform(df: DataFrame) -> DataFrame:
    """Project onto the raw schema: every raw column as STRING (missing -> NULL)."""
    cols = [
        (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c)
        for c in RAW_COLUMNS
    ]
    if PRODUCT_ID in df.columns:
        cols.append(F.col(PRODUCT_ID).cast("bigint"))
    return with_product_id(df.select(*cols))


def read_catalogue_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Read CSV file(s) / a directory / a glob with a header line.

    Columns are taken by their header names and read as text: no inference
    job, and a clean file cannot be typed differently from a dirty one. Raw
    columns that the header lacks are NULL; other columns are ignored. Input
    without a header, or whose header names no raw column, raises
    ``ValueError``. All files need one header: each file's is checked when it
    is read and another one fails the job. Use
    :func:`read_catalogue_csv_by_name` for files whose headers differ.
    """
    paths = [path] if isinstance(path, str) else list(path)
    try:
        df = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(paths)
    except AnalysisException as exc:  # PATH_NOT_FOUND, no file to read a header from
        raise ValueError(f"no CSV input found at {paths}") from exc
    if not set(df.columns) & set(RAW_COLUMNS):
        raise ValueError(f"the header at {paths} names no catalogue column: {df.columns}")
    return _conform(df)


def header_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file`` and ``header`` (first line) of every CSV file, from one distributed job; empty files have no row.

    Lines are read as text; each task keeps the first line of the files it opens, so one row per file is shuffled.
    """
    lines = spark.read.text(list(paths))
    first = lines.where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value"
    )
    return first.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def read_catalogue_csv_by_name(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union CSV files by column name, allowing missing columns: one read per distinct header.

    The headers of all files come from one job (:func:`header_lines`); files with the same header are read together, so the
    plan grows with the headers, not with the files. Every column is read as text.
    """
    if not paths:
        raise ValueError("no CSV files given")
    groups = header_lines(spark, paths).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    frames = [
        _conform(spark.read.option("header", True).option("inferSchema", False).csv([unquote(f) for f in g.files]))
        for g in groups.orderBy("header").collect()  # the driver lists the files anyway
    ]
    if not frames:
        raise ValueError(f"no CSV input found at {list(paths)}")
    return reduce(lambda a, x: a.unionByName(x, allowMissingColumns=True), frames)


def read_catalogue_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Read a Parquet catalogue and conform it to the raw text schema."""
    paths = [path] if isinstance(path, str) else list(path)
    try:
        df = spark.read.parquet(*paths)
    except AnalysisException as exc:
        raise ValueError(f"no Parquet input found at {paths}") from exc
    return _conform(df)


def register_catalogue(products: DataFrame, name: str = "products", parsed_name: str | None = "products_parsed") -> None:
    """Expose the catalogue to SQL as temp views (the stored table the reports query).

    ``name`` holds the raw text columns; ``parsed_name`` (optional) adds the
    typed ``price``, ``original_price``, ``rating``, ``review_count`` and the
    validity flags ``v_price``, ``v_rating``, ``v_count``.
    """
    from shelfwise.plans.common import parsed

    products.createOrReplaceTempView(name)
    if parsed_name:
        parsed(products).createOrReplaceTempView(parsed_name)
