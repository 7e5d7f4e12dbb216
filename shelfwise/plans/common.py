"""Shared row-level preparation for the SQL-family analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.parsing import (
    parse_count,
    parse_money,
    parse_rating,
    valid_count,
    valid_price,
    valid_rating,
)


def parsed(products: DataFrame) -> DataFrame:
    """Raw rows plus typed ``price``, ``original_price`` (DECIMAL(10,2)),
    ``rating`` (DECIMAL(3,2)), ``review_count`` (INT) and validity flags.

    Parsing is a projection: Catalyst prunes the unused parts per query.
    """
    return products.select(
        "*",
        parse_money("discount_price").alias("price"),
        parse_money("actual_price").alias("original_price"),
        parse_rating("ratings", "sql").alias("rating"),
        parse_count("no_of_ratings").alias("review_count"),
        valid_price("discount_price").alias("v_price"),
        valid_rating("ratings", "sql").alias("v_rating"),
        valid_count("no_of_ratings").alias("v_count"),
    )


def valid(df: DataFrame, *flags: str) -> DataFrame:
    """Keep rows whose named validity flags (``price``, ``rating``, ``count``) all hold."""
    cond = F.lit(True)
    for f in flags:
        cond = cond & F.col(f"v_{f}")
    return df.where(cond)


def d(col: str):
    """Column as DOUBLE (for arithmetic that both engines evaluate identically)."""
    return F.col(col).cast("double")
