"""Parsing and validity profiles on inline rows (FIXTURES.md section 4)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import (
    bucketize,
    parse_count,
    parse_money,
    parse_money_double,
    parse_rating,
    price_status,
    rating_status,
    round_text,
    round_to,
    thousands,
    valid_count,
    valid_price,
    valid_rating,
)


def one_col(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_price_text(spark):
    vals = ["₹1,299", "₹1,299.50", "1299", "₹ 1,299", ",", "FREE", "", None]
    rows = one_col(spark, vals).select(
        "v", valid_price("v").alias("ok"), parse_money("v").alias("dec"), parse_money_double("v").alias("dbl")
    ).collect()
    got = {r.v: (r.ok, r.dec, r.dbl) for r in rows}
    assert got["₹1,299"] == (True, Decimal("1299.00"), 1299.0)
    assert got["₹1,299.50"] == (True, Decimal("1299.50"), 1299.5)
    assert got["1299"][0] is True
    assert got["₹ 1,299"][0] is False and got["₹ 1,299"][1] == Decimal("1299.00")
    assert got[","] == (True, None, None)  # passes the pattern, parses to NULL
    assert got["FREE"] == (False, None, None)
    assert got[""][0] is False
    assert got[None][0] is None or got[None][0] is False


@pytest.mark.parametrize(
    "text,loose,sql,strict,sql_value,strict_value,coerce_value",
    [
        ("4", True, True, False, Decimal("4.00"), None, 4.0),
        ("4.5", True, True, True, Decimal("4.50"), 4.5, 4.5),
        ("5.", True, True, False, Decimal("5.00"), None, 5.0),
        ("45", True, True, False, None, None, 45.0),  # passes, overflows DECIMAL(3,2)
        ("6.0", True, False, False, Decimal("6.00"), None, 6.0),  # parses; the sql pattern rejects it
        ("4.25", True, True, False, Decimal("4.25"), None, 4.25),
        ("Get", False, False, False, None, None, None),
        ("", False, False, False, None, None, None),
    ],
)
def test_rating_profiles(spark, text, loose, sql, strict, sql_value, strict_value, coerce_value):
    r = one_col(spark, [text]).select(
        valid_rating("v", "loose").alias("loose"),
        valid_rating("v", "sql").alias("sql"),
        valid_rating("v", "strict").alias("strict"),
        parse_rating("v", "sql").alias("sv"),
        parse_rating("v", "strict").alias("tv"),
        parse_rating("v", "coerce").alias("cv"),
    ).first()
    assert (r.loose, r.sql, r.strict) == (loose, sql, strict)
    assert r.sv == sql_value
    assert r.tv == strict_value
    assert r.cv == coerce_value


def test_count_text(spark):
    vals = ["0", "1,234", ",", "Only 2 left", ""]
    rows = one_col(spark, vals).select("v", valid_count("v").alias("ok"), parse_count("v").alias("n")).collect()
    got = {r.v: (r.ok, r.n) for r in rows}
    assert got == {"0": (True, 0), "1,234": (True, 1234), ",": (True, None), "Only 2 left": (False, None), "": (False, None)}


def test_status_labels(spark):
    rows = spark.createDataFrame(
        [("4.2", "₹100"), ("", ""), (None, None), ("Get", "FREE")], "r string, p string"
    ).select(rating_status("r").alias("rs"), price_status("p").alias("ps")).collect()
    assert [(r.rs, r.ps) for r in rows] == [
        ("Valid Numeric", "Valid Price"),
        ("Missing", "Missing"),
        ("Missing", "Missing"),
        ("Invalid Format", "Invalid Format"),
    ]


def test_bucket_edges(spark):
    vals = [499.99, 500.0, 500.01, 1000.0, 2000.0, 5000.0, 0.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    left = bucketize("x", (500, 1000, 2000, 5000), ("a", "b", "c", "d", "e"))
    right = bucketize("x", (500, 1000, 2000, 5000), ("a", "b", "c", "d", "e"), right_closed=True, lower_bound=0)
    got = [(r.l, r.r) for r in df.select(left.alias("l"), right.alias("r")).collect()]
    assert got == [
        ("a", "a"),
        ("b", "a"),
        ("b", "b"),
        ("c", "b"),
        ("d", "c"),
        ("e", "d"),
        ("a", None),
        ("e", None),
    ]


def test_rounding_and_format(spark):
    df = spark.createDataFrame([(2.675, 1234.5, 2.5)], "a double, b double, c double")
    r = df.select(
        round_to("a", 2).alias("a2"),
        round_text("b", 2).alias("bt"),
        thousands("b").alias("bf"),
        thousands("c").alias("cf"),
        round_text(F.lit(45.0), 1).alias("pct"),
    ).first()
    assert r.a2 == 2.68  # half-up on the decimal value, not on the binary double
    assert r.bt == "1234.50"
    assert r.bf == "1,235"
    assert r.cf == "3"
    assert r.pct == "45.0"


def test_coerce_drops_what_is_not_a_plain_number(spark):
    from shelfwise.functions.parsing import parse_rating

    texts = ["4.5", " 4 ", "NaN", "Infinity", "4.5f", "12d", "1e1", "", None, "Get"]
    rows = spark.createDataFrame([(t,) for t in texts], "ratings string").select(parse_rating("ratings", "coerce").alias("r")).collect()
    assert [r.r for r in rows] == [4.5, 4.0, None, None, None, None, 10.0, None, None, None]
