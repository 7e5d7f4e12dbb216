"""Inline catalogues that reach labels the fixture tables never produce."""

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import advanced, kpi
from shelfwise.schema import RAW_COLUMNS


def _rows(start, n, cat, sub, rating, reviews, price, actual):
    return [
        (start + i, f"{cat} item {i}", cat, sub, rating, reviews, price, actual, f"img{start + i}", f"link{start + i}")
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = (
        _rows(0, 60, "Cat Z", "S1", "4.8", "100", "₹50", "₹60")
        + _rows(1000, 12, "Cat Y", "S2", "2.0", "5", "₹100", "₹120")
        + _rows(2000, 20, "Cat X", "S3", "4.1", "10", "₹800", "₹900")
        + _rows(3000, 20, "Cat W", "S4", "3.9", "3,000", "₹10,000", "₹12,000")
    )
    schema = "product_id bigint, " + ", ".join(f"{c} string" for c in RAW_COLUMNS)
    return spark.createDataFrame(rows, schema)


def _label(df, key, value, col):
    return {r[key]: r[col] for r in df.collect()}[value]


def test_bcg_question_mark(catalogue):
    out = kpi.category_performance(catalogue)
    assert _label(out, "main_category", "Cat Z", "bcg_matrix") == "Question Mark"
    assert _label(out, "main_category", "Cat Z", "strategic_recommendation") == "Strategic decision: invest or divest"


def test_customer_champions_and_low_engagement(catalogue):
    out = kpi.satisfaction_nps(catalogue)
    assert _label(out, "main_category", "Cat Z", "customer_status") == "Customer Champions"
    assert _label(out, "main_category", "Cat Z", "action_plan") == "Leverage for growth and referrals"
    assert _label(out, "main_category", "Cat Y", "engagement_level") == "Low Engagement"
    assert _label(out, "main_category", "Cat Y", "nps_approx") == -100.0


def test_growing_category_and_top_performer(catalogue):
    assert _label(advanced.strategic_positions(catalogue), "main_category", "Cat Z", "strategic_position") == (
        "Growing Category"
    )
    assert _label(advanced.category_scoreboard(catalogue), "main_category", "Cat Z", "category_status") == (
        "Top Performer"
    )


def test_value_for_money_and_major_driver(catalogue):
    assert _label(kpi.pricing_intelligence(catalogue), "main_category", "Cat X", "positioning_strategy") == (
        "Value for Money"
    )
    rev = kpi.revenue_impact(catalogue)
    assert _label(rev, "main_category", "Cat W", "business_segment") == "Major Revenue Driver"
    assert _label(rev, "main_category", "Cat W", "revenue_index") == "6,000,000"


def test_price_similarity_and_trend(catalogue):
    comp = kpi.competition(catalogue)
    assert _label(comp, "main_category", "Cat Z", "pricing_dynamics") == "Price Similarity"
    assert _label(comp, "main_category", "Cat Z", "market_structure_type") == "Fragmented"
    trends = kpi.performance_trends(catalogue)
    assert _label(trends, "main_category", "Cat Z", "trend_status") == "Growing"


def test_zero_review_weighted_rating_is_null(spark):
    rows = _rows(0, 12, "Cat V", "S", "4.0", "0", "₹10", "₹12")
    schema = "product_id bigint, " + ", ".join(f"{c} string" for c in RAW_COLUMNS)
    df = spark.createDataFrame(rows, schema)
    out = kpi.satisfaction_nps(df).first()
    assert out.weighted_avg_rating is None
    seg = advanced.satisfaction_segments(df).first()
    assert seg.weighted_satisfaction_score is None


def test_deep_discount_is_unreachable(spark):
    # a price far below its neighbours is labelled 'Discount' (0.9 is tested before 0.8)
    rows = [(i, f"n{i}", "C", "S", "4.0", "1", "₹100", "₹100", "i", "l") for i in range(4)]
    rows.append((9, "cheap", "C", "S", "4.0", "1", "₹10", "₹10", "i", "l"))
    schema = "product_id bigint, " + ", ".join(f"{c} string" for c in RAW_COLUMNS)
    out = advanced.price_positions(spark.createDataFrame(rows, schema))
    assert out.where(F.col("product_id") == 9).first().pricing_position == "Discount"
