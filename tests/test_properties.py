"""Properties of the analyses on the sf0.01 fixture."""

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import advanced, dashboard, exploration, features
from shelfwise.plans.common import parsed, valid
from shelfwise.sources import load_products

from .conftest import SF_MEDIUM


@pytest.fixture(scope="module")
def products(spark):
    return load_products(spark, SF_MEDIUM)


def test_quality_histogram_counts_every_row(products):
    hist = exploration.quality_histogram(products)
    assert hist.agg(F.sum("product_count")).first()[0] == products.count()
    assert abs(hist.agg(F.sum("percentage")).first()[0] - 100.0) < 0.05


def test_category_shares_add_up(products):
    dist = exploration.category_distribution(products)
    non_null = products.where(F.col("main_category").isNotNull()).count()
    total = dist.agg(F.sum("product_count")).first()[0]
    assert total == non_null
    share = dist.agg(F.sum("percentage")).first()[0]
    assert abs(share - non_null * 100.0 / products.count()) < 0.2


def test_cohort_shares_and_sizes(products):
    cohorts = advanced.performance_cohorts(products)
    n_valid = valid(parsed(products), "price", "rating", "count").count()
    assert cohorts.agg(F.sum("total_products")).first()[0] == n_valid
    assert abs(cohorts.agg(F.sum("market_share_percent")).first()[0] - 100.0) < 0.05
    assert cohorts.agg(F.sum("cohort_count")).first()[0] <= 64


def test_every_row_has_one_recommendation(products):
    rows = advanced.price_positions(products)
    n = valid(parsed(products), "price", "rating").count()
    assert rows.count() == n
    assert rows.where(F.col("pricing_recommendation").isNull() | F.col("pricing_position").isNull()).count() == 0
    assert rows.select("product_id").distinct().count() == n


def test_clean_is_idempotent(products):
    once = features.clean(products)
    twice = features.clean(once.select(*products.columns))
    assert once.count() == twice.count()
    assert once.select("product_id").exceptAll(twice.select("product_id")).count() == 0


def test_dedupe_keeps_lowest_id(products):
    deduped = features.dedupe(products)
    keys = ["name", "main_category", "discount_price"]
    expected = products.groupBy(*keys).agg(F.min("product_id").alias("product_id")).select("product_id")
    assert deduped.select("product_id").exceptAll(expected).count() == 0
    assert deduped.count() == expected.count()


def test_correlation_matrix_mllib_matches_pairwise(products):
    d = dashboard.load_clean(products)
    m = dashboard.correlation_matrix_mllib(d).first()[0].toArray()
    pairs = {(r.x, r.y): r.corr for r in dashboard.correlation_matrix(d).collect()}
    names = dashboard.CORRELATION_MEASURES
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert abs(m[i][j] - pairs[(a, b)]) < 1e-9
