"""Exploration and data-quality analyses.

Each function takes the raw catalogue (text columns + ``product_id``) and
returns a DataFrame. Several of these reports are N ``UNION ALL`` scans of
one table; here they are one aggregate followed by an ``inline`` of literal
structs (one scan).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import (
    bucketize,
    has_text,
    is_present,
    ordinal,
    pct,
    price_status,
    rating_status,
    round_text,
    round_to,
)
from shelfwise.fixed import DUPLICATE_METRICS, OVERVIEW_METRICS, QUALITY_CARD_PREFIXES, QUALITY_CARD_SECTION
from shelfwise.operators import metrics_long, one_row, with_percentiles, with_share
from shelfwise.plans.common import parsed, valid
from shelfwise.schema import EXPLORATION_DUPLICATE_KEYS, PRICE_BUCKET_EDGES, PRICE_BUCKET_LABELS_SQL

RAW_VIEW_COLUMNS = ("name", "main_category", "sub_category", "ratings", "no_of_ratings", "discount_price", "actual_price")


def dataset_overview(products: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Records, distinct categories / sub-categories, rows with ratings / prices.

    ``approx_distinct`` uses HyperLogLog++ instead of exact distinct counts.
    """
    distinct = F.approx_count_distinct if approx_distinct else F.countDistinct
    one = products.agg(
        F.count(F.lit(1)).alias("n"),
        distinct("main_category").alias("cats"),
        distinct("sub_category").alias("subs"),
        F.count_if(is_present("ratings")).alias("rated"),
        F.count_if(is_present("discount_price")).alias("priced"),
    )
    values = [F.col(c) for c in ("n", "cats", "subs", "rated", "priced")]
    return metrics_long(one, list(zip(OVERVIEW_METRICS, values)))


def format_check(products: DataFrame, limit: int | None = None) -> DataFrame:
    """Per-row format status of rating and price text.

    The whole table by default; ``limit`` keeps the first rows by ``product_id``
    (a preview, as in an interactive check).
    """
    out = products.select(
        "product_id",
        *RAW_VIEW_COLUMNS,
        rating_status("ratings").alias("ratings_status"),
        price_status("discount_price").alias("price_status"),
    )
    if limit is not None:
        out = out.orderBy("product_id").limit(limit)
    return out


def missing_profile(
    products: DataFrame,
    columns: Sequence[tuple[str, bool]] = (
        ("name", False),
        ("main_category", False),
        ("ratings", True),
        ("discount_price", True),
    ),
) -> DataFrame:
    """Per column total, non-missing, missing and missing % (one scan).

    ``columns`` holds ``(name, empty_is_missing)``.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c, empty_missing in columns:
        present = is_present(c) if empty_missing else F.col(c).isNotNull()
        aggs.append(F.count_if(present).alias(f"_nn_{c}"))
    one = products.agg(*aggs)
    structs = []
    for c, _ in columns:
        nn = F.col(f"_nn_{c}")
        structs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("_n").alias("total_records"),
                nn.alias("non_null_count"),
                (F.col("_n") - nn).alias("null_count"),
                round_to(pct(F.col("_n") - nn, F.col("_n")), 2).alias("null_percentage"),
            )
        )
    return one.select(F.inline(F.array(*structs)))


def duplicate_summary(products: DataFrame, keys: Sequence[str] = EXPLORATION_DUPLICATE_KEYS) -> DataFrame:
    """Number of duplicate key groups and the records they hold (NULL keys group together)."""
    groups = products.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_count")).where("duplicate_count > 1")
    one = groups.agg(F.count(F.lit(1)).alias("g"), F.sum("duplicate_count").alias("r"))
    return metrics_long(one, list(zip(DUPLICATE_METRICS, [F.col("g"), F.col("r")])))


def category_distribution(products: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """E5: products per category, share of all rows, distinct sub-categories.

    The denominator (all rows, NULL category included) is the sum of the group
    counts, so the table is scanned once. ``approx_distinct`` counts
    sub-categories with HyperLogLog++.
    """
    distinct = F.approx_count_distinct if approx_distinct else F.countDistinct
    groups = products.groupBy("main_category").agg(
        F.count(F.lit(1)).alias("product_count"),
        distinct("sub_category").alias("subcategory_count"),
    )
    total = one_row(groups.agg(F.sum("product_count").alias("_total")))
    return (
        groups.crossJoin(total)
        .where(F.col("main_category").isNotNull())
        .select(
            "main_category",
            "product_count",
            round_to(pct(F.col("product_count"), F.col("_total")), 2).alias("percentage"),
            "subcategory_count",
        )
        .orderBy(F.col("product_count").desc(), "main_category")
    )


def price_by_category(products: DataFrame, min_products: int = 10, exact: bool = True) -> DataFrame:
    """Price statistics per category (median, sample stddev), >= ``min_products``.

    ``exact=False`` takes the approximate median (bounded memory per group).
    """
    rows = parsed(products).where(is_present("discount_price") & F.col("v_price"))
    price = F.col("price")
    cats = (
        rows.groupBy("main_category")
        .agg(
            F.count(F.lit(1)).alias("product_count"),
            F.min(price).cast("double").alias("min_price"),
            F.max(price).cast("double").alias("max_price"),
            round_to(F.avg(price), 2).alias("avg_price"),
            round_to(F.stddev_samp(price.cast("double")), 2).alias("price_stddev"),
        )
        .where(F.col("product_count") >= min_products)
    )
    return (
        with_percentiles(cats, rows, ["main_category"], {"_median": (price, 0.5)}, exact)
        .select("main_category", "product_count", "min_price", "max_price", "avg_price", round_to("_median", 2).alias("median_price"), "price_stddev")
        .orderBy(F.col("avg_price").desc(), "main_category")
    )


def rating_by_category(products: DataFrame, min_products: int = 10, exact: bool = True) -> DataFrame:
    """Rating statistics per category; review count need only be non-empty."""
    rows = parsed(products).where(is_present("ratings") & F.col("v_rating") & is_present("no_of_ratings"))
    r = F.col("rating")
    cats = (
        rows.groupBy("main_category")
        .agg(
            F.count(F.lit(1)).alias("rated_products"),
            F.min(r).cast("double").alias("min_rating"),
            F.max(r).cast("double").alias("max_rating"),
            round_to(F.avg(r), 2).alias("avg_rating"),
            F.sum("review_count").cast("bigint").alias("total_reviews"),
            round_to(F.avg("review_count"), 0).alias("avg_reviews_per_product"),
        )
        .where(F.col("rated_products") >= min_products)
    )
    shown = ("main_category", "rated_products", "min_rating", "max_rating", "avg_rating")
    return (
        with_percentiles(cats, rows, ["main_category"], {"_median": (r, 0.5)}, exact)
        .select(*shown, round_to("_median", 2).alias("median_rating"), "total_reviews", "avg_reviews_per_product")
        .orderBy(F.col("avg_rating").desc(), "main_category")
    )


def default_quality_rules():
    """The seven usable-field checks of the row quality score."""
    return [
        has_text("name"),
        has_text("main_category"),
        F.col("v_rating"),
        F.col("v_price"),
        F.col("v_count"),
        has_text("image"),
        has_text("link"),
    ]


def quality_score_expr(rules=None):
    """Row quality score: one point per rule that holds (NULL counts as not holding)."""
    total = None
    for f in rules if rules is not None else default_quality_rules():
        term = F.coalesce(f, F.lit(False)).cast("int")
        total = term if total is None else total + term
    return total


def quality_histogram(products: DataFrame, rules=None) -> DataFrame:
    """Distribution of the 0-7 row quality score (share of all rows); ``rules`` overrides the checks."""
    scored = parsed(products).select(quality_score_expr(rules).alias("quality_score"))
    groups = scored.groupBy("quality_score").agg(F.count(F.lit(1)).alias("product_count"))
    return with_share(groups, "product_count", "_share").select(
        F.col("quality_score").cast("bigint").alias("quality_score"),
        "product_count",
        round_to("_share", 2).alias("percentage"),
    ).orderBy(F.col("quality_score").desc())


def price_rating_buckets(products: DataFrame, min_products: int = 5) -> DataFrame:
    """Category x price bucket (left-closed 500/1000/2000/5000): count, avg rating, avg reviews."""
    rows = valid(parsed(products), "price", "rating", "count")
    bucket = bucketize("price", PRICE_BUCKET_EDGES, PRICE_BUCKET_LABELS_SQL)
    return (
        rows.groupBy("main_category", bucket.alias("price_bucket"))
        .agg(
            F.count(F.lit(1)).alias("product_count"),
            round_to(F.avg("rating"), 2).alias("avg_rating"),
            round_to(F.avg("review_count"), 0).alias("avg_reviews"),
        )
        .where(F.col("product_count") >= min_products)
        .orderBy("main_category", ordinal("price_bucket", PRICE_BUCKET_LABELS_SQL))
    )


def quality_card(products: DataFrame) -> DataFrame:
    """One-row data-quality card of formatted strings."""
    p = parsed(products)
    one = p.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("main_category").alias("cats"),
        F.count_if(F.col("v_rating")).alias("rated"),
        F.count_if(F.col("v_price")).alias("priced"),
        F.count_if(F.col("v_rating") & F.col("v_price")).alias("complete"),
    )

    def cov(label: str, c: str):
        return F.concat(F.lit(label), round_text(pct(F.col(c), F.col("n")), 1), F.lit("%"))

    total, cats, rating, price, complete = QUALITY_CARD_PREFIXES
    return one.select(
        F.lit(QUALITY_CARD_SECTION).alias("report_section"),
        F.concat(F.lit(total), F.col("n").cast("string")).alias("metric_1"),
        F.concat(F.lit(cats), F.col("cats").cast("string")).alias("metric_2"),
        cov(rating, "rated").alias("metric_3"),
        cov(price, "priced").alias("metric_4"),
        cov(complete, "complete").alias("metric_5"),
    )
