"""Feature pipeline (P2, P3, P7a-c, P8a-c): cleaning, row features, analytics and insights.

Thresholds that the pipeline derives from the data (price and review
percentiles) are one-row aggregates cross-joined to the rows (broadcast of a
single row) instead of values collected to the driver, so the whole pipeline
stays one lazy plan. Category statistics are ``groupBy`` + byte-planned
broadcast join, and in-category ranks use the distributed row number, so a
large category never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed
from shelfwise.functions import (
    bucketize,
    first_match,
    parse_count,
    parse_money_double,
    parse_rating,
    round_to,
    threshold_labels,
)
from shelfwise.operators import group_percentiles, group_row_number, join_group_stats, one_row, top_n_per_group
from shelfwise.schema import PIPELINE_DUPLICATE_KEYS, PRICE_BUCKET_EDGES, PRICE_BUCKET_LABELS_PIPELINE, PRODUCT_ID
from shelfwise.session import materialize

CLEAN_COLUMNS = ("discount_price_clean", "actual_price_clean", "ratings_clean", "no_of_ratings_clean")


def mean_fixed(col: str | Column, scale: int = 2) -> Column:
    """Mean of values with at most ``scale`` decimals, exact and order independent.

    Values are summed as integers of ``10**-scale`` units and divided once, so
    every engine and every summation order gives the same double.
    """
    c = F.col(col) if isinstance(col, str) else col
    unit = 10**scale
    total = F.sum(F.round(c * F.lit(float(unit))).cast("bigint"))
    return total.cast("double") / (F.count(c).cast("double") * F.lit(float(unit)))


def dedupe(products: DataFrame, keys: Sequence[str] = PIPELINE_DUPLICATE_KEYS) -> DataFrame:
    """Keep one row per key (the lowest ``product_id``); NULL keys group together.

    A lone ``ROW_NUMBER() <= 1`` per key, which Catalyst plans as a partial
    WindowGroupLimit before the shuffle: each map task forwards at most one
    row per key, so even a key holding a large share of the rows never
    gathers in one task. Unlike an aggregate over a struct of all columns,
    columns that later steps do not use are pruned from the scan.
    """
    first = top_n_per_group(products, keys, [F.col(PRODUCT_ID).asc()], 1, "_dup_rank")
    return first.drop("_dup_rank")


def clean(products: DataFrame, keys: Sequence[str] = PIPELINE_DUPLICATE_KEYS, profile: str = "strict") -> DataFrame:
    """Dedupe, parse prices / ratings / counts, keep usable rows; ``profile`` names the rating format (``parse_rating``)."""
    rows = dedupe(products, keys).select(
        "*",
        parse_money_double("discount_price").alias("discount_price_clean"),
        parse_money_double("actual_price").alias("actual_price_clean"),
        parse_rating("ratings", profile).cast("double").alias("ratings_clean"),
        parse_count("no_of_ratings").alias("no_of_ratings_clean"),
    )
    dp, r = F.col("discount_price_clean"), F.col("ratings_clean")
    return rows.where(
        dp.isNotNull()
        & r.isNotNull()
        & F.col("no_of_ratings_clean").isNotNull()
        & F.col("main_category").isNotNull()
        & (dp > 0)
        & (r >= 1)
        & (r <= 5)
    )


def quality_score(rating: Column, reviews: Column) -> Column:
    return rating * F.lit(0.6) + (F.log(reviews.cast("double") + F.lit(1.0)) / F.lit(10.0)) * F.lit(0.4)


def features(cleaned: DataFrame, with_ranks: bool = True) -> DataFrame:
    """Row features of the cleaned catalogue.

    ``with_ranks=False`` skips the two in-category ranks (each a range sort of
    the whole table) for consumers that do not use them.
    """
    # Three readers (rows, global thresholds, category means): materialise the
    # cleaned rows once instead of deduplicating the catalogue three times.
    cleaned = materialize(cleaned)
    dp, ap = F.col("discount_price_clean"), F.col("actual_price_clean")
    r, n = F.col("ratings_clean"), F.col("no_of_ratings_clean")
    wanted = {"_price_p33": (dp, 0.33), "_price_p66": (dp, 0.66), "_reviews_median": (n.cast("double"), 0.5), "_reviews_p80": (n.cast("double"), 0.8)}
    thresholds = one_row(group_percentiles(cleaned, [], wanted, discrete=True))
    cats = cleaned.groupBy("main_category").agg(
        mean_fixed(r).alias("category_avg_rating"), mean_fixed(dp).alias("category_avg_price")
    )
    base = join_group_stats(cleaned.join(thresholds, F.lit(True), "left"), cats, ["main_category"])
    out = base.select(
        *cleaned.columns,
        F.when(ap.isNotNull() & (ap > dp), (ap - dp) / ap * F.lit(100.0)).otherwise(F.lit(0.0)).alias(
            "discount_percentage"
        ),
        (dp / r).alias("price_per_rating"),
        F.when(n > 0, F.log(n.cast("double") + F.lit(1.0)) * r).otherwise(F.lit(0.0)).alias("review_density_score"),
        first_match([dp <= F.col("_price_p33"), dp <= F.col("_price_p66")], fixed.PIPELINE_PRICE_SEGMENTS).alias(
            "price_segment"
        ),
        threshold_labels(r, fixed.RATING_CATEGORIES, fixed.RATING_CATEGORY_DEFAULT).alias("rating_category"),
        first_match([n >= F.col("_reviews_p80"), n >= F.col("_reviews_median")], fixed.REVIEW_VOLUMES).alias(
            "review_volume"
        ),
        "category_avg_rating",
        "category_avg_price",
        (r - F.col("category_avg_rating")).alias("rating_vs_category_avg"),
        ((dp - F.col("category_avg_price")) / F.col("category_avg_price") * F.lit(100.0)).alias(
            "price_vs_category_avg"
        ),
        quality_score(r, n).alias("quality_score"),
    ).withColumn("value_score", F.col("quality_score") / (dp / F.lit(1000.0)))
    return add_ranks(out) if with_ranks else out


def add_ranks(feats: DataFrame) -> DataFrame:
    """P3g: ranks by reviews and by rating within the category; only ids and measures are sorted."""
    pid = F.col(PRODUCT_ID).asc()
    narrow = feats.select("main_category", PRODUCT_ID, "no_of_ratings_clean", "ratings_clean")
    narrow = group_row_number(narrow, ["main_category"], [F.col("no_of_ratings_clean").desc(), pid], "popularity_rank")
    narrow = group_row_number(narrow, ["main_category"], [F.col("ratings_clean").desc(), pid], "rating_rank")
    return feats.join(narrow.select(PRODUCT_ID, "popularity_rank", "rating_rank"), PRODUCT_ID)


def report(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column half-up to ``digits`` decimals (report precision).

    Floating-point sums and logarithms may differ in the last bit between
    engines and between runs; reported values are fixed to ``digits`` places.
    """
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            cols.append(round_to(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def category_performance(feats: DataFrame) -> DataFrame:
    """Per-category counts, averages, total reviews, mean quality, sub-category diversity."""
    return feats.groupBy("main_category").agg(
        F.count(F.lit(1)).alias("product_count"),
        F.avg("ratings_clean").alias("avg_rating"),
        F.avg("discount_price_clean").alias("avg_price"),
        F.sum("no_of_ratings_clean").alias("total_reviews"),
        F.avg("quality_score").alias("avg_quality_score"),
        F.countDistinct("sub_category").alias("subcategory_diversity"),
    ).orderBy(F.col("avg_quality_score").desc(), "main_category")


def price_elasticity(feats: DataFrame) -> DataFrame:
    """Category x price bucket (left-closed 500/1000/2000/5000): count, avg rating, avg reviews."""
    bucket = bucketize("discount_price_clean", PRICE_BUCKET_EDGES, PRICE_BUCKET_LABELS_PIPELINE)
    return (
        feats.groupBy("main_category", bucket.alias("price_bucket"))
        .agg(
            F.count(F.lit(1)).alias("product_count"),
            F.avg("ratings_clean").alias("avg_rating"),
            F.avg("no_of_ratings_clean").alias("avg_reviews"),
        )
        .orderBy("main_category", "price_bucket")
    )


def market_opportunity_top(feats: DataFrame, n: int = 20) -> DataFrame:
    """Top-``n`` sub-categories by demand per product (a top-k report)."""
    return (
        feats.groupBy("main_category", "sub_category")
        .agg(
            F.count(F.lit(1)).alias("current_products"),
            F.avg("ratings_clean").alias("avg_rating"),
            F.sum("no_of_ratings_clean").alias("demand_signal"),
        )
        .withColumn("opportunity_score", F.col("demand_signal") / F.col("current_products"))
        .orderBy(F.col("opportunity_score").desc(), "main_category", "sub_category")
        .limit(n)
    )


def top_categories(feats: DataFrame, n: int = 5, min_products: int = 50) -> DataFrame:
    """Best ``n`` categories by mean quality score among those with >= ``min_products``."""
    return (
        feats.groupBy("main_category")
        .agg(round_to(F.avg("quality_score"), 6).alias("avg_quality"), F.count(F.lit(1)).alias("product_count"))
        .where(F.col("product_count") >= min_products)
        .orderBy(F.col("avg_quality").desc(), "main_category")
        .limit(n)
    )


def improvement_opportunities(feats: DataFrame, n: int = 10) -> DataFrame:
    """Most-reviewed products rated below 4.0 with more than 100 reviews."""
    return (
        feats.where((F.col("ratings_clean") < 4.0) & (F.col("no_of_ratings_clean") > 100))
        .select(PRODUCT_ID, "name", "main_category", "ratings_clean", "no_of_ratings_clean", "discount_price_clean")
        .orderBy(F.col("no_of_ratings_clean").desc(), PRODUCT_ID)
        .limit(n)
    )


def underpriced_quality(feats: DataFrame, n: int = 10) -> DataFrame:
    """Rating >= 4.5 priced more than 20% below the category mean, cheapest relative first."""
    return (
        feats.where((F.col("ratings_clean") >= 4.5) & (F.col("price_vs_category_avg") < -20))
        .select(PRODUCT_ID, "name", "main_category", "ratings_clean", "discount_price_clean", "price_vs_category_avg")
        .orderBy("price_vs_category_avg", PRODUCT_ID)
        .limit(n)
    )
