"""Advanced analytics (A1-A7): rankings, price positioning, satisfaction, cohorts.

Window functions over whole categories are re-expressed so that no task holds
a whole category: top-n uses a partial WindowGroupLimit, positions of the few
selected rows are counted with a bounded join, per-category statistics are
aggregated and joined back, and moving averages use a distributed row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed
from shelfwise.functions import first_match, pct, round_dec, round_to, threshold_labels
from shelfwise.operators import (
    avg_cmp,
    join_group_stats,
    ntile_of,
    percentiles,
    global_ranks,
    moving_frame,
    ntile_by_cuts,
    positions_in_group,
    top_n_per_group,
    weighted_avg,
    with_share,
)
from shelfwise.plans.common import d, parsed, valid



def _discount_pct():
    return (F.col("original_price") - F.col("price")).cast("double") * F.lit(100.0) / d("original_price")


def top_products(products: DataFrame, n: int = 5, all_ranks: bool = False) -> DataFrame:
    """A1: top-``n`` products per category by (rating, reviews) among discounted products.

    Adds popularity rank (by reviews), the rating quartile (NTILE(4) by rating
    within the category) and a composite score. ``all_ranks=True`` adds the price
    rank and the popularity quartile, which the report leaves out.
    """
    base = (
        valid(parsed(products), "price", "rating", "count")
        .where(F.col("original_price") > F.col("price"))
        .select("product_id", "main_category", "name", "rating", "review_count", "price", "original_price")
    )
    order = [F.col("rating").desc(), F.col("review_count").desc(), F.col("product_id").asc()]
    top = top_n_per_group(base, ["main_category"], order, n, "rating_rank")
    pos = positions_in_group(
        top,
        base,
        ["main_category"],
        {
            "popularity_rank": [("review_count", "desc"), ("product_id", "asc")],
            "_rating_pos": [("rating", "asc"), ("product_id", "asc")],
            **({"price_rank": [("price", "asc"), ("product_id", "asc")], "_review_pos": [("review_count", "asc"), ("product_id", "asc")]} if all_ranks else {}),
        },
        "product_id",
        size_col="_n",
    )
    quartile = ntile_of(F.col("_rating_pos"), F.col("_n"), 4)
    composite = (
        d("rating") * F.lit(0.4)
        + (d("review_count") / F.lit(1000.0)) * F.lit(0.3)
        + ((F.col("original_price") - F.col("price")).cast("double") / d("original_price") * F.lit(100.0)) * F.lit(0.3)
    )
    tier = first_match([quartile == 4, quartile == 3, quartile == 2], fixed.RATING_TIERS)
    return pos.select(
        "main_category",
        "name",
        d("rating").alias("rating"),
        F.col("review_count").cast("bigint").alias("review_count"),
        d("price").alias("price"),
        d("original_price").alias("original_price"),
        round_to(_discount_pct(), 2).alias("discount_percentage"),
        round_to(composite, 2).alias("composite_score"),
        "rating_rank",
        F.col("popularity_rank").cast("bigint").alias("popularity_rank"),
        tier.alias("rating_tier"),
        *([F.col("price_rank").cast("bigint").alias("price_rank"), ntile_of(F.col("_review_pos"), F.col("_n"), 4).alias("popularity_quartile")] if all_ranks else []),
    ).orderBy("main_category", "rating_rank")


def category_scoreboard(products: DataFrame, all_ranks: bool = False) -> DataFrame:
    """A2: per-category counts, averages and reviews with global ranks and a status label.

    ``all_ranks=True`` adds the rank by number of products, which the report leaves out.
    """
    rows = valid(parsed(products), "price", "rating", "count")
    cats = rows.groupBy("main_category").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(F.col("rating") >= 4.0).alias("high_rated_products"),
        round_dec(F.avg("rating"), 2).alias("avg_rating"),
        round_dec(F.avg("price"), 2).alias("avg_price"),
        F.sum("review_count").cast("bigint").alias("total_reviews"),
    )
    # All ranks from one distributed numbering (no single-task window).
    orders = {"rating_rank": "avg_rating", "review_volume_rank": "total_reviews"}
    ranked = global_ranks(cats, "main_category", orders | ({"product_count_rank": "total_products"} if all_ranks else {}))
    rr, vr = F.col("rating_rank"), F.col("review_volume_rank")
    status = first_match(
        [(rr <= 3) & (vr <= 5), (rr <= 5) | (vr <= 5), (rr <= 10) & (vr <= 10)], fixed.CATEGORY_STATUSES
    )
    segment = threshold_labels(
        "avg_price", fixed.CATEGORY_PRICE_SEGMENTS, fixed.CATEGORY_PRICE_SEGMENT_DEFAULT, op=">"
    )
    return ranked.select(
        "main_category",
        "total_products",
        F.col("avg_rating").cast("double").alias("avg_rating"),
        round_to(pct(F.col("high_rated_products"), F.col("total_products")), 2).alias("high_rating_percentage"),
        F.col("avg_price").cast("double").alias("avg_price"),
        segment.alias("price_segment"),
        "total_reviews",
        rr.cast("bigint").alias("rating_rank"),
        vr.cast("bigint").alias("review_volume_rank"),
        status.alias("category_status"),
        *(["product_count_rank"] if all_ranks else []),
    ).orderBy("rating_rank", "main_category")


def price_positions(products: DataFrame, window_rows: int = 2, exact: bool = True) -> DataFrame:
    """A3 row level: category percentiles, centred moving average of price by rating,
    pricing recommendation, deviation and position (one row per product).

    The moving average over ``2 * window_rows + 1`` rows is a frame with a halo:
    range partitions of (category, rating), each with the few rows beside it
    from its neighbours (no whole-category task).
    Threshold tests on the average are exact (``price * n`` vs ``sum * f``).
    """
    rows = valid(parsed(products), "price", "rating").select(
        "product_id", "main_category", "sub_category", "name", "price", "rating", "review_count"
    )
    price, rating = F.col("price"), F.col("rating")
    wanted = {"price_p25": (price, 0.25), "price_median": (price, 0.5), "price_p75": (price, 0.75), "rating_median": (rating, 0.5), "rating_p75": (rating, 0.75)}
    stats = percentiles(rows, ["main_category"], wanted, exact)
    with_stats = join_group_stats(rows, stats, ["main_category"], null_keys_match=True)

    frames = {"_win_sum": F.sum("price"), "_win_n": F.count("price")}
    joined = moving_frame(
        with_stats, ["main_category"], [F.col("rating").asc(), F.col("product_id").asc()], window_rows, window_rows, frames
    )
    pdbl, rdbl = d("price"), d("rating")
    p25, p75 = F.col("price_p25"), F.col("price_p75")
    r50, r75 = F.col("rating_median"), F.col("rating_p75")
    in_band = pdbl.between(p25, p75)
    recommendation = first_match(
        [
            (pdbl < p25) & (rdbl > r75),
            (pdbl > p75) & (rdbl < r50),
            in_band & (rdbl > r75),
            in_band & rdbl.between(r50, r75),
        ],
        fixed.PRICING_RECOMMENDATIONS,
    )
    scaled = price * F.col("_win_n")
    total = F.col("_win_sum")

    def above(f: str):
        return scaled > total * F.lit(f).cast("decimal(3,1)")

    def below(f: str):
        return scaled < total * F.lit(f).cast("decimal(3,1)")

    # (the 0.8 rule comes after 0.9 and is never reached; kept as defined)
    position = first_match(
        [above(f) if op == ">" else below(f) for op, f, _ in fixed.PRICING_POSITIONS],
        [label for _, _, label in fixed.PRICING_POSITIONS] + [fixed.PRICING_POSITION_DEFAULT],
    )
    moving_avg = total / F.col("_win_n")
    return joined.select(
        "product_id",
        "main_category",
        "sub_category",
        "name",
        pdbl.alias("current_price"),
        rdbl.alias("rating"),
        F.col("review_count").cast("bigint").alias("review_count"),
        "price_p25",
        "price_median",
        "price_p75",
        "rating_median",
        "rating_p75",
        round_to(moving_avg, 6).alias("price_moving_avg"),
        recommendation.alias("pricing_recommendation"),
        round_to(F.abs(price - moving_avg), 6).alias("price_deviation"),
        position.alias("pricing_position"),
    )


def price_recommendations(products: DataFrame, min_products: int = 3, exact: bool = True) -> DataFrame:
    """A3: products per (category, pricing recommendation) with averages, >= ``min_products``."""
    rows = price_positions(products, exact=exact)
    return (
        rows.groupBy("main_category", "pricing_recommendation")
        .agg(
            F.count(F.lit(1)).alias("product_count"),
            round_to(F.avg("current_price"), 2).alias("avg_current_price"),
            round_to(F.avg("rating"), 2).alias("avg_rating"),
            round_to(F.avg("review_count"), 0).alias("avg_reviews"),
        )
        .where(F.col("product_count") >= min_products)
        .orderBy("main_category", F.col("product_count").desc())
    )




def satisfaction_segments(products: DataFrame, min_products: int = 5) -> DataFrame:
    """A4: (category, satisfaction level, review volume) segments with category summary.

    Only the first aggregate touches rows; the rest works on the segment table
    (categories x 5 x 4 rows). The category summary is inner-joined, so the
    NULL category drops out.
    """
    rows = valid(parsed(products), "price", "rating", "count")
    level = threshold_labels("rating", fixed.SATISFACTION_LEVELS, fixed.SATISFACTION_LEVEL_DEFAULT)
    volume = threshold_labels("review_count", fixed.VOLUME_LEVELS, fixed.VOLUME_LEVEL_DEFAULT)
    rc = F.col("review_count")
    seg = rows.groupBy("main_category", level.alias("satisfaction_level"), volume.alias("review_volume_category")).agg(
        F.count(F.lit(1)).alias("product_count"),
        round_to(F.avg("rating"), 2).alias("avg_rating"),
        round_to(F.avg("price"), 2).alias("avg_price"),
        F.sum(rc).cast("bigint").alias("total_reviews"),
        round_dec(weighted_avg(F.col("rating"), rc), 2).cast("double").alias("weighted_satisfaction_score"),
    )
    satisfied = F.col("satisfaction_level").isin(*fixed.SATISFIED_LEVELS)
    summary = seg.groupBy("main_category").agg(
        F.sum("product_count").alias("_total"),
        F.sum(F.when(satisfied, F.col("product_count")).otherwise(F.lit(0))).alias("_satisfied"),
        round_to(F.avg("weighted_satisfaction_score"), 2).alias("category_overall_score"),
    )
    summary = summary.select(
        "main_category",
        round_to(pct(F.col("_satisfied"), F.col("_total")), 2).alias("category_satisfaction_rate"),
        "category_overall_score",
    )
    return (
        seg.join(summary, "main_category", "inner")
        .where(F.col("product_count") >= min_products)
        .select(
            "main_category",
            "satisfaction_level",
            "review_volume_category",
            "product_count",
            "avg_rating",
            "avg_price",
            "total_reviews",
            "weighted_satisfaction_score",
            "category_satisfaction_rate",
            "category_overall_score",
        )
        .orderBy("main_category", F.col("satisfaction_level").desc(), F.col("review_volume_category").desc())
    )


def _segment_label():
    r, v = F.col("rating_cohort"), F.col("volume_cohort")
    return first_match(
        [
            (r == 4) & (v == 4),
            (r == 4) & (v >= 3),
            (r >= 3) & (v == 4),
            (r >= 3) & (v >= 3),
            (r <= 2) & (v >= 3),
            (r >= 3) & (v <= 2),
        ],
        fixed.PERFORMANCE_SEGMENTS,
    )


def performance_cohorts(products: DataFrame) -> DataFrame:
    """A5: global quartiles (NTILE(4)) of rating, reviews and price -> 64 cells -> 7 segments.

    The rows at the nine bucket starts are selected by counting; no row is sorted.
    """
    rows = valid(parsed(products), "price", "rating", "count").select(
        "product_id", "rating", "review_count", "price"
    )
    rows = ntile_by_cuts(rows, "product_id", {"rating_cohort": "rating", "volume_cohort": "review_count", "price_cohort": "price"}, 4)
    cells = rows.groupBy("rating_cohort", "volume_cohort", "price_cohort").agg(
        F.count(F.lit(1)).alias("product_count"),
        round_dec(F.avg("rating"), 2).alias("avg_rating"),
        round_dec(F.avg("review_count"), 0).alias("avg_reviews"),
        round_dec(F.avg("price"), 2).alias("avg_price"),
    )
    cells = cells.withColumn("performance_segment", _segment_label())
    seg = cells.groupBy("performance_segment").agg(
        F.count(F.lit(1)).alias("cohort_count"),
        F.sum("product_count").alias("total_products"),
        round_to(F.avg("avg_rating"), 2).alias("segment_avg_rating"),
        round_to(F.avg("avg_reviews"), 0).alias("segment_avg_reviews"),
        round_to(F.avg("avg_price"), 2).alias("segment_avg_price"),
    )
    shared = with_share(seg, "total_products", "_share")
    return shared.withColumn("market_share_percent", round_to("_share", 2)).drop("_share").orderBy(
        F.col("total_products").desc()
    )




def strategic_positions(products: DataFrame, all_ranks: bool = False) -> DataFrame:
    """Per-category business summary, position and advice.

    ``all_ranks=True`` adds the revenue and engagement ranks, which the report leaves out.
    """
    rows = valid(parsed(products), "price", "rating", "count")
    rc = F.col("review_count")
    cats = rows.groupBy("main_category").agg(
        F.count(F.lit(1)).alias("total_products"),
        round_dec(F.avg("rating"), 2).alias("avg_rating"),
        round_dec(F.avg("price"), 2).alias("avg_price"),
        F.sum(rc).cast("bigint").alias("total_customer_engagement"),
        F.count_if(F.col("rating") >= 4.0).alias("high_quality_products"),
        F.count_if(rc >= 100).alias("established_products"),
        round_dec(F.avg(F.col("price") * rc), 2).alias("revenue_potential_index"),
    )
    ar, rev = F.col("avg_rating"), F.col("revenue_potential_index")
    position = first_match(
        [
            (ar >= 4.2) & (rev >= 50000),
            (ar >= 4.0) & (F.col("total_customer_engagement") >= 10000),
            (ar >= 3.8) & (F.col("total_products") >= 50),
            ar >= 3.5,
        ],
        fixed.STRATEGIC_POSITIONS,
    )
    advice = first_match(
        [F.col("strategic_position") == p for p in fixed.STRATEGIC_POSITIONS[:-1]], fixed.STRATEGY_ADVICE
    )
    helpers = {"revenue_rank": "revenue_potential_index", "engagement_rank": "total_customer_engagement"} if all_ranks else {}
    if helpers:
        cats = global_ranks(cats, "main_category", helpers)
    return (
        cats.select("*", position.alias("strategic_position"))
        .select(
            "main_category",
            "total_products",
            ar.cast("double").alias("avg_rating"),
            round_to(pct(F.col("high_quality_products"), F.col("total_products")), 2).alias("quality_rate"),
            F.col("avg_price").cast("double").alias("avg_price"),
            "total_customer_engagement",
            rev.cast("double").alias("revenue_potential_index"),
            "strategic_position",
            advice.alias("strategic_recommendation"),
            *helpers,
        )
        .orderBy(F.col("revenue_potential_index").desc(), "main_category")
    )


def market_opportunities(products: DataFrame, min_products: int = 5) -> DataFrame:
    """Sub-category gap labels (exact average tests), rolled up per (category, label)."""
    rows = valid(parsed(products), "price", "rating", "count")
    n = F.count(F.lit(1))
    demand = F.sum("review_count")
    label = first_match(
        [
            (n < 10) & avg_cmp(F.col("rating"), ">=", 4.0),
            (n < 20) & (demand >= 1000),
            (n >= 50) & avg_cmp(F.col("rating"), "<", 3.5),
            (n >= 30) & avg_cmp(F.col("price"), ">=", 2000),
        ],
        fixed.MARKET_OPPORTUNITIES,
    )
    subs = (
        rows.groupBy("main_category", "sub_category")
        .agg(
            n.alias("current_products"),
            round_dec(F.avg("rating"), 2).alias("avg_rating"),
            round_dec(F.avg("price"), 2).alias("avg_price"),
            demand.cast("bigint").alias("total_demand_signal"),
            label.alias("market_opportunity"),
        )
        .where(F.col("current_products") >= min_products)
    )
    return (
        subs.where(F.col("market_opportunity") != fixed.MARKET_OPPORTUNITIES[-1])
        .groupBy("main_category", "market_opportunity")
        .agg(
            F.count(F.lit(1)).alias("subcategory_count"),
            round_to(F.avg("current_products"), 0).alias("avg_products_per_subcategory"),
            round_to(F.avg("avg_rating"), 2).alias("avg_category_rating"),
            round_to(F.avg("avg_price"), 2).alias("avg_category_price"),
            F.sum("total_demand_signal").cast("bigint").alias("total_category_demand"),
        )
        .orderBy(F.col("total_category_demand").desc())
    )
