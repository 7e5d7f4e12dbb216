"""Dashboard data sets (D1-D9): the numbers behind each chart, as DataFrames.

Rendering is out of scope; each function returns the (small) frame a chart
would plot. Group-bys drop the NULL category, as a pandas ``groupby`` does.
Samples are a hash-ordered top-n (reproducible, no driver-side sampling).
Thresholds such as the review-count 70th percentile are exact linear
percentiles joined as one-row aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.fixed import INSIGHTS, KEY_METRICS, SUCCESS_MARKERS
from shelfwise.functions import bucketize, ordinal, pct, round_text, round_to, thousands
from shelfwise.operators import (
    box_stats,
    group_percentiles,
    hash_sample,
    histogram,
    join_group_stats,
    metrics_long,
    minmax_normalise,
    one_row,
)
from shelfwise.plans.features import quality_score
from shelfwise.schema import CURRENCY, DASHBOARD_SEGMENT_EDGES, DASHBOARD_SEGMENT_LABELS, PRODUCT_ID


def _has_category(df: DataFrame) -> DataFrame:
    return df.where(F.col("main_category").isNotNull())


def load_clean(products: DataFrame) -> DataFrame:
    """Coerce-parse prices, rating and count, add discount % and quality score,
    drop rows without price, rating or count (no dedupe; category may be NULL)."""

    def money(c: str):
        return F.translate(F.col(c), f"{CURRENCY}, ", "").try_cast("double")

    rows = products.select(
        "*",
        money("discount_price").alias("discount_price_clean"),
        money("actual_price").alias("actual_price_clean"),
        F.trim(F.col("ratings")).try_cast("double").alias("ratings_clean"),
        F.replace(F.col("no_of_ratings"), F.lit(","), F.lit("")).try_cast("bigint").alias("no_of_ratings_clean"),
    ).where(
        F.col("discount_price_clean").isNotNull()
        & F.col("ratings_clean").isNotNull()
        & F.col("no_of_ratings_clean").isNotNull()
    )
    dp, ap = F.col("discount_price_clean"), F.col("actual_price_clean")
    return rows.select(
        "*",
        F.when(ap > dp, (ap - dp) / ap * F.lit(100.0)).otherwise(F.lit(0.0)).alias("discount_percentage"),
        quality_score(F.col("ratings_clean"), F.col("no_of_ratings_clean")).alias("quality_score"),
    )


# --- D2 overview -------------------------------------------------------------

def category_counts(d: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` categories with most products."""
    return (
        _has_category(d)
        .groupBy("main_category")
        .agg(F.count(F.lit(1)).alias("product_count"))
        .orderBy(F.col("product_count").desc(), "main_category")
        .limit(n)
    )


def rating_histogram(d: DataFrame, bins: int = 20) -> DataFrame:
    """Rating histogram, ``bins`` fixed bins over [0, 5] (values outside in bins 0 / bins+1)."""
    return histogram(d, "ratings_clean", 0.0, 5.0, bins)


def price_rating_sample(d: DataFrame, n: int = 1000) -> DataFrame:
    """Reproducible sample of (price, rating, reviews) points."""
    return hash_sample(d, n).select(PRODUCT_ID, "discount_price_clean", "ratings_clean", "no_of_ratings_clean")


def top_quality_categories(d: DataFrame, n: int = 10) -> DataFrame:
    """D2d / D7b: the ``n`` categories with the highest mean quality score."""
    return (
        _has_category(d)
        .groupBy("main_category")
        .agg(F.avg("quality_score").alias("quality_score"))
        .orderBy(F.col("quality_score").desc(), "main_category")
        .limit(n)
    )


# --- D3 categories -----------------------------------------------------------

def category_metrics(d: DataFrame) -> DataFrame:
    """Per-category means and totals, rounded to 2 decimals."""
    return _has_category(d).groupBy("main_category").agg(
        round_to(F.avg("ratings_clean"), 2).alias("avg_rating"),
        F.count("ratings_clean").alias("product_count"),
        round_to(F.avg("discount_price_clean"), 2).alias("avg_price"),
        F.sum("no_of_ratings_clean").alias("total_reviews"),
        round_to(F.avg("quality_score"), 2).alias("quality_score"),
        round_to(F.avg("discount_percentage"), 2).alias("avg_discount"),
    )


HEATMAP_METRICS = ("avg_rating", "avg_price", "quality_score", "avg_discount")


def category_heatmap(d: DataFrame) -> DataFrame:
    """Min-max normalised category metrics in long form (category, metric, value)."""
    m = category_metrics(d)
    norm = minmax_normalise(m.select("main_category", *HEATMAP_METRICS), HEATMAP_METRICS)
    structs = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in HEATMAP_METRICS]
    return norm.select("main_category", F.inline(F.array(*structs)))


# --- D4 pricing --------------------------------------------------------------

def segment_expr():
    return bucketize(
        "discount_price_clean",
        DASHBOARD_SEGMENT_EDGES[1:],
        DASHBOARD_SEGMENT_LABELS,
        right_closed=True,
        lower_bound=DASHBOARD_SEGMENT_EDGES[0],
    )


def rating_by_segment(d: DataFrame) -> DataFrame:
    """Mean rating per right-closed price segment (price <= 0 has no segment)."""
    seg = segment_expr()
    return (
        d.where(seg.isNotNull())
        .groupBy(seg.alias("price_segment"))
        .agg(F.avg("ratings_clean").alias("avg_rating"), F.count(F.lit(1)).alias("product_count"))
        .orderBy(ordinal("price_segment", DASHBOARD_SEGMENT_LABELS))
    )


def _top_categories_by_count(d: DataFrame, n: int) -> DataFrame:
    return category_counts(d, n).select("main_category")


def price_boxes(d: DataFrame, n: int = 5) -> DataFrame:
    """Price five-number summary and fences for the ``n`` largest categories."""
    top = F.broadcast(_top_categories_by_count(d, n))  # at most n rows
    return box_stats(d.join(top, "main_category", "left_semi"), ["main_category"], "discount_price_clean")


def discount_rating_sample(d: DataFrame, n: int = 500) -> DataFrame:
    """Reproducible sample of (discount %, rating) points."""
    return hash_sample(d, n).select(PRODUCT_ID, "discount_percentage", "ratings_clean")


def price_density(d: DataFrame, n: int = 3, bins: int = 20) -> DataFrame:
    """D4d: binned price density (violin outline) for the ``n`` largest categories.

    Bins span each category's own price range.
    """
    top = F.broadcast(_top_categories_by_count(d, n))
    rows = d.join(top, "main_category", "left_semi")
    rng = rows.groupBy("main_category").agg(
        F.min("discount_price_clean").alias("_lo"), F.max("discount_price_clean").alias("_hi")
    )
    rows = rows.join(F.broadcast(rng), "main_category")  # at most n rows
    p, lo, hi = F.col("discount_price_clean"), F.col("_lo"), F.col("_hi")
    width = (hi - lo) / F.lit(float(bins))
    b = (
        F.when((hi == lo) | (p == hi), F.lit(bins).cast("bigint"))
        .otherwise(F.floor(F.lit(float(bins)) * (p - lo) / (hi - lo)).cast("bigint") + F.lit(1))
    )
    return (
        rows.groupBy("main_category", "_lo", "_hi", b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "main_category",
            "bin",
            (lo + (F.col("bin") - F.lit(1)).cast("double") * width).alias("bin_start"),
            (lo + F.col("bin").cast("double") * width).alias("bin_end"),
            "count",
        )
    )


def underpriced_products(d: DataFrame, n: int = 10) -> DataFrame:
    """D4e: rating >= 4.5 priced at or below the category median, most reviewed first."""
    med = group_percentiles(_has_category(d), ["main_category"], {"_median": (F.col("discount_price_clean"), 0.5)})
    rows = join_group_stats(d, med, ["main_category"])
    return (
        rows.where((F.col("ratings_clean") >= 4.5) & (F.col("discount_price_clean") <= F.col("_median")))
        .select(PRODUCT_ID, "name", "main_category", "ratings_clean", "discount_price_clean", "no_of_ratings_clean")
        .orderBy(F.col("no_of_ratings_clean").desc(), PRODUCT_ID)
        .limit(n)
    )


# --- D5 performance ----------------------------------------------------------

def success_flags(d: DataFrame, rating_threshold: float = 4.0, review_quantile: float = 0.7) -> DataFrame:
    """``is_successful`` = rating >= 4 and reviews >= the exact 70th percentile."""
    thr = group_percentiles(d, [], {"_review_threshold": (F.col("no_of_ratings_clean"), review_quantile)})
    flagged = d.join(one_row(thr), F.lit(True), "left")  # one row, none without products
    ok = (F.col("ratings_clean") >= rating_threshold) & (F.col("no_of_ratings_clean") >= F.col("_review_threshold"))
    return flagged.withColumn("is_successful", F.coalesce(ok, F.lit(False))).drop("_review_threshold")


def success_by_category(d: DataFrame, n: int = 10) -> DataFrame:
    """Successful count, products and success rate per category, best ``n``."""
    s = success_flags(d)
    return (
        _has_category(s)
        .groupBy("main_category")
        .agg(
            F.sum(F.col("is_successful").cast("bigint")).alias("successful"),
            F.count(F.lit(1)).alias("products"),
        )
        .withColumn("success_rate", F.col("successful") / F.col("products") * F.lit(100.0))
        .orderBy(F.col("success_rate").desc(), "main_category")
        .limit(n)
    )


def performance_sample(d: DataFrame, n: int = 1000) -> DataFrame:
    """Reproducible sample for the reviews/rating and price/quality scatter plots."""
    return hash_sample(success_flags(d), n).select(
        PRODUCT_ID,
        "no_of_ratings_clean",
        "ratings_clean",
        "is_successful",
        "discount_price_clean",
        "quality_score",
        "discount_percentage",
    )


def success_factors(d: DataFrame, factors: Sequence[str] = ("discount_percentage", "quality_score")) -> DataFrame:
    """D5d: mean of each factor for successful vs other products (long form)."""
    s = success_flags(d).groupBy("is_successful").agg(*[F.avg(f).alias(f) for f in factors])
    structs = [F.struct(F.lit(f).alias("factor"), F.col(f).alias("mean")) for f in factors]
    return s.select("is_successful", F.inline(F.array(*structs)))


def success_overview(d: DataFrame) -> DataFrame:
    """D5e: overall success rate and the mean rating / reviews of successful products."""
    s = success_flags(d)
    ok = F.col("is_successful")
    return s.agg(
        (F.avg(ok.cast("double")) * F.lit(100.0)).alias("success_rate"),
        F.avg(F.when(ok, F.col("ratings_clean"))).alias("successful_avg_rating"),
        F.avg(F.when(ok, F.col("no_of_ratings_clean"))).alias("successful_avg_reviews"),
    )


# --- D6 market opportunity ---------------------------------------------------

def subcategory_market(d: DataFrame) -> DataFrame:
    """Per (category, sub-category): products, mean rating, demand, mean price, opportunity."""
    m = _has_category(d).groupBy("main_category", "sub_category").agg(
        F.count("ratings_clean").alias("product_count"),
        round_to(F.avg("ratings_clean"), 2).alias("avg_rating"),
        F.sum("no_of_ratings_clean").alias("demand_signal"),
        round_to(F.avg("discount_price_clean"), 2).alias("avg_price"),
    )
    return m.withColumn("opportunity_score", F.col("demand_signal") / F.col("product_count"))


def market_gaps(d: DataFrame, n: int = 15, max_products: int = 20, min_demand: int = 500) -> DataFrame:
    """Sub-categories with few products and high demand, best ``n`` by opportunity."""
    return (
        subcategory_market(d)
        .where((F.col("product_count") < max_products) & (F.col("demand_signal") > min_demand))
        .orderBy(F.col("opportunity_score").desc(), "main_category", "sub_category")
        .limit(n)
    )


# --- D7 executive summary ----------------------------------------------------

def key_metrics(d: DataFrame) -> DataFrame:
    """Products, categories, mean rating, mean price, total reviews (long form)."""
    one = d.agg(
        F.count(F.lit(1)).cast("double").alias("products"),
        F.countDistinct("main_category").cast("double").alias("categories"),
        F.avg("ratings_clean").alias("avg_rating"),
        F.avg("discount_price_clean").alias("avg_price"),
        F.sum("no_of_ratings_clean").cast("double").alias("total_reviews"),
    )
    values = [F.col(c) for c in ("products", "categories", "avg_rating", "avg_price", "total_reviews")]
    return metrics_long(one, list(zip(KEY_METRICS, values)))


def strategic_insights(d: DataFrame) -> DataFrame:
    """High-quality low-price products (vs the global median price), 4+ ratings, premium (> 2000)."""
    med = one_row(group_percentiles(d, [], {"_median": (F.col("discount_price_clean"), 0.5)}))
    rows = d.join(med, F.lit(True), "left")  # one row, none without products
    hq = (F.col("ratings_clean") >= 4.5) & (F.col("discount_price_clean") <= F.col("_median"))
    one = rows.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(hq).alias("high_quality_low_price"),
        F.count_if(F.col("ratings_clean") >= 4).alias("rated_4_plus"),
        F.count_if(F.col("discount_price_clean") > 2000).alias("premium_over_2000"),
    )
    return one.select(
        "products",
        "high_quality_low_price",
        pct(F.col("high_quality_low_price"), F.col("products")).alias("high_quality_low_price_pct"),
        "rated_4_plus",
        "premium_over_2000",
    )


def executive_lines(d: DataFrame) -> DataFrame:
    """D7 as shown: key metrics, the five best categories and the insights as (section, position, name, shown) with formatted values."""
    m = d.agg(
        F.count(F.lit(1)).alias("products"),
        F.countDistinct("main_category").alias("categories"),
        F.avg("ratings_clean").alias("rating"),
        F.avg("discount_price_clean").alias("price"),
        F.sum("no_of_ratings_clean").alias("reviews"),
    )
    shown = [
        thousands("products"),
        F.col("categories").cast("string"),
        F.concat(round_text("rating", 2), F.lit("/5.0")),
        F.concat(F.lit(CURRENCY), thousands("price")),
        thousands("reviews"),
    ]
    metrics = _lines(m, "metric", zip(KEY_METRICS, shown))
    i = strategic_insights(d)
    share = F.concat(F.col("high_quality_low_price").cast("string"), F.lit(" ("), round_text("high_quality_low_price_pct", 1), F.lit("%)"))
    insights = _lines(i, "insight", zip(INSIGHTS, [share, F.col("rated_4_plus").cast("string"), F.col("premium_over_2000").cast("string")]))
    best = top_quality_categories(d, 5)
    place = F.row_number().over(Window.orderBy(F.col("quality_score").desc(), "main_category"))  # five rows
    best = best.select(F.lit("category").alias("section"), place.alias("position"), F.col("main_category").alias("name"), round_text("quality_score", 2).alias("shown"))
    return metrics.unionByName(best).unionByName(insights)


def _lines(one: DataFrame, section: str, items) -> DataFrame:
    structs = [
        F.struct(F.lit(section).alias("section"), F.lit(i).alias("position"), F.lit(name).alias("name"), text.alias("shown"))
        for i, (name, text) in enumerate(items, start=1)
    ]
    return one.select(F.inline(F.array(*structs)))


def marked_sample(d: DataFrame, n: int = 1000) -> DataFrame:
    """D5c with the marker text of each point: the Boolean flag mapped to the chart's colour name."""
    colour = F.when(F.col("is_successful"), SUCCESS_MARKERS[True]).otherwise(SUCCESS_MARKERS[False])
    return performance_sample(d, n).select(PRODUCT_ID, "no_of_ratings_clean", "ratings_clean", colour.alias("marker"))


# --- D8 / D9 custom analysis and drill-down ----------------------------------

CORRELATION_MEASURES = ("ratings_clean", "discount_price_clean", "no_of_ratings_clean", "quality_score")


def custom_filter(
    d: DataFrame, category_filter: Sequence[str] | None = None, price_range: tuple[float, float] | None = None
) -> DataFrame:
    """D8 filter: categories IN list and a closed price range (both optional)."""
    if category_filter:
        d = d.where(F.col("main_category").isin(list(category_filter)))
    if price_range:
        d = d.where(F.col("discount_price_clean").between(price_range[0], price_range[1]))
    return d


def correlation_matrix(
    d: DataFrame,
    category_filter: Sequence[str] | None = None,
    price_range: tuple[float, float] | None = None,
    measures: Sequence[str] = CORRELATION_MEASURES,
) -> DataFrame:
    """Pearson correlation of the measures (long form x, y, corr), one aggregation."""
    f = custom_filter(d, category_filter, price_range)
    aggs = [
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
        for a in measures
        for b in measures
    ]
    one = f.agg(*aggs)
    structs = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}__{b}").alias("corr"))
        for a in measures
        for b in measures
    ]
    return one.select(F.inline(F.array(*structs)))


def correlation_matrix_mllib(d: DataFrame, measures: Sequence[str] = CORRELATION_MEASURES) -> DataFrame:
    """D8 via ``pyspark.ml.stat.Correlation`` (matrix in one row)."""
    vec = VectorAssembler(inputCols=list(measures), outputCol="_v", handleInvalid="skip").transform(
        d.select(*[F.col(m).cast("double").alias(m) for m in measures])
    )
    return Correlation.corr(vec, "_v")


def category_drilldown(d: DataFrame) -> DataFrame:
    """Products, mean rating and mean price for every category (drill-down summary)."""
    return _has_category(d).groupBy("main_category").agg(
        F.count(F.lit(1)).alias("products"),
        F.avg("ratings_clean").alias("avg_rating"),
        F.avg("discount_price_clean").alias("avg_price"),
    )


def category_rating_histogram(d: DataFrame, bins: int = 20) -> DataFrame:
    """Rating histogram per category (fixed bins over [0, 5])."""
    return histogram(_has_category(d), "ratings_clean", 0.0, 5.0, bins, keys=["main_category"])

