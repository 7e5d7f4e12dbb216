"""KPI dashboard (K1-K9): executive cards, category KPIs, competition and action lists.

Formatted outputs follow the decimal conventions of a SQL report: rounded
values print with their scale (``4.10``), ``FORMAT(x, 0)`` rounds half-up and
adds thousands separators. Numeric labels compare the rounded values where
the report does, and the exact averages (``SUM`` vs ``threshold * COUNT``)
where it tests the raw aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed
from shelfwise.functions import first_match, ordinal, pct, round_dec, round_text, round_to, thousands, threshold_labels
from shelfwise.operators import (
    avg_cmp,
    global_ranks,
    nps,
    one_row,
    sized,
    top_k_concentration,
    weighted_avg,
    with_percentiles,
)
from shelfwise.plans.common import d, parsed, valid


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def executive_card(products: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """K1: one-row executive KPI card of formatted strings.

    ``approx_distinct`` counts categories with HyperLogLog++ (no Expand of the
    rows per distinct column) for very large inputs.
    """
    rows = valid(parsed(products), "rating", "count", "price")
    distinct = F.approx_count_distinct if approx_distinct else F.countDistinct
    k = rows.agg(
        F.count(F.lit(1)).alias("n"),
        distinct("main_category").alias("cats"),
        distinct("sub_category").alias("subs"),
        round_dec(F.avg("rating"), 2).alias("avg_rating"),
        round_dec(F.avg("price"), 2).alias("avg_price"),
        F.sum("review_count").alias("reviews"),
        F.count_if(F.col("rating") >= 4.0).alias("hq"),
        F.count_if(F.col("review_count") >= 100).alias("est"),
        F.count_if(F.col("price") >= 2000).alias("prem"),
    )
    total, cats, subs, rating, out_of, price, reviews, quality, established, premium = fixed.EXECUTIVE_TEXTS
    return k.select(
        F.lit(fixed.EXECUTIVE_TITLE).alias("dashboard_title"),
        _cat(total, thousands("n")).alias("metric_1"),
        _cat(cats, F.col("cats").cast("string"), subs, F.col("subs").cast("string")).alias("metric_2"),
        _cat(rating, round_text("avg_rating", 2), out_of).alias("metric_3"),
        _cat(price, thousands("avg_price")).alias("metric_4"),
        _cat(reviews, thousands("reviews")).alias("metric_5"),
        _cat(quality, round_text(pct(F.col("hq"), F.col("n")), 1), "%").alias("metric_6"),
        _cat(established, round_text(pct(F.col("est"), F.col("n")), 1), "%").alias("metric_7"),
        _cat(premium, round_text(pct(F.col("prem"), F.col("n")), 1), "%").alias("metric_8"),
    )


def performance_trends(products: DataFrame, min_products: int = 10) -> DataFrame:
    """K2 per category: trend status and market share (share of all rows with a category).

    One scan: the valid-row aggregates are conditional, and the share
    denominator is the sum of all-row counts of the non-NULL categories.
    """
    p = parsed(products)
    ok = F.col("v_rating") & F.col("v_count") & F.col("v_price")

    def w(c: str) -> Column:
        return F.when(ok, F.col(c))

    n = F.count_if(ok)
    cats = p.groupBy("main_category").agg(
        F.count(F.lit(1)).alias("_all_rows"),
        n.alias("product_count"),
        round_dec(F.avg(w("rating")), 2).alias("avg_rating"),
        F.sum(w("review_count")).cast("bigint").alias("total_engagement"),
        round_dec(F.avg(w("price")), 2).alias("avg_price"),
        first_match(
            [avg_cmp(w("rating"), ">", 4.0) & (n > 50), avg_cmp(w("rating"), ">", 3.5) & (n > 30)],
            fixed.TREND_STATUSES,
        ).alias("trend_status"),
    )
    denom = one_row(cats.agg(F.sum(F.when(F.col("main_category").isNotNull(), F.col("_all_rows"))).alias("_denom")))
    return (
        cats.crossJoin(denom)
        .select(
            "main_category",
            "product_count",
            F.col("avg_rating").cast("double").alias("avg_rating"),
            "total_engagement",
            F.col("avg_price").cast("double").alias("avg_price"),
            "trend_status",
            round_to(pct(F.col("product_count"), F.col("_denom")), 2).alias("market_share"),
        )
        .where(F.col("product_count") >= min_products)
    )


def trending_summary(products: DataFrame) -> DataFrame:
    """K2: one-row summary of trend statuses and the averages of growing categories."""
    t = performance_trends(products)
    growing_label, stable_label, declining_label = fixed.TREND_STATUSES
    growing = F.col("trend_status") == growing_label
    s = t.agg(
        F.count_if(growing).alias("g"),
        F.count_if(F.col("trend_status") == stable_label).alias("s"),
        F.count_if(F.col("trend_status") == declining_label).alias("dcl"),
        round_dec(F.avg(F.when(growing, F.col("total_engagement"))), 0).alias("eng"),
        round_dec(F.avg(F.when(growing, F.col("avg_rating"))), 2).alias("rat"),
    )
    growing_t, stable_t, declining_t, engagement_t, quality_t = fixed.TREND_TEXTS
    out_of = fixed.EXECUTIVE_TEXTS[4]
    return s.select(
        F.lit(fixed.TREND_SECTION).alias("section"),
        _cat(growing_t, F.col("g").cast("string")).alias("trend_1"),
        _cat(stable_t, F.col("s").cast("string")).alias("trend_2"),
        _cat(declining_t, F.col("dcl").cast("string")).alias("trend_3"),
        _cat(engagement_t, thousands("eng")).alias("trend_4"),
        _cat(quality_t, round_text("rat", 2), out_of).alias("trend_5"),
    )


def category_performance(products: DataFrame, min_products: int = 10, all_ranks: bool = False) -> DataFrame:
    """K3: revenue index, performance score, ranks and BCG label per category.

    ``all_ranks=True`` adds the ranks that the report leaves out.
    """
    rows = valid(parsed(products), "rating", "count", "price")
    rc = F.col("review_count")
    n = F.count(F.lit(1))
    score = (
        F.avg(d("rating")) * F.lit(0.4)
        + (F.log(F.sum(rc).cast("double") + F.lit(1.0)) / F.lit(10.0)) * F.lit(0.3)
        + (n.cast("double") / F.lit(10.0)) * F.lit(0.3)
    )
    cats = (
        rows.groupBy("main_category")
        .agg(
            n.alias("total_products"),
            round_dec(F.avg("rating"), 2).alias("avg_rating"),
            round_dec(F.avg("price"), 2).alias("avg_price"),
            F.sum(rc).cast("bigint").alias("total_reviews"),
            F.count_if(F.col("rating") >= 4.0).alias("quality_products"),
            round_dec(F.avg(F.col("price") * rc) * F.lit(0.01).cast("decimal(3,2)"), 2).alias("revenue_index"),
            round_dec(score, 2).alias("performance_score"),
        )
        .where(F.col("total_products") >= min_products)
    )
    ps, rev = F.col("performance_score"), F.col("revenue_index")
    bcg = first_match(
        [
            (ps >= 4.0) & (rev >= 1000),
            (ps >= 3.5) & (F.col("total_reviews") >= 10000),
            (ps >= 3.5) & (F.col("total_products") >= 50),
        ],
        fixed.BCG_LABELS,
    )
    orders = {"performance_rank": "performance_score"}
    helpers = {"revenue_rank": "revenue_index", "engagement_rank": "total_reviews"} if all_ranks else {}
    ranked = global_ranks(cats, "main_category", orders | helpers).select("*", bcg.alias("bcg_matrix"))
    advice = first_match([F.col("bcg_matrix") == b for b in fixed.BCG_LABELS[:-1]], fixed.BCG_ADVICE)
    return ranked.select(
        "main_category",
        "total_products",
        F.col("avg_rating").cast("double").alias("avg_rating"),
        round_to(pct(F.col("quality_products"), F.col("total_products")), 1).alias("quality_rate"),
        F.col("avg_price").cast("double").alias("avg_price"),
        "total_reviews",
        rev.cast("double").alias("revenue_index"),
        ps.cast("double").alias("performance_score"),
        "performance_rank",
        "bcg_matrix",
        advice.alias("strategic_recommendation"),
        *helpers,
    ).orderBy("performance_rank", "main_category")


def pricing_intelligence(products: DataFrame, min_products: int = 15, exact: bool = True, spread: bool = False) -> DataFrame:
    """K4: price distribution, budget/premium shares, market position and strategy per category.

    ``spread=True`` adds the median price and its sample deviation, which the report leaves out.
    """
    rows = valid(parsed(products), "rating", "price")
    price = F.col("price")
    cats = (
        rows.groupBy("main_category")
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.min(price).alias("min_price"),
            F.max(price).alias("max_price"),
            round_dec(F.avg(price), 2).alias("avg_price"),
            round_dec(F.avg("rating"), 2).alias("avg_rating"),
            F.count_if(price < 500).alias("budget_products"),
            F.count_if(price >= 2000).alias("premium_products"),
            *([round_to(F.stddev_samp(price.cast("double")), 2).alias("price_stddev")] if spread else []),
        )
        .where(F.col("products") >= min_products)
    )
    if spread:
        cats = with_percentiles(cats, rows, ["main_category"], {"_median": (price, 0.5)}, exact)
        cats = cats.withColumn("median_price", round_to("_median", 2))
    ap, ar = F.col("avg_price"), F.col("avg_rating")
    position = threshold_labels(ap, fixed.MARKET_POSITIONS, fixed.MARKET_POSITION_DEFAULT)
    strategy = first_match(
        [(ar >= 4.2) & (ap >= 1500), (ar >= 4.0) & ap.between(500, 1500), (ar >= 3.8) & (ap < 500)],
        fixed.POSITIONING_STRATEGIES,
    )
    advice = first_match(
        [F.col("positioning_strategy") == p for p in fixed.POSITIONING_STRATEGIES[:-1]], fixed.POSITIONING_ADVICE
    )
    return (
        cats.select("*", position.alias("market_position"), strategy.alias("positioning_strategy"))
        .orderBy(ap.desc(), "main_category")
        .select(
            "main_category",
            "products",
            "market_position",
            _cat("₹", thousands("min_price"), " - ₹", thousands("max_price")).alias("price_range"),
            _cat("₹", thousands("avg_price")).alias("avg_price"),
            ar.cast("double").alias("avg_rating"),
            _cat(round_text(pct(F.col("budget_products"), F.col("products")), 1), "%").alias("budget_share"),
            _cat(round_text(pct(F.col("premium_products"), F.col("products")), 1), "%").alias("premium_share"),
            "positioning_strategy",
            advice.alias("pricing_recommendation"),
            *(["median_price", "price_stddev"] if spread else []),
        )
    )


def satisfaction_nps(products: DataFrame, min_products: int = 10) -> DataFrame:
    """K5: rating bands, weighted rating, satisfaction rates, NPS approximation and status."""
    rows = valid(parsed(products), "rating", "count")
    r, rc = F.col("rating"), F.col("review_count")
    cats = (
        rows.groupBy("main_category")
        .agg(
            F.count(F.lit(1)).alias("total_products"),
            F.count_if(r >= 4.5).alias("e"),
            F.count_if((r >= 4.0) & (r < 4.5)).alias("g"),
            F.count_if(r < 3.5).alias("p"),
            round_dec(F.avg(r), 2).alias("avg_rating"),
            F.sum(rc).cast("bigint").alias("total_reviews"),
            round_dec(F.avg(rc), 0).alias("avg_reviews_per_product"),
            round_dec(weighted_avg(r, rc), 2).alias("weighted_avg_rating"),
        )
        .where(F.col("total_products") >= min_products)
    )
    t = F.col("total_products")
    sat = round_dec(pct(F.col("e") + F.col("g"), t), 1)
    exc = round_dec(pct(F.col("e"), t), 1)
    score = round_dec(nps(F.col("e"), F.col("p"), t), 1)
    a = cats.select("*", sat.alias("sat"), exc.alias("exc"), score.alias("nps"))
    s, np_ = F.col("sat"), F.col("nps")
    engagement = threshold_labels("avg_reviews_per_product", fixed.ENGAGEMENT_LEVELS, fixed.ENGAGEMENT_DEFAULT)
    status = first_match(
        [(s >= 80) & (np_ >= 50), (s >= 70) & (np_ >= 30), (s >= 60) & (np_ >= 10)], fixed.CUSTOMER_STATUSES
    )
    plan = threshold_labels(np_, fixed.ACTION_PLANS, fixed.ACTION_PLAN_DEFAULT)
    return a.orderBy(s.desc(), "main_category").select(
        "main_category",
        "total_products",
        _cat(s.cast("string"), "%").alias("satisfaction_rate"),
        _cat(F.col("exc").cast("string"), "%").alias("excellent_rate"),
        F.col("avg_rating").cast("double").alias("avg_rating"),
        F.col("weighted_avg_rating").cast("double").alias("weighted_avg_rating"),
        thousands("total_reviews").alias("total_reviews"),
        engagement.alias("engagement_level"),
        np_.cast("double").alias("nps_approx"),
        status.alias("customer_status"),
        plan.alias("action_plan"),
    )


def revenue_impact(products: DataFrame, min_products: int = 15, all_ranks: bool = False) -> DataFrame:
    """K6: revenue proxy, value ratio, ranks, share of the grand total and segment per category.

    ``all_ranks=True`` adds the ranks that the report leaves out.
    """
    rows = valid(parsed(products), "rating", "count", "price")
    rc, price = F.col("review_count"), F.col("price")
    value = F.try_divide(d("rating"), d("price") / F.lit(1000.0))
    cats = (
        rows.groupBy("main_category")
        .agg(
            F.count(F.lit(1)).alias("product_count"),
            F.sum(rc).cast("bigint").alias("customer_base_proxy"),
            round_dec(F.avg(price), 2).alias("avg_selling_price"),
            round_dec(F.sum(price * rc) * F.lit(0.01).cast("decimal(3,2)"), 2).alias("revenue_proxy"),
            round_to(F.avg(value), 3).alias("value_ratio"),
        )
        .where(F.col("product_count") >= min_products)
    )
    rev, cust, val = F.col("revenue_proxy"), F.col("customer_base_proxy"), F.col("value_ratio")
    segment = first_match(
        [
            (rev >= 100000) & (cust >= 50000),
            (rev >= 50000) & (cust >= 20000),
            (rev >= 20000) & (val >= 2.0),
            rev >= 10000,
        ],
        fixed.BUSINESS_SEGMENTS,
    )
    total = one_row(cats.agg(F.sum(rev.cast("double")).alias("_rev_total")))
    share = round_text(pct(rev.cast("double"), F.col("_rev_total")), 2)
    orders = {"revenue_rank": "revenue_proxy"}
    helpers = {"customer_rank": "customer_base_proxy", "value_rank": "value_ratio"} if all_ranks else {}
    ranked = global_ranks(cats, "main_category", orders | helpers).crossJoin(total).select(
        "*",
        share.alias("_share"),
        segment.alias("business_segment"),
    )
    advice = first_match(
        [F.col("business_segment") == b for b in fixed.BUSINESS_SEGMENTS[:-1]], fixed.INVESTMENT_ADVICE
    )
    return ranked.orderBy("revenue_rank", "main_category").select(
        "main_category",
        "business_segment",
        thousands(rev).alias("revenue_index"),
        _cat(F.col("_share"), "%").alias("market_share"),
        thousands(cust).alias("customer_base"),
        _cat("₹", thousands("avg_selling_price")).alias("avg_price"),
        val.alias("value_ratio"),
        "revenue_rank",
        advice.alias("investment_strategy"),
        *helpers,
    )


def competition(products: DataFrame, min_products: int = 5, min_reviews: int = 1000) -> DataFrame:
    """K7: per sub-category competition: top-3 review concentration, price spread, structure.

    The top-3 sum is taken over every row of the sub-category with a review
    count (not only fully valid rows), so it can exceed the valid total. It is
    a partial top-3 (WindowGroupLimit) summed per key and left-joined; NULL
    keys never match, leaving the concentration NULL.
    """
    p = parsed(products)
    rows = valid(p, "rating", "count", "price")
    keys = ["main_category", "sub_category"]
    land = (
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("competitors"),
            round_dec(F.avg("rating"), 2).alias("category_avg_rating"),
            round_dec(F.avg("price"), 2).alias("category_avg_price"),
            F.min("price").alias("lowest_price"),
            F.max("price").alias("highest_price"),
            F.sum("review_count").cast("bigint").alias("total_market_reviews"),
        )
        .where(F.col("competitors") >= min_products)
    )
    cand = p.where(F.col("no_of_ratings").isNotNull()).select("product_id", *keys, "review_count")
    # Top-3 over every row with a review count, divided by the valid-row total;
    # the equality join leaves NULL keys unmatched (concentration NULL).
    joined = top_k_concentration(cand, keys, "review_count", 3, "product_id", land, "total_market_reviews")
    spread = round_dec(
        (F.col("highest_price") - F.col("lowest_price")).cast("double")
        * F.lit(100.0)
        / F.col("category_avg_price").cast("double"),
        1,
    )
    m = joined.select(
        "*", spread.alias("price_spread_percent"), round_dec(F.col("concentration"), 1).alias("market_concentration")
    )
    c, mc, sp = F.col("competitors"), F.col("market_concentration"), F.col("price_spread_percent")
    structure = first_match(
        [(c >= 20) & (mc <= 50), (c >= 10) & (mc <= 70), (c >= 5) & (mc <= 85)], fixed.MARKET_STRUCTURES
    )
    dynamics = threshold_labels(sp, fixed.PRICING_DYNAMICS, fixed.PRICING_DYNAMICS_DEFAULT, op="<=")
    advice = first_match(
        [F.col("market_structure_type") == m for m in fixed.MARKET_STRUCTURES[:-1]], fixed.COMPETITION_ADVICE
    )
    return (
        m.select("*", structure.alias("market_structure_type"), dynamics.alias("pricing_dynamics"))
        .where(F.col("total_market_reviews") >= min_reviews)
        .orderBy(F.col("total_market_reviews").desc(), *keys)
        .select(
            *keys,
            "competitors",
            "market_structure_type",
            _cat(mc.cast("string"), "%").alias("top3_dominance"),
            F.col("category_avg_rating").cast("double").alias("category_avg_rating"),
            _cat("₹", thousands("category_avg_price")).alias("avg_market_price"),
            _cat(sp.cast("string"), "%").alias("price_variance"),
            "pricing_dynamics",
            advice.alias("competitive_strategy"),
        )
    )


def action_priorities(products: DataFrame) -> DataFrame:
    """K8: UNION of revenue, quality and expansion actions per category, by priority.

    Two scans: category price sums (exact mean test ``price * n < sum``; a NULL
    category never matches, as in a correlated equality subquery), then one
    conditional aggregate per category that feeds all three action blocks.
    """
    p = parsed(products)
    stats = p.groupBy("main_category").agg(
        F.sum("price").alias("_cat_sum"), F.count("price").alias("_cat_n")
    ).where(F.col("main_category").isNotNull())
    side = sized(stats)
    rows = p.join(side, "main_category", "left")
    r, rc, price = F.col("rating"), F.col("review_count"), F.col("price")
    below_mean = price * F.col("_cat_n") < F.col("_cat_sum")
    expansion_pool = F.col("ratings").isNotNull() & F.col("no_of_ratings").isNotNull()
    agg = rows.groupBy("main_category").agg(
        F.count_if((r >= 4.5) & below_mean).alias("rev_n"),
        F.count_if((r < 3.8) & (rc > 100)).alias("qual_n"),
        F.count_if(expansion_pool).alias("exp_n"),
        F.sum(F.when(expansion_pool, rc)).alias("exp_demand"),
    )

    def block(keep: Column, cat: str, cnt: Column, desc: Column, prio: str, action: str) -> Column:
        return F.struct(
            keep.alias("_keep"),
            F.lit(cat).alias("action_category"),
            F.col("main_category").alias("focus_area"),
            cnt.cast("bigint").alias("opportunity_count"),
            desc.alias("description"),
            F.lit(prio).alias("priority"),
            F.lit(action).alias("recommended_action"),
        )

    rev_cat, rev_desc, rev_prio, rev_action = fixed.REVENUE_ACTION
    qual_cat, qual_desc, qual_prio, qual_action = fixed.QUALITY_ACTION
    exp_cat, exp_desc, exp_prio, exp_action = fixed.EXPANSION_ACTION
    blocks = F.array(
        block(
            F.col("rev_n") >= 5,
            rev_cat,
            F.col("rev_n"),
            _cat(rev_desc, F.col("rev_n").cast("string")),
            rev_prio,
            rev_action,
        ),
        block(
            F.col("qual_n") >= 3,
            qual_cat,
            F.col("qual_n"),
            _cat(qual_desc, F.col("qual_n").cast("string")),
            qual_prio,
            qual_action,
        ),
        block(
            (F.col("exp_n") > 0) & (F.col("exp_n") < 30) & (F.col("exp_demand") > 5000),
            exp_cat,
            F.lit(1),
            F.lit(exp_desc),
            exp_prio,
            exp_action,
        ),
    )
    actions = agg.select(F.inline(blocks)).where(F.col("_keep")).drop("_keep")
    timeline = first_match([F.col("priority") == p for p in fixed.PRIORITIES[:-1]], fixed.TIMELINES)
    return actions.select("*", timeline.alias("timeline")).orderBy(
        ordinal("priority", fixed.PRIORITIES), F.col("opportunity_count").desc(), "action_category", "focus_area"
    )


def success_tracking(products: DataFrame) -> DataFrame:
    """K9: three success metrics (4+ rating, 100+ reviews, premium price) in one scan."""
    p = parsed(products)
    one = p.agg(
        F.count_if("v_rating").alias("t1"),
        F.count_if(F.col("v_rating") & (F.col("rating") >= 4.0)).alias("s1"),
        F.count_if("v_count").alias("t2"),
        F.count_if(F.col("v_count") & (F.col("review_count") >= 100)).alias("s2"),
        F.count_if("v_price").alias("t3"),
        F.count_if(F.col("v_price") & (F.col("price") >= 2000)).alias("s3"),
    )
    specs = [(cat, desc, f"t{i}", f"s{i}") for i, (cat, desc) in enumerate(fixed.SUCCESS_METRICS, start=1)]
    structs = [
        F.struct(
            F.lit(cat).alias("metric_category"),
            F.lit(desc).alias("metric_description"),
            F.col(t).alias("total_count"),
            F.col(s).alias("success_count"),
            round_dec(pct(F.col(s), F.col(t)), 1).alias("success_rate"),
        )
        for cat, desc, t, s in specs
    ]
    rows = one.select(F.inline(F.array(*structs)))
    rate = F.col("success_rate")
    status = threshold_labels(rate, fixed.SUCCESS_STATUSES, fixed.SUCCESS_STATUS_DEFAULT)
    return rows.orderBy(rate.desc()).select(
        "metric_category",
        "metric_description",
        thousands("total_count").alias("total_products"),
        thousands("success_count").alias("target_achieved"),
        _cat(rate.cast("string"), "%").alias("achievement_rate"),
        status.alias("performance_status"),
    )
