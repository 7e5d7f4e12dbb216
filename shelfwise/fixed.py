"""Fixed values of the analysed reports.

# ---------------------------------------------------------------------------
# FIXED VALUES: labels, advice texts, metric names and thresholds that must
# equal the reports' definitions for identical results. Stated plainly, in
# natural order (first matching rule first, default last), per report.
# ---------------------------------------------------------------------------

Threshold tables are ``((threshold, label), ...)`` tested with ``>=`` in
order, followed by the default label, unless noted otherwise.
"""

# --- E1 dataset overview metric names -----------------------------------------
OVERVIEW_METRICS = (
    "Total Records",
    "Total Categories",
    "Total Subcategories",
    "Products with Ratings",
    "Products with Prices",
)

# --- E2 format check statuses ---------------------------------------------------
STATUS_VALID_NUMERIC = "Valid Numeric"
STATUS_VALID_PRICE = "Valid Price"
STATUS_MISSING = "Missing"
STATUS_INVALID = "Invalid Format"

# --- E4 duplicate summary metric names -----------------------------------------
DUPLICATE_METRICS = ("Total Duplicate Groups", "Total Duplicate Records")

# --- E10 quality card ---------------------------------------------------------------
QUALITY_CARD_SECTION = "Data Quality Summary"
QUALITY_CARD_PREFIXES = (
    "Total Products: ",
    "Categories: ",
    "Rating Coverage: ",
    "Price Coverage: ",
    "Complete Records: ",
)

# --- A1 rating tier by within-category rating quartile 4, 3, 2, other ---------------
RATING_TIERS = ("Top Rated", "Good", "Average", "Below Average")

# --- A2 price segment by rounded mean price (strictly greater than) -------------------
CATEGORY_PRICE_SEGMENTS = ((2000, "Premium"), (500, "Mid-Range"))
CATEGORY_PRICE_SEGMENT_DEFAULT = "Budget"
# A2 status by (rating rank, review-volume rank)
CATEGORY_STATUSES = ("Top Performer", "Strong Performer", "Average Performer", "Underperformer")

# --- A3 pricing recommendation and position -----------------------------------------
PRICING_RECOMMENDATIONS = (
    "Underpriced - Consider Price Increase",
    "Overpriced - Consider Price Reduction",
    "Well Positioned - Premium Opportunity",
    "Optimally Priced",
    "Needs Analysis",
)
# price vs centred moving average: > 1.2, > 1.1, < 0.9, < 0.8 (after 0.9: never reached), else
PRICING_POSITIONS = (
    (">", "1.2", "High Premium"),
    (">", "1.1", "Premium"),
    ("<", "0.9", "Discount"),
    ("<", "0.8", "Deep Discount"),
)
PRICING_POSITION_DEFAULT = "Market Rate"

# --- A4 satisfaction level by rating, review volume by review count -----------------
SATISFACTION_LEVELS = ((4.5, "Highly Satisfied"), (4.0, "Satisfied"), (3.5, "Neutral"), (3.0, "Dissatisfied"))
SATISFACTION_LEVEL_DEFAULT = "Highly Dissatisfied"
SATISFIED_LEVELS = ("Highly Satisfied", "Satisfied")
VOLUME_LEVELS = ((1000, "High Volume"), (100, "Medium Volume"), (10, "Low Volume"))
VOLUME_LEVEL_DEFAULT = "Very Low Volume"

# --- A5 performance segment by (rating cohort, volume cohort) -----------------------
PERFORMANCE_SEGMENTS = (
    "Stars",
    "Rising Stars",
    "Popular",
    "Solid Performers",
    "High Volume Low Rating",
    "Hidden Gems",
    "Underperformers",
)

# --- A6 strategic position and recommendation -------------------------------------------
STRATEGIC_POSITIONS = (
    "Market Leader",
    "Strong Contender",
    "Growing Category",
    "Improvement Needed",
    "Strategic Review Required",
)
STRATEGY_ADVICE = (
    "Maintain excellence, expand product line",
    "Focus on premium products, enhance marketing",
    "Improve quality, increase customer engagement",
    "Quality improvement program, customer feedback analysis",
    "Comprehensive category review and repositioning",
)

# --- A7 market opportunity ----------------------------------------------------------------
MARKET_OPPORTUNITIES = (
    "Underserved High Quality",
    "High Demand Low Supply",
    "Quality Gap Opportunity",
    "Budget Option Gap",
    "Saturated",
)

# --- K1 executive card --------------------------------------------------------------------
EXECUTIVE_TITLE = "EXECUTIVE DASHBOARD - KEY METRICS"
EXECUTIVE_TEXTS = (
    "Total Products: ",
    "Categories: ",
    " | Subcategories: ",
    "Avg Rating: ",
    "/5.0",
    "Avg Price: ₹",
    "Total Reviews: ",
    "Quality Rate: ",
    "Established Products: ",
    "Premium Products: ",
)

# --- K2 trend status ------------------------------------------------------------------------
TREND_SECTION = "TRENDING PERFORMANCE METRICS"
TREND_STATUSES = ("Growing", "Stable", "Declining")
TREND_TEXTS = (
    "Growing Categories: ",
    "Stable Categories: ",
    "Declining Categories: ",
    "Growth Engagement: ",
    "Growth Quality: ",
)

# --- K3 BCG label and recommendation ------------------------------------------------------
BCG_LABELS = ("Star", "Cash Cow", "Question Mark", "Dog")
BCG_ADVICE = (
    "Maintain leadership, invest in growth",
    "Optimize efficiency, milk profits",
    "Strategic decision: invest or divest",
    "Consider repositioning or exit",
)

# --- K4 market position by rounded mean price, positioning strategy, recommendation ---------
MARKET_POSITIONS = ((2000, "Premium Market"), (1000, "Mid Market"), (500, "Mass Market"))
MARKET_POSITION_DEFAULT = "Budget Market"
POSITIONING_STRATEGIES = ("Premium Quality", "Value for Money", "Budget Quality", "Price-Quality Gap")
POSITIONING_ADVICE = (
    "Maintain premium positioning",
    "Scale and optimize",
    "Consider premium upgrades",
    "Urgent pricing review needed",
)

# --- K5 engagement by mean reviews, customer status, action plan by NPS -----------------
ENGAGEMENT_LEVELS = ((200, "High Engagement"), (50, "Medium Engagement"))
ENGAGEMENT_DEFAULT = "Low Engagement"
CUSTOMER_STATUSES = ("Customer Champions", "Customer Favorites", "Customer Neutral", "Customer Concern")
ACTION_PLANS = (
    (50, "Leverage for growth and referrals"),
    (30, "Focus on retention and upselling"),
    (10, "Quality improvement initiatives"),
)
ACTION_PLAN_DEFAULT = "Urgent customer experience overhaul"

# --- K6 business segment and investment strategy ------------------------------------------
BUSINESS_SEGMENTS = (
    "Major Revenue Driver",
    "Significant Contributor",
    "High Value Niche",
    "Growing Segment",
    "Emerging Category",
)
INVESTMENT_ADVICE = (
    "Strategic investment priority",
    "Optimize and scale operations",
    "Premium positioning strategy",
    "Growth acceleration initiatives",
    "Market development required",
)

# --- K7 market structure, pricing dynamics (<=), competitive strategy ----------------------
MARKET_STRUCTURES = ("Fragmented", "Competitive", "Concentrated", "Monopolistic")
PRICING_DYNAMICS = ((30, "Price Similarity"), (100, "Price Variance"))
PRICING_DYNAMICS_DEFAULT = "Price Fragmentation"
COMPETITION_ADVICE = (
    "Market leadership opportunity",
    "Differentiation strategy needed",
    "Niche positioning required",
    "Market disruption potential",
)

# --- K8 action blocks (category, description, priority, action) and timelines -------------
REVENUE_ACTION = (
    "Revenue Optimization",
    "High-rated products priced below market: ",
    "Immediate",
    "Price optimization review",
)
QUALITY_ACTION = (
    "Quality Enhancement",
    "Products with high engagement but low ratings: ",
    "High",
    "Quality improvement program",
)
EXPANSION_ACTION = (
    "Market Expansion",
    "Underserved category with high demand signals",
    "Medium",
    "Market entry strategy development",
)
PRIORITIES = ("Immediate", "High", "Medium")
TIMELINES = ("🔴 Act within 30 days", "🟡 Plan for next quarter", "🟢 Strategic planning cycle")

# --- K9 success metrics (category, description) and status by rate ----------------------
SUCCESS_METRICS = (
    ("Product Portfolio Health", "Products with 4+ rating"),
    ("Market Penetration", "Products with 100+ reviews"),
    ("Premium Positioning", "Premium products (₹2000+)"),
)
SUCCESS_STATUSES = ((80, "🟢 Excellent"), (60, "🟡 Good"), (40, "🟠 Fair"))
SUCCESS_STATUS_DEFAULT = "🔴 Needs Improvement"

# --- P3 feature labels ----------------------------------------------------------------------
PIPELINE_PRICE_SEGMENTS = ("Budget", "Mid-Range", "Premium")  # <= p33, <= p66, else
RATING_CATEGORIES = ((4.5, "Excellent"), (4.0, "Good"), (3.5, "Average"))
RATING_CATEGORY_DEFAULT = "Poor"
REVIEW_VOLUMES = ("High", "Medium", "Low")  # >= p80, >= median, else

# --- D7 key metric names ------------------------------------------------------------------------
KEY_METRICS = (
    "Total Products Analyzed",
    "Product Categories",
    "Average Product Rating",
    "Average Product Price",
    "Total Customer Reviews",
)

# --- D7 insight names, D5 marker texts (fixed values of the report) -------------------------------
INSIGHTS = (
    "High-Quality, Low-Price Products",
    "Products with 4+ Rating",
    "Premium Products (>₹2000)",
)
SUCCESS_MARKERS = {True: "green", False: "red"}
