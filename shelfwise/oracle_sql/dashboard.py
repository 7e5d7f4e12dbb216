"""Oracle SQL (DuckDB) for the dashboard data sets (D1-D9); doubles reported to 6 decimals."""

from shelfwise.operators.sampling import hash_key_sql
from shelfwise.oracle_sql.common import q, rnd, rtext, thousands

DASH = """
, dash0 AS (
    SELECT *,
        TRY_CAST(REPLACE(REPLACE(REPLACE(discount_price, '₹', ''), ',', ''), ' ', '') AS DOUBLE) AS discount_price_clean,
        TRY_CAST(REPLACE(REPLACE(REPLACE(actual_price, '₹', ''), ',', ''), ' ', '') AS DOUBLE) AS actual_price_clean,
        TRY_CAST(TRIM(ratings) AS DOUBLE) AS ratings_clean,
        TRY_CAST(REPLACE(no_of_ratings, ',', '') AS BIGINT) AS no_of_ratings_clean
    FROM products
), dash AS (
    SELECT *,
        CASE WHEN actual_price_clean > discount_price_clean
             THEN (actual_price_clean - discount_price_clean) / actual_price_clean * 100.0e0 ELSE 0.0e0 END AS discount_percentage,
        ratings_clean * 0.6e0 + (LN(CAST(no_of_ratings_clean AS DOUBLE) + 1.0e0) / 10.0e0) * 0.4e0 AS quality_score
    FROM dash0
    WHERE discount_price_clean IS NOT NULL AND ratings_clean IS NOT NULL AND no_of_ratings_clean IS NOT NULL
), dcat AS (SELECT * FROM dash WHERE main_category IS NOT NULL)
, flags AS (
    SELECT *, COALESCE(ratings_clean >= 4.0 AND no_of_ratings_clean >=
        (SELECT quantile_cont(CAST(no_of_ratings_clean AS DOUBLE), 0.7) FROM dash), FALSE) AS is_successful
    FROM dash
)"""


def _bin(v: str, lo: float, hi: float, bins: int) -> str:
    return (
        f"CASE WHEN {v} < {lo} THEN 0 WHEN {v} > {hi} THEN {bins + 1} WHEN {v} = {hi} THEN {bins} "
        f"ELSE CAST(FLOOR({float(bins)}e0 * ({v} - {lo}e0) / {float(hi - lo)}e0) AS BIGINT) + 1 END"
    )


def _hist(source: str, keys: str = "", bins: int = 20) -> str:
    width = 5.0 / bins
    kp = f"{keys}, " if keys else ""
    return f"""
SELECT {kp}bin, {rnd(f"0.0e0 + CAST(bin - 1 AS DOUBLE) * {width}e0", 6)} AS bin_start,
       {rnd(f"0.0e0 + CAST(bin AS DOUBLE) * {width}e0", 6)} AS bin_end, COUNT(*) AS count
FROM (SELECT {kp}{_bin("ratings_clean", 0.0, 5.0, bins)} AS bin FROM {source} WHERE ratings_clean IS NOT NULL) b
GROUP BY {kp}bin"""


D1 = q(DASH + f"""
SELECT product_id, name, main_category, sub_category, ratings, no_of_ratings, discount_price, actual_price, image, link,
    {rnd("discount_price_clean", 6)} AS discount_price_clean, {rnd("actual_price_clean", 6)} AS actual_price_clean,
    {rnd("ratings_clean", 6)} AS ratings_clean, no_of_ratings_clean,
    {rnd("discount_percentage", 6)} AS discount_percentage, {rnd("quality_score", 6)} AS quality_score
FROM dash
""")

D2A = q(DASH + """
SELECT main_category, COUNT(*) AS product_count FROM dcat GROUP BY main_category
ORDER BY product_count DESC, main_category LIMIT 10
""")

D2B = q(DASH + _hist("dash"))

_SAMPLE_KEY = hash_key_sql()

D2C = q(DASH + f"""
SELECT product_id, {rnd("discount_price_clean", 6)} AS discount_price_clean, {rnd("ratings_clean", 6)} AS ratings_clean,
    no_of_ratings_clean
FROM dash ORDER BY {_SAMPLE_KEY}, product_id LIMIT 1000
""")


def _top_quality(n: int) -> str:
    return q(DASH + f"""
SELECT main_category, {rnd("AVG(quality_score)", 6)} AS quality_score FROM dcat GROUP BY main_category
ORDER BY AVG(quality_score) DESC, main_category LIMIT {n}
""")


D2D = _top_quality(10)
D7B = _top_quality(5)

_METRICS = """
, metrics AS (
    SELECT main_category, {r} AS avg_rating, COUNT(ratings_clean) AS product_count, {p} AS avg_price,
        CAST(SUM(no_of_ratings_clean) AS BIGINT) AS total_reviews, {qs} AS quality_score, {dd} AS avg_discount
    FROM dcat GROUP BY main_category
)""".format(
    r=rnd("AVG(ratings_clean)", 2),
    p=rnd("AVG(discount_price_clean)", 2),
    qs=rnd("AVG(quality_score)", 2),
    dd=rnd("AVG(discount_percentage)", 2),
)

D3A = q(DASH + _METRICS + "\nSELECT * FROM metrics")

_HEAT = ("avg_rating", "avg_price", "quality_score", "avg_discount")
D3B = q(DASH + _METRICS + """
, mm AS (SELECT {aggs} FROM metrics)
SELECT main_category, metric, {v} AS value FROM (
    {unions}
) u
""".format(
    aggs=", ".join(f"MIN({c}) AS min_{c}, MAX({c}) AS max_{c}" for c in _HEAT),
    v=rnd("value", 6),
    unions="\n    UNION ALL ".join(
        f"SELECT main_category, '{c}' AS metric, CASE WHEN max_{c} - min_{c} != 0 THEN ({c} - min_{c}) / (max_{c} - min_{c}) END AS value FROM metrics CROSS JOIN mm"
        for c in _HEAT
    ),
))

D4A = q(DASH + f"""
, seg AS (
    SELECT *, CASE WHEN discount_price_clean <= 0 THEN NULL WHEN discount_price_clean <= 500 THEN 'Budget'
        WHEN discount_price_clean <= 1000 THEN 'Economy' WHEN discount_price_clean <= 2000 THEN 'Mid-Range'
        WHEN discount_price_clean <= 5000 THEN 'Premium' ELSE 'Luxury' END AS price_segment
    FROM dash
)
SELECT price_segment, {rnd("AVG(ratings_clean)", 6)} AS avg_rating, COUNT(*) AS product_count
FROM seg WHERE price_segment IS NOT NULL GROUP BY price_segment
""")


def _top_by_count(n: int) -> str:
    return f"(SELECT main_category FROM dcat GROUP BY main_category ORDER BY COUNT(*) DESC, main_category LIMIT {n})"


D4B = q(DASH + f"""
, bx AS (
    SELECT main_category, COUNT(discount_price_clean) AS count,
        quantile_cont(discount_price_clean, 0.0) AS mn, quantile_cont(discount_price_clean, 0.25) AS q1,
        quantile_cont(discount_price_clean, 0.5) AS md, quantile_cont(discount_price_clean, 0.75) AS q3,
        quantile_cont(discount_price_clean, 1.0) AS mx
    FROM dash WHERE main_category IN {_top_by_count(5)} GROUP BY main_category
)
SELECT main_category, count, {rnd("mn", 6)} AS min, {rnd("q1", 6)} AS q1, {rnd("md", 6)} AS median,
    {rnd("q3", 6)} AS q3, {rnd("mx", 6)} AS max,
    {rnd("q1 - 1.5e0 * (q3 - q1)", 6)} AS lower_fence, {rnd("q3 + 1.5e0 * (q3 - q1)", 6)} AS upper_fence
FROM bx
""")

D4C = q(DASH + f"""
SELECT product_id, {rnd("discount_percentage", 6)} AS discount_percentage, {rnd("ratings_clean", 6)} AS ratings_clean
FROM dash ORDER BY {_SAMPLE_KEY}, product_id LIMIT 500
""")

D4D = q(DASH + f"""
, rows3 AS (SELECT * FROM dash WHERE main_category IN {_top_by_count(3)}),
rng AS (SELECT main_category, MIN(discount_price_clean) AS lo, MAX(discount_price_clean) AS hi FROM rows3 GROUP BY main_category),
binned AS (
    SELECT r.main_category, lo, hi,
        CASE WHEN hi = lo OR discount_price_clean = hi THEN 20
             ELSE CAST(FLOOR(20.0e0 * (discount_price_clean - lo) / (hi - lo)) AS BIGINT) + 1 END AS bin
    FROM rows3 r JOIN rng ON r.main_category = rng.main_category
)
SELECT main_category, bin, {rnd("lo + CAST(bin - 1 AS DOUBLE) * ((hi - lo) / 20.0e0)", 6)} AS bin_start,
    {rnd("lo + CAST(bin AS DOUBLE) * ((hi - lo) / 20.0e0)", 6)} AS bin_end, COUNT(*) AS count
FROM binned GROUP BY main_category, lo, hi, bin
""")

D4E = q(DASH + f"""
, med AS (SELECT main_category, quantile_cont(discount_price_clean, 0.5) AS m FROM dcat GROUP BY main_category)
SELECT product_id, name, d.main_category, {rnd("ratings_clean", 6)} AS ratings_clean,
    {rnd("discount_price_clean", 6)} AS discount_price_clean, no_of_ratings_clean
FROM dash d JOIN med ON d.main_category = med.main_category
WHERE ratings_clean >= 4.5 AND discount_price_clean <= med.m
ORDER BY no_of_ratings_clean DESC, product_id LIMIT 10
""")

D5A = q(DASH + f"""
SELECT product_id, name, main_category, sub_category, ratings, no_of_ratings, discount_price, actual_price, image, link,
    {rnd("discount_price_clean", 6)} AS discount_price_clean, {rnd("actual_price_clean", 6)} AS actual_price_clean,
    {rnd("ratings_clean", 6)} AS ratings_clean, no_of_ratings_clean,
    {rnd("discount_percentage", 6)} AS discount_percentage, {rnd("quality_score", 6)} AS quality_score, is_successful
FROM flags
""")

D5B = q(DASH + f"""
SELECT main_category, CAST(SUM(CAST(is_successful AS BIGINT)) AS BIGINT) AS successful, COUNT(*) AS products,
    {rnd("CAST(SUM(CAST(is_successful AS BIGINT)) AS DOUBLE) / COUNT(*) * 100.0e0", 6)} AS success_rate
FROM flags WHERE main_category IS NOT NULL GROUP BY main_category
ORDER BY CAST(SUM(CAST(is_successful AS BIGINT)) AS DOUBLE) / COUNT(*) * 100.0e0 DESC, main_category LIMIT 10
""")

D5C = q(DASH + f"""
SELECT product_id, no_of_ratings_clean, {rnd("ratings_clean", 6)} AS ratings_clean, is_successful,
    {rnd("discount_price_clean", 6)} AS discount_price_clean, {rnd("quality_score", 6)} AS quality_score,
    {rnd("discount_percentage", 6)} AS discount_percentage
FROM flags ORDER BY {_SAMPLE_KEY}, product_id LIMIT 1000
""")

D5D = q(DASH + f"""
SELECT is_successful, 'discount_percentage' AS factor, {rnd("AVG(discount_percentage)", 6)} AS mean FROM flags GROUP BY is_successful
UNION ALL
SELECT is_successful, 'quality_score', {rnd("AVG(quality_score)", 6)} FROM flags GROUP BY is_successful
""")

D5E = q(DASH + f"""
SELECT {rnd("AVG(CAST(is_successful AS DOUBLE)) * 100.0e0", 6)} AS success_rate,
    {rnd("AVG(CASE WHEN is_successful THEN ratings_clean END)", 6)} AS successful_avg_rating,
    {rnd("AVG(CASE WHEN is_successful THEN no_of_ratings_clean END)", 6)} AS successful_avg_reviews
FROM flags
""")

_MARKET = f"""
, market AS (
    SELECT main_category, sub_category, COUNT(ratings_clean) AS product_count,
        {rnd("AVG(ratings_clean)", 2)} AS avg_rating, CAST(SUM(no_of_ratings_clean) AS BIGINT) AS demand_signal,
        {rnd("AVG(discount_price_clean)", 2)} AS avg_price,
        CAST(SUM(no_of_ratings_clean) AS DOUBLE) / COUNT(ratings_clean) AS opportunity_score
    FROM dcat GROUP BY main_category, sub_category
)"""

D6A = q(DASH + _MARKET + f"""
SELECT main_category, sub_category, product_count, avg_rating, demand_signal, avg_price,
    {rnd("opportunity_score", 6)} AS opportunity_score FROM market
""")

D6B = q(DASH + _MARKET + f"""
SELECT main_category, sub_category, product_count, avg_rating, demand_signal, avg_price,
    {rnd("opportunity_score", 6)} AS opportunity_score
FROM market WHERE product_count < 20 AND demand_signal > 500
ORDER BY opportunity_score DESC, main_category, sub_category LIMIT 15
""")

D7A = q(DASH + f"""
SELECT 'Total Products Analyzed' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM dash
UNION ALL SELECT 'Product Categories', CAST(COUNT(DISTINCT main_category) AS DOUBLE) FROM dash
UNION ALL SELECT 'Average Product Rating', {rnd("AVG(ratings_clean)", 6)} FROM dash
UNION ALL SELECT 'Average Product Price', {rnd("AVG(discount_price_clean)", 6)} FROM dash
UNION ALL SELECT 'Total Customer Reviews', CAST(SUM(no_of_ratings_clean) AS DOUBLE) FROM dash
""")

D7C = q(DASH + f"""
, m AS (SELECT quantile_cont(discount_price_clean, 0.5) AS med FROM dash),
c AS (
    SELECT COUNT(*) AS products,
        COUNT(CASE WHEN ratings_clean >= 4.5 AND discount_price_clean <= m.med THEN 1 END) AS high_quality_low_price,
        COUNT(CASE WHEN ratings_clean >= 4 THEN 1 END) AS rated_4_plus,
        COUNT(CASE WHEN discount_price_clean > 2000 THEN 1 END) AS premium_over_2000
    FROM dash CROSS JOIN m
)
SELECT products, high_quality_low_price, {rnd("high_quality_low_price * 100.0e0 / products", 6)} AS high_quality_low_price_pct,
    rated_4_plus, premium_over_2000
FROM c
""")

_MEASURES = ("ratings_clean", "discount_price_clean", "no_of_ratings_clean", "quality_score")
_CORRELATIONS = """
, f AS (SELECT * FROM dash WHERE {where})
{unions}
"""
_D8_UNIONS = ("\nUNION ALL\n".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {rnd(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 6)} AS corr FROM f"
        for a in _MEASURES
        for b in _MEASURES
    )
)
D8 = q(DASH + _CORRELATIONS.format(where="TRUE", unions=_D8_UNIONS))
D8_FILTERED = q(DASH + _CORRELATIONS.format(
    where="discount_price_clean BETWEEN 500.0 AND 5000.0 AND main_category IN ('Category 0', 'Category 1')", unions=_D8_UNIONS))

D9 = q(DASH + f"""
SELECT main_category, COUNT(*) AS products, {rnd("AVG(ratings_clean)", 6)} AS avg_rating,
    {rnd("AVG(discount_price_clean)", 6)} AS avg_price
FROM dcat GROUP BY main_category
""")

D9_HIST = q(DASH + _hist("dcat", keys="main_category"))


D5C_MARKED = q(DASH + f"""
SELECT product_id, no_of_ratings_clean, {rnd("ratings_clean", 6)} AS ratings_clean, IF(is_successful, 'green', 'red') AS marker
FROM flags ORDER BY {_SAMPLE_KEY}, product_id LIMIT 1000
""")

# The report's lines: figures of the whole table, the best categories, the insights.
D7_LINES = q(DASH + f"""
, whole AS (
    SELECT COUNT(*) AS products, COUNT(DISTINCT main_category) AS categories, AVG(ratings_clean) AS rating, AVG(discount_price_clean) AS price,
        SUM(no_of_ratings_clean) AS reviews, quantile_cont(discount_price_clean, 0.5) AS middle,
        COUNT(*) FILTER (ratings_clean >= 4) AS liked, COUNT(*) FILTER (discount_price_clean > 2000) AS dear
    FROM dash
), bargains AS (
    SELECT COUNT(*) AS n FROM dash, whole WHERE ratings_clean >= 4.5 AND discount_price_clean <= middle
), best AS (
    SELECT main_category, AVG(quality_score) AS score FROM dash WHERE main_category IS NOT NULL GROUP BY main_category
    ORDER BY score DESC, main_category LIMIT 5
)
SELECT 'metric' AS section, 1 AS position, 'Total Products Analyzed' AS name, {thousands("products")} AS shown FROM whole
UNION ALL SELECT 'metric', 2, 'Product Categories', CAST(categories AS VARCHAR) FROM whole
UNION ALL SELECT 'metric', 3, 'Average Product Rating', {rtext("rating", 2)} || '/5.0' FROM whole
UNION ALL SELECT 'metric', 4, 'Average Product Price', '₹' || {thousands("price")} FROM whole
UNION ALL SELECT 'metric', 5, 'Total Customer Reviews', {thousands("reviews")} FROM whole
UNION ALL SELECT 'category', CAST(row_number() OVER (ORDER BY score DESC, main_category) AS INTEGER), main_category, {rtext("score", 2)} FROM best
UNION ALL SELECT 'insight', 1, 'High-Quality, Low-Price Products', CAST(n AS VARCHAR) || ' (' || {rtext("n * 100.0e0 / products", 1)} || '%)' FROM bargains, whole
UNION ALL SELECT 'insight', 2, 'Products with 4+ Rating', CAST(liked AS VARCHAR) FROM whole
UNION ALL SELECT 'insight', 3, 'Premium Products (>₹2000)', CAST(dear AS VARCHAR) FROM whole
""")
