"""Oracle SQL (DuckDB) for the feature pipeline (P2, P3, P7a-c, P8a-c)."""

from shelfwise.operators.sampling import fold_sql, in_train_sql
from shelfwise.oracle_sql.common import q, rnd
from shelfwise.schema import CV_FOLDS, TRAIN_FRACTION

CLEANED = r"""
, dedup AS (
    SELECT * FROM products
    QUALIFY ROW_NUMBER() OVER (PARTITION BY name, main_category, discount_price ORDER BY product_id) = 1
), cleaned AS (
    SELECT * FROM (
        SELECT *,
            TRY_CAST(regexp_replace(regexp_replace(discount_price, '[₹,]', '', 'g'), '\s+', '', 'g') AS DOUBLE) AS discount_price_clean,
            TRY_CAST(regexp_replace(regexp_replace(actual_price, '[₹,]', '', 'g'), '\s+', '', 'g') AS DOUBLE) AS actual_price_clean,
            CASE WHEN regexp_matches(ratings, '^[0-5][.][0-9]$') THEN TRY_CAST(ratings AS DOUBLE) END AS ratings_clean,
            TRY_CAST(REPLACE(no_of_ratings, ',', '') AS INTEGER) AS no_of_ratings_clean
        FROM dedup
    ) t
    WHERE discount_price_clean IS NOT NULL AND ratings_clean IS NOT NULL AND no_of_ratings_clean IS NOT NULL
      AND main_category IS NOT NULL AND discount_price_clean > 0 AND ratings_clean >= 1 AND ratings_clean <= 5
)"""


def _fixed_mean(col: str) -> str:
    return f"CAST(SUM(CAST(ROUND({col} * 100.0e0) AS BIGINT)) AS DOUBLE) / (CAST(COUNT({col}) AS DOUBLE) * 100.0e0)"


FEATS = CLEANED + f"""
, thr AS (
    SELECT quantile_disc(discount_price_clean, 0.33) AS p33, quantile_disc(discount_price_clean, 0.66) AS p66,
           quantile_disc(no_of_ratings_clean, 0.5) AS rmed, quantile_disc(no_of_ratings_clean, 0.8) AS r80
    FROM cleaned
), cat AS (
    SELECT main_category, {_fixed_mean("ratings_clean")} AS category_avg_rating,
           {_fixed_mean("discount_price_clean")} AS category_avg_price
    FROM cleaned GROUP BY main_category
), feats AS (
    SELECT c.product_id, c.name, c.main_category, c.sub_category, c.ratings, c.no_of_ratings, c.discount_price,
        c.actual_price, c.image, c.link, discount_price_clean, actual_price_clean, ratings_clean, no_of_ratings_clean,
        CASE WHEN actual_price_clean IS NOT NULL AND actual_price_clean > discount_price_clean
             THEN (actual_price_clean - discount_price_clean) / actual_price_clean * 100.0e0 ELSE 0.0e0 END AS discount_percentage,
        discount_price_clean / ratings_clean AS price_per_rating,
        CASE WHEN no_of_ratings_clean > 0 THEN LN(CAST(no_of_ratings_clean AS DOUBLE) + 1.0e0) * ratings_clean
             ELSE 0.0e0 END AS review_density_score,
        CASE WHEN discount_price_clean <= thr.p33 THEN 'Budget' WHEN discount_price_clean <= thr.p66 THEN 'Mid-Range'
             ELSE 'Premium' END AS price_segment,
        CASE WHEN ratings_clean >= 4.5 THEN 'Excellent' WHEN ratings_clean >= 4.0 THEN 'Good'
             WHEN ratings_clean >= 3.5 THEN 'Average' ELSE 'Poor' END AS rating_category,
        CASE WHEN no_of_ratings_clean >= thr.r80 THEN 'High' WHEN no_of_ratings_clean >= thr.rmed THEN 'Medium'
             ELSE 'Low' END AS review_volume,
        cat.category_avg_rating, cat.category_avg_price,
        ratings_clean - cat.category_avg_rating AS rating_vs_category_avg,
        (discount_price_clean - cat.category_avg_price) / cat.category_avg_price * 100.0e0 AS price_vs_category_avg,
        ratings_clean * 0.6e0 + (LN(CAST(no_of_ratings_clean AS DOUBLE) + 1.0e0) / 10.0e0) * 0.4e0 AS quality_score
    FROM cleaned c CROSS JOIN thr JOIN cat ON c.main_category = cat.main_category
), features AS (
    SELECT *, quality_score / (discount_price_clean / 1000.0e0) AS value_score FROM feats
)"""

_FEATURE_DOUBLES = (
    "discount_price_clean",
    "actual_price_clean",
    "ratings_clean",
    "discount_percentage",
    "price_per_rating",
    "review_density_score",
    "category_avg_rating",
    "category_avg_price",
    "rating_vs_category_avg",
    "price_vs_category_avg",
    "quality_score",
    "value_score",
)

P2 = q(CLEANED + "\nSELECT * FROM cleaned")

P3 = q(
    FEATS
    + f"""
SELECT product_id, name, main_category, sub_category, ratings, no_of_ratings, discount_price, actual_price, image, link,
    no_of_ratings_clean, price_segment, rating_category, review_volume,
    {", ".join(f"{rnd(c, 6)} AS {c}" for c in _FEATURE_DOUBLES)},
    CAST(ROW_NUMBER() OVER (PARTITION BY main_category ORDER BY no_of_ratings_clean DESC NULLS LAST, product_id) AS BIGINT) AS popularity_rank,
    CAST(ROW_NUMBER() OVER (PARTITION BY main_category ORDER BY ratings_clean DESC NULLS LAST, product_id) AS BIGINT) AS rating_rank
FROM features
"""
)

P7A = q(
    FEATS
    + f"""
SELECT main_category, COUNT(*) AS product_count, {rnd("AVG(ratings_clean)", 6)} AS avg_rating,
    {rnd("AVG(discount_price_clean)", 6)} AS avg_price, CAST(SUM(no_of_ratings_clean) AS BIGINT) AS total_reviews,
    {rnd("AVG(quality_score)", 6)} AS avg_quality_score, COUNT(DISTINCT sub_category) AS subcategory_diversity
FROM features GROUP BY main_category
"""
)

P7B = q(
    FEATS
    + f"""
SELECT main_category,
    CASE WHEN discount_price_clean < 500 THEN 'Under 500' WHEN discount_price_clean < 1000 THEN '500-1000'
         WHEN discount_price_clean < 2000 THEN '1000-2000' WHEN discount_price_clean < 5000 THEN '2000-5000'
         ELSE 'Above 5000' END AS price_bucket,
    COUNT(*) AS product_count, {rnd("AVG(ratings_clean)", 6)} AS avg_rating,
    {rnd("AVG(no_of_ratings_clean)", 6)} AS avg_reviews
FROM features GROUP BY 1, 2
"""
)

P7C = q(
    FEATS
    + f"""
, gaps AS (
    SELECT main_category, sub_category, COUNT(*) AS current_products, AVG(ratings_clean) AS avg_rating,
        CAST(SUM(no_of_ratings_clean) AS BIGINT) AS demand_signal,
        CAST(SUM(no_of_ratings_clean) AS DOUBLE) / COUNT(*) AS opportunity_score
    FROM features GROUP BY main_category, sub_category
)
SELECT main_category, sub_category, current_products, {rnd("avg_rating", 6)} AS avg_rating, demand_signal,
    {rnd("opportunity_score", 6)} AS opportunity_score
FROM gaps ORDER BY opportunity_score DESC, main_category, sub_category LIMIT 20
"""
)

P8A = q(
    FEATS
    + f"""
SELECT main_category, {rnd("AVG(quality_score)", 6)} AS avg_quality, COUNT(*) AS product_count
FROM features GROUP BY main_category HAVING COUNT(*) >= 50
ORDER BY avg_quality DESC, main_category LIMIT 5
"""
)

P8B = q(
    FEATS
    + f"""
SELECT product_id, name, main_category, {rnd("ratings_clean", 6)} AS ratings_clean, no_of_ratings_clean,
    {rnd("discount_price_clean", 6)} AS discount_price_clean
FROM features WHERE ratings_clean < 4.0 AND no_of_ratings_clean > 100
ORDER BY no_of_ratings_clean DESC, product_id LIMIT 10
"""
)

P8C = q(
    FEATS
    + f"""
SELECT product_id, name, main_category, {rnd("ratings_clean", 6)} AS ratings_clean,
    {rnd("discount_price_clean", 6)} AS discount_price_clean, {rnd("price_vs_category_avg", 6)} AS price_vs_category_avg
FROM features WHERE ratings_clean >= 4.5 AND price_vs_category_avg < -20
ORDER BY price_vs_category_avg, product_id LIMIT 10
"""
)

# --- checks of the models: split, folds, index and metrics -------------------

_TRAIN = in_train_sql(TRAIN_FRACTION)
_MARKED = FEATS + f"""
, limits AS (
    SELECT quantile_disc(no_of_ratings_clean, 0.7) AS many FROM cleaned
), marked AS (
    SELECT f.*, {_TRAIN} AS learns, CAST(ratings_clean >= 4.0 AND no_of_ratings_clean >= many AS INTEGER) AS is_successful
    FROM feats f, limits
)"""
P4_INDEX = q(_MARKED + """
SELECT main_category, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, main_category) - 1 AS INTEGER) AS category_index, COUNT(*) AS train_rows
FROM marked WHERE learns GROUP BY main_category
""")
P4_RMSE = q(_MARKED + f"""
, guesses AS (SELECT main_category, {_fixed_mean("ratings_clean")} AS guess FROM marked WHERE learns GROUP BY main_category)
SELECT COUNT(*) AS test_rows, {rnd("SQRT(AVG((ratings_clean - guess) * (ratings_clean - guess)))", 6)} AS rmse
FROM marked JOIN guesses USING (main_category) WHERE NOT learns
""")
P5_SPLIT = q(_MARKED + f"""
SELECT IF(learns, 'train', 'test') AS part, IF(learns, {fold_sql(CV_FOLDS)}, NULL) AS fold, is_successful, COUNT(*) AS n
FROM marked GROUP BY ALL
""")
_FACTORS = ("discount_percentage", "price_vs_category_avg", "quality_score", "no_of_ratings_clean")
_SCORED = " UNION ALL ".join(f"SELECT '{f}' AS factor, {rnd(f, 6)} AS score, is_successful AS y FROM marked WHERE NOT learns" for f in _FACTORS)
P5_AUC = q(_MARKED + f"""
, scored AS ({_SCORED}),
beaten AS (
    SELECT a.factor, COUNT(*) FILTER (b.score < a.score) + 0.5 * COUNT(*) FILTER (b.score = a.score) AS won, COUNT(*) AS met
    FROM scored a JOIN scored b ON a.factor = b.factor AND a.y = 1 AND b.y = 0 GROUP BY a.factor
)
SELECT factor, {rnd("CAST(won AS DOUBLE) / met", 6)} AS auc FROM beaten
""")
