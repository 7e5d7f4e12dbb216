"""Oracle SQL (DuckDB) for E1-E10: one conditional aggregate per list, value lists per category, pattern tables."""

from shelfwise import fixed
from shelfwise.oracle_sql.common import PRICE, V_ALL, V_PRICE, V_RATING, mean, pct, q, rnd, rtext, rule

_HAS_RATING = "COALESCE(ratings, '') <> ''"
_HAS_PRICE = "COALESCE(discount_price, '') <> ''"

_E1_COUNTS = (
    "COUNT(*)",
    "COUNT(DISTINCT main_category)",
    "COUNT(DISTINCT sub_category)",
    f"COUNT(*) FILTER ({_HAS_RATING})",
    f"COUNT(*) FILTER ({_HAS_PRICE})",
)
E1 = q(f"""
SELECT metric, value FROM (
    UNPIVOT (SELECT {", ".join(f'{c} AS "{name}"' for name, c in zip(fixed.OVERVIEW_METRICS, _E1_COUNTS))} FROM products)
    ON COLUMNS(*) INTO NAME metric VALUE value
)
""")


def _status(alias: str, col: str, pattern: str, valid: str) -> str:
    """Status by the first pattern that the text (NULL: empty) matches."""
    patterns = ((0, pattern, valid), (1, "^$", fixed.STATUS_MISSING), (2, "", fixed.STATUS_INVALID))
    rows = ", ".join(f"({i}, '{p}', '{label}')" for i, p, label in patterns)
    return f"""LATERAL (SELECT arg_min(label, ord) AS status FROM (VALUES {rows}) AS p(ord, pattern, label)
    WHERE regexp_matches(COALESCE({col}, ''), pattern)) AS {alias}"""


E2 = q(f"""
SELECT product_id, name, main_category, sub_category, ratings, no_of_ratings, discount_price, actual_price,
       r.status AS ratings_status, p.status AS price_status
FROM products, {_status("r", "ratings", "^[0-9]+[.]?[0-9]*$", fixed.STATUS_VALID_NUMERIC)},
     {_status("p", "discount_price", "^₹?[0-9,]+[.]?[0-9]*$", fixed.STATUS_VALID_PRICE)}
""")

_E3_COLUMNS = {"name": "name IS NOT NULL", "main_category": "main_category IS NOT NULL", "ratings": _HAS_RATING, "discount_price": _HAS_PRICE}
_E3_CELLS = ", ".join(f"{{'column_name': '{c}', 'non_null_count': COUNT(*) FILTER ({there})}}" for c, there in _E3_COLUMNS.items())
E3 = q(f"""
, filled AS (SELECT COUNT(*) AS total_records, unnest([{_E3_CELLS}], recursive := true) FROM products)
SELECT column_name, total_records, non_null_count, total_records - non_null_count AS null_count,
       {rnd(pct("total_records - non_null_count", "total_records"), 2)} AS null_percentage
FROM filled
""")

E4 = q(f"""
, copies AS (SELECT COUNT(*) AS size FROM products GROUP BY name, main_category, sub_category, discount_price),
by_size AS (SELECT size, COUNT(*) AS times FROM copies GROUP BY size)
SELECT unnest(['{fixed.DUPLICATE_METRICS[0]}', '{fixed.DUPLICATE_METRICS[1]}']) AS metric,
       unnest([CAST(COALESCE(SUM(times) FILTER (size > 1), 0) AS BIGINT), CAST(SUM(size * times) FILTER (size > 1) AS BIGINT)]) AS value
FROM by_size
""")

E5 = q(f"""
, per_sub AS (SELECT main_category, sub_category, COUNT(*) AS n FROM products GROUP BY main_category, sub_category),
everything AS (SELECT SUM(n) AS total FROM per_sub)
SELECT main_category, CAST(SUM(n) AS BIGINT) AS product_count, {rnd(pct("SUM(n)", "ANY_VALUE(total)"), 2)} AS percentage,
       COUNT(sub_category) AS subcategory_count
FROM per_sub, everything WHERE main_category IS NOT NULL GROUP BY main_category
""")

E6 = q(f"""
, bags AS (SELECT main_category, COUNT(*) AS n, list(CAST({PRICE} AS DOUBLE)) AS v FROM products WHERE {V_PRICE} GROUP BY main_category)
SELECT main_category, n AS product_count, list_min(v) AS min_price, list_max(v) AS max_price, {rnd("list_avg(v)", 2)} AS avg_price,
       {rnd("list_median(v)", 2)} AS median_price, {rnd("list_stddev_samp(v)", 2)} AS price_stddev
FROM bags WHERE n >= 10
""")

E7 = q(f"""
, bags AS (
    SELECT main_category, COUNT(*) AS n, list(CAST(rating AS DOUBLE)) AS v, list(CAST(review_count AS BIGINT)) AS c
    FROM parsed WHERE {V_RATING} AND COALESCE(no_of_ratings, '') <> '' GROUP BY main_category
)
SELECT main_category, n AS rated_products, list_min(v) AS min_rating, list_max(v) AS max_rating, {rnd("list_avg(v)", 2)} AS avg_rating,
       {rnd("list_median(v)", 2)} AS median_rating, CAST(list_sum(c) AS BIGINT) AS total_reviews,
       {rnd("list_avg(c)", 0)} AS avg_reviews_per_product
FROM bags WHERE n >= 10
""")

_E8_CHECKS = ", ".join([*[f"trim(COALESCE({c}, '')) <> ''" for c in ("name", "main_category", "image", "link")], "v_rating", "v_price", "v_count"])
E8 = q(f"""
, scored AS (SELECT len(list_filter([{_E8_CHECKS}], lambda ok: ok)) AS quality_score FROM parsed),
tally AS (SELECT quality_score, COUNT(*) AS product_count FROM scored GROUP BY quality_score)
SELECT quality_score, product_count, {rnd(pct("product_count", "(SELECT SUM(product_count) FROM tally)"), 2)} AS percentage FROM tally
""")

_E9_BUCKETS = ((500, "Under ₹500"), (1000, "₹500-₹1000"), (2000, "₹1000-₹2000"), (5000, "₹2000-₹5000"), (None, "Above ₹5000"))
_E9_BUCKET = rule("bucket", ("price < {}",), _E9_BUCKETS)
E9 = q(f"""
SELECT main_category, label AS price_bucket, COUNT(*) AS product_count, {mean("rating", 2)} AS avg_rating,
       {mean("review_count", 0)} AS avg_reviews
FROM parsed, {_E9_BUCKET}
WHERE {V_ALL} GROUP BY main_category, label HAVING COUNT(*) >= 5
""")

_E10_TEXTS = [
    "CAST(COUNT(*) AS VARCHAR)",
    "CAST(COUNT(DISTINCT main_category) AS VARCHAR)",
    *[f"{rtext(f'AVG(IF({ok}, 100.0e0, 0.0e0))', 1)} || '%'" for ok in ("v_rating", "v_price", "v_rating AND v_price")],
]
_E10_METRICS = ", ".join(f"'{p}' || {t} AS metric_{i}" for i, (p, t) in enumerate(zip(fixed.QUALITY_CARD_PREFIXES, _E10_TEXTS), 1))
E10 = q(f"SELECT '{fixed.QUALITY_CARD_SECTION}' AS report_section, {_E10_METRICS} FROM parsed")

E5_INCREMENTAL = q(f"""
SELECT main_category, COUNT(*) AS products, CAST(MIN(price) FILTER (v_price) AS DOUBLE) AS min_price, CAST(MAX(price) FILTER (v_price) AS DOUBLE) AS max_price,
    {rnd("CAST(SUM(price) FILTER (v_price) AS DOUBLE) / COUNT(price) FILTER (v_price)", 2)} AS avg_price,
    {rnd("CAST(SUM(rating) FILTER (v_rating) AS DOUBLE) / COUNT(rating) FILTER (v_rating)", 2)} AS avg_rating,
    CAST(SUM(review_count) FILTER (v_count) AS BIGINT) AS total_reviews
FROM parsed GROUP BY main_category
""")
