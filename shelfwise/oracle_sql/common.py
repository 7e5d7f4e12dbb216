"""SQL fragments for the DuckDB oracle (independent formulation of each analysis).

Portability rules (Spark 4.1 vs DuckDB): averages are taken over DOUBLE and
rounded half-up through DECIMAL(38,6); counts and sums are BIGINT; regex dots
are written ``[.]``; natural log is ``LN``; division by zero is guarded.
"""

from __future__ import annotations

from shelfwise.sources.fixture import with_products

PRICE = "TRY_CAST(REPLACE(REPLACE(REPLACE(discount_price, '₹', ''), ',', ''), ' ', '') AS DECIMAL(10,2))"
ORIGINAL_PRICE = "TRY_CAST(REPLACE(REPLACE(REPLACE(actual_price, '₹', ''), ',', ''), ' ', '') AS DECIMAL(10,2))"
RATING = "TRY_CAST(ratings AS DECIMAL(3,2))"
REVIEWS = "TRY_CAST(REPLACE(no_of_ratings, ',', '') AS INTEGER)"

V_RATING = "(ratings IS NOT NULL AND regexp_matches(ratings, '^[0-5][.]?[0-9]*$'))"
V_RATING_LOOSE = "regexp_matches(ratings, '^[0-9]+[.]?[0-9]*$')"
V_PRICE = "(discount_price IS NOT NULL AND regexp_matches(discount_price, '^₹?[0-9,]+[.]?[0-9]*$'))"
V_COUNT = "(no_of_ratings IS NOT NULL AND regexp_matches(no_of_ratings, '^[0-9,]+$'))"
V_ALL = f"{V_PRICE} AND {V_RATING} AND {V_COUNT}"

# Parsed view of the catalogue used by most oracle queries.
PARSED_CTE = f""", parsed AS (
    SELECT *, {PRICE} AS price, {ORIGINAL_PRICE} AS original_price, {RATING} AS rating, {REVIEWS} AS review_count,
           {V_PRICE} AS v_price, {V_RATING} AS v_rating, {V_COUNT} AS v_count
    FROM products
)"""


def rnd(expr: str, n: int) -> str:
    """Half-up rounding through DECIMAL(38,6), DOUBLE result."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,6)), {n}) AS DOUBLE)"


def rtext(expr: str, n: int) -> str:
    """Half-up rounding shown with exactly n decimals."""
    return f"CAST(CAST(ROUND(CAST({expr} AS DECIMAL(38,6)), {n}) AS DECIMAL(38,{n})) AS VARCHAR)"


def thousands(expr: str) -> str:
    """Integer with thousands separators after half-up rounding."""
    return f"format('{{:,}}', CAST(ROUND(CAST({expr} AS DECIMAL(38,6)), 0) AS BIGINT))"


def avgd(expr: str) -> str:
    return f"AVG(CAST({expr} AS DOUBLE))"


def pct(num: str, den: str) -> str:
    return f"({num}) * 100.0e0 / NULLIF({den}, 0)"


def mean(expr: str, n: int) -> str:
    """Mean of a decimal or whole number, from its exact sum, rounded half-up."""
    return rnd(f"CAST(SUM({expr}) AS DOUBLE) / COUNT({expr})", n)


def literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def rule(alias: str, tests: tuple[str, ...], entries, columns: str = "label") -> str:
    """LATERAL row with ``columns`` of the first entry of a rule table whose bounds all hold.

    ``tests`` are conditions with ``{}`` for a bound; an entry is its bounds (None: no bound) and its columns.
    """
    bounds = [f"b{i}" for i in range(len(tests))]
    names = ", ".join(["ord", *bounds, *columns.split()])
    values = ", ".join(f"({i}, {', '.join(literal(v) for v in entry)})" for i, entry in enumerate(entries))
    holds = " AND ".join(f"({b} IS NULL OR {t.format(b)})" for b, t in zip(bounds, tests))
    picked = ", ".join(f"arg_min({c}, ord) AS {c}" for c in columns.split())
    return f"LATERAL (SELECT {picked} FROM (VALUES {values}) AS r({names}) WHERE {holds}) AS {alias}"


def marked(bounds, table) -> list[tuple]:
    """Entries with the texts of a label table and the oracle's own ``bounds``."""
    return [(bound, entry[-1]) for bound, entry in zip(bounds, table, strict=True)]


def steps(alias: str, expr: str, bounds, table, default: str) -> str:
    """``rule`` over one value: the label of the greatest of ``bounds`` (descending) that the value reaches."""
    return rule(alias, (f"{expr} >= {{}}",), (*marked(bounds, table), (None, default)))


def rank_in(table: str, column: str) -> str:
    """Rank of a row of ``table`` by descending ``column`` (NULL last): one more than the rows ahead of it."""
    ahead = f"o.{column} > {table}.{column} OR ({table}.{column} IS NULL AND o.{column} IS NOT NULL)"
    return f"(SELECT COUNT(*) + 1 FROM {table} AS o WHERE {ahead})"


def quarter(pos: str, n: str) -> str:
    """Quarter of position ``pos`` among ``n`` rows; the first ``n % 4`` quarters hold one row more."""
    big = f"({n} % 4) * ({n} // 4 + 1)"
    return f"IF({pos} <= {big}, ({pos} - 1) // ({n} // 4 + 1) + 1, {n} % 4 + ({pos} - 1 - {big}) // GREATEST({n} // 4, 1) + 1)"


def board(where: str, keys: str = "main_category", least: int = 1) -> str:
    """CTE ``board``: the measures of all reports for each ``keys`` with at least ``least`` rows."""
    return f""", board AS (
    SELECT {keys}, COUNT(*) AS n, COUNT(rating) AS n_rating, COUNT(price) AS n_price,
        SUM(rating) AS rating_sum, SUM(price) AS price_sum, CAST(SUM(review_count) AS BIGINT) AS reviews,
        {mean("rating", 2)} AS mean_rating, {mean("price", 2)} AS mean_price, {mean("review_count", 0)} AS mean_reviews,
        MIN(price) AS low, MAX(price) AS high,
        COUNT(*) FILTER (rating >= 4.5) AS n_best, COUNT(*) FILTER (rating >= 4.0) AS n_good,
        COUNT(*) FILTER (rating < 3.5) AS n_poor, COUNT(*) FILTER (review_count >= 100) AS n_known,
        COUNT(*) FILTER (price >= 2000) AS n_dear, COUNT(*) FILTER (price < 500) AS n_cheap,
        SUM(price * review_count) AS turnover, COUNT(price * review_count) AS n_turnover,
        {rnd("CAST(SUM(rating * review_count) AS DOUBLE) / NULLIF(SUM(review_count), 0)", 2)} AS weighted_rating,
        {rnd("AVG(CAST(rating AS DOUBLE) / NULLIF(CAST(price AS DOUBLE) / 1000.0e0, 0))", 3)} AS value_ratio
    FROM parsed WHERE {where} GROUP BY {keys} HAVING COUNT(*) >= {least}
)"""


def q(tail: str) -> str:
    """Oracle query over the derived catalogue plus the parsed view."""
    return with_products(PARSED_CTE + "\n" + tail.strip())
