"""Parsing and validity rules for the text-typed catalogue columns.

All functions return ``Column`` expressions (JVM-side, whole-stage codegen);
nothing here touches rows in Python. Dirty text never raises: every cast is a
``try_cast``, so ANSI mode turns unparsable text into NULL instead of failing
the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.fixed import STATUS_INVALID, STATUS_MISSING, STATUS_VALID_NUMERIC, STATUS_VALID_PRICE
from shelfwise.schema import COUNT_PATTERN, CURRENCY, PRICE_PATTERN, RATING_PATTERNS

MONEY_DECIMAL = "decimal(10,2)"
RATING_DECIMAL = "decimal(3,2)"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------------------
# validity tests (NULL-safe: a NULL input is never valid)
# --------------------------------------------------------------------------

def is_present(col: str | Column) -> Column:
    """Not NULL and not the empty string."""
    c = _c(col)
    return c.isNotNull() & (c != F.lit(""))


def has_text(col: str | Column) -> Column:
    """Not NULL and not blank after trimming."""
    c = _c(col)
    return c.isNotNull() & (F.length(F.trim(c)) > 0)


def valid_rating(col: str | Column = "ratings", profile: str = "sql") -> Column:
    """Rating text matches the pattern of ``profile`` (loose / sql / strict)."""
    c = _c(col)
    return c.isNotNull() & c.rlike(RATING_PATTERNS[profile])


def valid_price(col: str | Column = "discount_price") -> Column:
    c = _c(col)
    return c.isNotNull() & c.rlike(PRICE_PATTERN)


def valid_count(col: str | Column = "no_of_ratings") -> Column:
    c = _c(col)
    return c.isNotNull() & c.rlike(COUNT_PATTERN)


def valid_all(profile: str = "sql") -> Column:
    """Rating, review count and selling price are all valid."""
    return valid_price("discount_price") & valid_rating("ratings", profile) & valid_count("no_of_ratings")


# --------------------------------------------------------------------------
# parsers
# --------------------------------------------------------------------------

def parse_money(col: str | Column = "discount_price") -> Column:
    """SQL family: drop the currency sign, commas and blanks -> DECIMAL(10,2)."""
    stripped = F.translate(_c(col), f"{CURRENCY}, ", "")
    return stripped.try_cast(MONEY_DECIMAL)


def parse_money_double(col: str | Column = "discount_price") -> Column:
    """Pipeline / dashboard family: same cleaning, DOUBLE result."""
    stripped = F.regexp_replace(F.regexp_replace(_c(col), f"[{CURRENCY},]", ""), r"\s+", "")
    return stripped.try_cast("double")


def parse_count(col: str | Column = "no_of_ratings") -> Column:
    """Review count text with thousands separators -> INT."""
    return F.replace(_c(col), F.lit(","), F.lit("")).try_cast("int")


def parse_rating(col: str | Column = "ratings", profile: str = "sql") -> Column:
    """Parse a rating according to a profile.

    * ``sql``    - DECIMAL(3,2) cast of the text (``'45'`` overflows to NULL).
    * ``strict`` - DOUBLE, only for text of the form ``d.d`` with d in 0-5.
    * ``coerce`` - DOUBLE, any numeric text (pandas ``to_numeric`` coerce).
    """
    c = _c(col)
    if profile == "sql":
        return c.try_cast(RATING_DECIMAL)
    if profile == "strict":
        return F.when(c.rlike(RATING_PATTERNS["strict"]), c.try_cast("double"))
    if profile == "coerce":
        # try_cast alone also reads 'NaN', 'Infinity', '4.5f' and '12d'.
        return F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(c).try_cast("double"))
    raise ValueError(f"unknown rating profile {profile!r}")


def rating_status(col: str | Column = "ratings") -> Column:
    """Format check of the rating text: Valid Numeric / Missing / Invalid Format."""
    c = _c(col)
    return (
        F.when(c.rlike(RATING_PATTERNS["loose"]), STATUS_VALID_NUMERIC)
        .when(c.isNull() | (c == ""), STATUS_MISSING)
        .otherwise(STATUS_INVALID)
    )


def price_status(col: str | Column = "discount_price") -> Column:
    """Format check of the price text: Valid Price / Missing / Invalid Format."""
    c = _c(col)
    return (
        F.when(c.rlike(PRICE_PATTERN), STATUS_VALID_PRICE)
        .when(c.isNull() | (c == ""), STATUS_MISSING)
        .otherwise(STATUS_INVALID)
    )
