"""Numeric rounding and text formatting, identical across engines.

``round_to`` rounds half away from zero on the decimal value. A DOUBLE input is
first fixed to six decimals, so a value such as ``2.675`` (stored as
2.67499999...) rounds to ``2.68`` the way a decimal engine would.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_dec(col: str | Column, scale: int) -> Column:
    """Round half-up to ``scale`` digits; result is DECIMAL(38-?, scale)."""
    return F.round(_c(col).cast("decimal(38,6)"), scale)


def round_to(col: str | Column, scale: int) -> Column:
    """Round half-up to ``scale`` digits; DOUBLE result."""
    return round_dec(col, scale).cast("double")


def round_text(col: str | Column, scale: int) -> Column:
    """Rounded value as text with exactly ``scale`` decimals (``4.10``, ``45.0``)."""
    return round_dec(col, scale).cast(f"decimal(38,{scale})").cast("string")


def thousands(col: str | Column) -> Column:
    """Round half-up to an integer and print with thousands separators (``12,345``)."""
    return F.format_number(round_dec(col, 0).cast("decimal(38,0)"), 0)


def pct(numer: str | Column, denom: str | Column) -> Column:
    """``numer * 100 / denom`` as DOUBLE, NULL when the denominator is 0 or NULL."""
    d = _c(denom)
    return F.when(d != 0, _c(numer) * F.lit(100.0) / d)
