"""Column-level functions: parsing, validity profiles, labels, formatting."""

from shelfwise.functions.fmt import pct, round_dec, round_text, round_to, thousands
from shelfwise.functions.labels import bucketize, classify, first_match, ordinal, threshold_labels
from shelfwise.functions.parsing import (
    has_text,
    is_present,
    parse_count,
    parse_money,
    parse_money_double,
    parse_rating,
    price_status,
    rating_status,
    valid_all,
    valid_count,
    valid_price,
    valid_rating,
)

__all__ = [
    "bucketize",
    "classify",
    "first_match",
    "has_text",
    "is_present",
    "ordinal",
    "parse_count",
    "parse_money",
    "parse_money_double",
    "parse_rating",
    "pct",
    "price_status",
    "rating_status",
    "round_dec",
    "round_text",
    "round_to",
    "thousands",
    "threshold_labels",
    "valid_all",
    "valid_count",
    "valid_price",
    "valid_rating",
]
