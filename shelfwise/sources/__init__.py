"""Sources: raw catalogue readers and the fixture-derived catalogue."""

from shelfwise.sources.catalogue import (
    read_catalogue_csv,
    read_catalogue_csv_by_name,
    read_catalogue_parquet,
    register_catalogue,
    with_product_id,
)
from shelfwise.sources.fixture import PRODUCTS_CTES, derive_products, load_products, read_table, with_products

__all__ = [
    "PRODUCTS_CTES",
    "derive_products",
    "load_products",
    "read_catalogue_csv",
    "read_catalogue_csv_by_name",
    "read_catalogue_parquet",
    "read_table",
    "register_catalogue",
    "with_product_id",
    "with_products",
]
