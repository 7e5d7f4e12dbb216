"""Category statistics of a growing catalogue, from mergeable partials per batch.

``partials`` reduces a batch of products to one row per category: counts, exact decimal sums, extremes and a sketch of distinct
product names. ``append`` stores a batch's partials in a folder of its own (a retry of the batch overwrites it), ``load`` reads those of
all batches, ``merge`` adds them up. The exact columns equal a scan of all products, whatever the batches; ``names`` is the
estimate of the merged sketches (about 1 % off at the default size). Reading costs one row per category and batch, not the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import round_to
from shelfwise.plans.common import parsed

#: Log2 of the sketch size.
SKETCH_BITS = 12

_SUMS = ("products", "priced", "price_sum", "rated", "rating_sum", "reviewed", "review_sum")


def partials(products: DataFrame) -> DataFrame:
    """One row per category of a batch, with everything that ``merge`` needs."""
    rows = parsed(products)
    price, rating, reviews = (F.when(F.col(v), F.col(c)) for v, c in (("v_price", "price"), ("v_rating", "rating"), ("v_count", "review_count")))
    return rows.groupBy("main_category").agg(
        F.count(F.lit(1)).alias("products"),
        F.count(price).alias("priced"),
        F.sum(price).cast("decimal(38,2)").alias("price_sum"),
        F.count(rating).alias("rated"),
        F.sum(rating).cast("decimal(38,2)").alias("rating_sum"),
        F.count(reviews).alias("reviewed"),
        F.sum(reviews).cast("bigint").alias("review_sum"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.hll_sketch_agg(F.coalesce("name", F.lit("")), SKETCH_BITS).alias("names"),
    )


def append(products: DataFrame, folder: str, batch: str) -> None:
    """Store the partials of a batch; the same batch again replaces them."""
    partials(products).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")  # one row per category


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The partials of all batches."""
    return spark.read.parquet(folder).drop("batch")


def merge(parts: DataFrame) -> DataFrame:
    """Partials of any batches added up, again one row per category; merged partials can be merged further."""
    return parts.groupBy("main_category").agg(
        *[F.sum(c).cast(dict(parts.dtypes)[c]).alias(c) for c in _SUMS],
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.hll_union_agg("names").alias("names"),
    )


def category_statistics(parts: DataFrame) -> DataFrame:
    """The report over the merged partials; all columns but ``approx_names`` are exact."""
    m = merge(parts)
    mean = lambda s, n, scale: round_to(F.try_divide(F.col(s).cast("double"), F.col(n)), scale)
    return m.select(
        "main_category",
        "products",
        F.col("min_price").cast("double").alias("min_price"),
        F.col("max_price").cast("double").alias("max_price"),
        mean("price_sum", "priced", 2).alias("avg_price"),
        mean("rating_sum", "rated", 2).alias("avg_rating"),
        F.col("review_sum").alias("total_reviews"),
        F.hll_sketch_estimate("names").alias("approx_names"),
    )
