"""Persist the feature table and cluster assignments as Parquet.

Partitioned by category (later category filters prune files). The rows are rebalanced by category first: a category's rows
meet in few tasks, and AQE splits a large category into tasks of ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so
there is about one file per category and target size, neither a file per task and category nor one task for a hot category.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLUSTER_COLUMNS = ("name", "main_category", "ratings_clean", "discount_price_clean", "quality_score", "prediction")


def save_results(features: DataFrame, output_path: str, clustered: DataFrame | None = None) -> dict[str, str]:
    """Write ``processed_data`` (and ``product_clusters`` when given) under ``output_path``."""
    out = {}
    processed = os.path.join(output_path, "processed_data")
    _write(features, processed)
    out["processed_data"] = processed
    if clustered is not None:
        path = os.path.join(output_path, "product_clusters")
        _write(clustered.select(*CLUSTER_COLUMNS), path)
        out["product_clusters"] = path
    return out


def _write(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", F.col("main_category")).write.mode("overwrite").partitionBy("main_category").parquet(path)
