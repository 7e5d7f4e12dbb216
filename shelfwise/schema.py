"""Input schema and the fixed values the analyses depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw catalogue columns. Every input column is nullable text: numbers arrive
# with a currency sign, thousands separators, blanks or junk words.
RAW_COLUMNS = (
    "name",
    "main_category",
    "sub_category",
    "ratings",
    "no_of_ratings",
    "discount_price",
    "actual_price",
    "image",
    "link",
)

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Loader-added surrogate key used only to break ties deterministically.
PRODUCT_ID = "product_id"

# ---------------------------------------------------------------------------
# Fixed values (must equal the analysed workload's definitions for identical
# results). Kept together, in natural order.
# ---------------------------------------------------------------------------

# Validity patterns (anchored; Java regex, "find" semantics of RLIKE).
RATING_PATTERNS = {
    "loose": r"^[0-9]+\.?[0-9]*$",   # exploration format check
    "sql": r"^[0-5]\.?[0-9]*$",      # SQL analyses
    "strict": r"^[0-5]\.[0-9]$",     # feature pipeline
}
PRICE_PATTERN = "^₹?[0-9,]+\\.?[0-9]*$"
COUNT_PATTERN = r"^[0-9,]+$"

CURRENCY = "₹"  # Indian rupee sign

# Duplicate keys.
EXPLORATION_DUPLICATE_KEYS = ("name", "main_category", "sub_category", "discount_price")
PIPELINE_DUPLICATE_KEYS = ("name", "main_category", "discount_price")

# Price buckets, left-closed (exploration E9 and pipeline P7b).
PRICE_BUCKET_EDGES = (500, 1000, 2000, 5000)
PRICE_BUCKET_LABELS_SQL = (
    "Under ₹500",
    "₹500-₹1000",
    "₹1000-₹2000",
    "₹2000-₹5000",
    "Above ₹5000",
)
PRICE_BUCKET_LABELS_PIPELINE = ("Under 500", "500-1000", "1000-2000", "2000-5000", "Above 5000")

# Dashboard price segments, right-closed: (0,500], (500,1000], ... (5000, inf).
DASHBOARD_SEGMENT_EDGES = (0, 500, 1000, 2000, 5000)
DASHBOARD_SEGMENT_LABELS = ("Budget", "Economy", "Mid-Range", "Premium", "Luxury")

# Model settings of the pipeline.
RF_NUM_TREES = 100
RF_MAX_DEPTH = 10
LR_MAX_ITER = 100
LR_REG_PARAMS = (0.01, 0.1, 1.0)
LR_ELASTIC_NET_PARAMS = (0.0, 0.5, 1.0)
CV_FOLDS = 5
KMEANS_K = 5
SEED = 42
TRAIN_FRACTION = 0.8
