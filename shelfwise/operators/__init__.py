"""Scale-safe relational operators shared by the analyses."""

from shelfwise.operators.aggregates import (
    avg_cmp,
    box_stats,
    histogram,
    metrics_long,
    minmax_normalise,
    nps,
    top_k_concentration,
    top_k_sum,
    weighted_avg,
    with_share,
)
from shelfwise.operators.joins import join_group_stats, one_row, sized
from shelfwise.operators.metrics import rank_auc
from shelfwise.operators.quantiles import group_percentiles, order_statistics, percentiles, value_counts, with_percentiles
from shelfwise.operators.ranking import (
    global_ranks,
    group_ntile,
    group_row_number,
    moving_frame,
    ntile_by_cuts,
    ntile_of,
    positions_in_group,
    top_n_per_group,
)
from shelfwise.operators.sampling import fold_of, hash_key, hash_sample, hash_split, in_train

__all__ = [
    "avg_cmp",
    "box_stats",
    "fold_of",
    "global_ranks",
    "group_ntile",
    "group_percentiles",
    "group_row_number",
    "hash_key",
    "hash_sample",
    "hash_split",
    "histogram",
    "in_train",
    "join_group_stats",
    "metrics_long",
    "minmax_normalise",
    "moving_frame",
    "nps",
    "ntile_by_cuts",
    "ntile_of",
    "one_row",
    "order_statistics",
    "percentiles",
    "positions_in_group",
    "rank_auc",
    "sized",
    "top_k_concentration",
    "top_k_sum",
    "top_n_per_group",
    "value_counts",
    "weighted_avg",
    "with_percentiles",
    "with_share",
]
