"""Join helpers: sides of known size and group statistics joined back to rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def sized(df: DataFrame) -> DataFrame:
    """``df`` with its size in bytes known to the planner.

    The frame is persisted (memory and disk, recomputable from lineage) and filled by one pass. Spark then plans with the
    bytes it holds: a join broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond, where AQE splits
    skewed keys. Only a count reaches the driver, and there is no bound in rows.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def one_row(df: DataFrame) -> DataFrame:
    """Mark a global (key-less) aggregate for broadcast: it has exactly one row."""
    return F.broadcast(df)


def null_safe_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    conds = [left[k].eqNullSafe(right[k]) for k in keys]
    return reduce(lambda a, b: a & b, conds)


def join_group_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    null_keys_match: bool = False,
) -> DataFrame:
    """Attach per-group statistics to every row (``groupBy`` + a join that Spark plans by the bytes of the statistics).

    Replaces ``agg().over(Window.partitionBy(keys))``, which would put each
    group in one task. ``null_keys_match=True`` reproduces window semantics
    (the NULL key is a group); otherwise NULL keys never match, as in SQL
    equality joins and correlated subqueries.
    """
    side = sized(stats)
    if not null_keys_match:
        return rows.join(side, list(keys), how)
    renamed = side.select(*[F.col(k).alias(f"_gs_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    conds = [F.col(k).eqNullSafe(F.col(f"_gs_{k}")) for k in keys]
    out = rows.join(renamed, reduce(lambda a, b: a & b, conds), how)
    return out.drop(*[f"_gs_{k}" for k in keys])
