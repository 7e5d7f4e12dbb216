"""Aggregation building blocks (all single-pass, map-side combinable)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.joins import one_row
from shelfwise.operators.quantiles import with_percentiles


def metrics_long(
    one_row_df: DataFrame,
    items: Sequence[tuple[str, Column]],
    name_col: str = "metric",
    value_col: str = "value",
) -> DataFrame:
    """Turn one row of aggregates into a long ``(name, value)`` list.

    Replaces N ``UNION ALL`` scans of the same table by one aggregate plus an
    ``inline`` of literal structs (JVM-side, no extra scan).
    """
    structs = [F.struct(F.lit(label).alias(name_col), value.alias(value_col)) for label, value in items]
    return one_row_df.select(F.inline(F.array(*structs)))


def with_share(df: DataFrame, count_col: str, out: str = "share") -> DataFrame:
    """Add ``count * 100 / SUM(count)`` (DOUBLE) over the whole frame.

    The total is a one-row aggregate broadcast to every row, so the frame
    stays partitioned (no ``SUM() OVER ()`` gathering it in one task).
    """
    total = one_row(df.agg(F.sum(count_col).alias("_share_total")))
    share = F.when(F.col("_share_total") != 0, F.col(count_col) * F.lit(100.0) / F.col("_share_total"))
    return df.crossJoin(total).withColumn(out, share).drop("_share_total")


def weighted_avg(x: Column, w: Column) -> Column:
    """``SUM(x*w) / SUM(w)``; NULL when the weights sum to 0 (exact for DECIMAL ``x``)."""
    return F.try_divide(F.sum(x * w), F.sum(w).cast("decimal(20,0)"))


def avg_cmp(col: Column, op: str, threshold: float) -> Column:
    """Compare ``AVG(col)`` with a constant exactly (``SUM(col) op threshold * COUNT(col)``).

    For DECIMAL inputs the test is exact, so a mean of exactly 4.0 is never
    taken for 3.999... by floating-point summation order.
    """
    s, n = F.sum(col), F.count(col)
    rhs = F.lit(threshold).cast("decimal(10,4)") * n
    return {
        ">": s > rhs,
        ">=": s >= rhs,
        "<": s < rhs,
        "<=": s <= rhs,
    }[op]


def bin_index(v: Column, lo: float, hi: float, bins: int) -> Column:
    """Fixed-width bin 1..bins over [lo, hi] (``hi`` in the last bin); 0 below, bins+1 above."""
    inner = F.floor(F.lit(float(bins)) * (v - F.lit(float(lo))) / F.lit(float(hi - lo))).cast("bigint") + F.lit(1)
    return (
        F.when(v < F.lit(float(lo)), F.lit(0).cast("bigint"))
        .when(v > F.lit(float(hi)), F.lit(bins + 1).cast("bigint"))
        .when(v == F.lit(float(hi)), F.lit(bins).cast("bigint"))
        .otherwise(inner)
    )


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Fixed-width histogram: ``bin`` (1..bins; 0 / bins+1 hold values outside), ``bin_start``,
    ``bin_end`` and ``count``, optionally per group ``keys``. One aggregation."""
    width = (hi - lo) / bins
    b = bin_index(F.col(col), lo, hi, bins)
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(*keys, b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            *keys,
            "bin",
            (F.lit(float(lo)) + (F.col("bin") - F.lit(1)).cast("double") * F.lit(width)).alias("bin_start"),
            (F.lit(float(lo)) + F.col("bin").cast("double") * F.lit(width)).alias("bin_end"),
            "count",
        )
    )


def box_stats(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Five-number summary and Tukey fences per group (exact quartiles by distributed selection)."""
    v = F.col(col).cast("double")
    agg = df.groupBy(*keys).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"))
    agg = with_percentiles(agg, df, keys, {"q1": (v, 0.25), "median": (v, 0.5), "q3": (v, 0.75)})
    spread = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    return agg.select(
        *keys, "count", "min", "q1", "median", "q3", "max", (F.col("q1") - spread).alias("lower_fence"), (F.col("q3") + spread).alias("upper_fence")
    )


def minmax_normalise(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """``(x - min) / (max - min)`` per column over the whole frame (NULL when max == min)."""
    stats = one_row(df.agg(*[F.min(c).alias(f"_min_{c}") for c in cols], *[F.max(c).alias(f"_max_{c}") for c in cols]))
    joined = df.crossJoin(stats)
    out_cols = []
    for c in cols:
        rng = F.col(f"_max_{c}") - F.col(f"_min_{c}")
        out_cols.append(F.when(rng != 0, (F.col(c) - F.col(f"_min_{c}")) / rng).alias(f"{c}{suffix}"))
    keep = [c for c in df.columns if c not in cols or suffix]
    return joined.select(*keep, *out_cols)


def top_k_sum(df: DataFrame, keys: Sequence[str], col: str, k: int, tie: str, out: str = "top_k_sum") -> DataFrame:
    """Sum of the ``k`` largest ``col`` values per group (NULLs last, ties by ``tie``).

    A lone ``row_number() <= k`` (partial WindowGroupLimit before the shuffle)
    followed by a grouped sum: at most ``k`` rows per group per map task move.
    """
    from shelfwise.operators.ranking import top_n_per_group

    top = top_n_per_group(df, keys, [F.col(col).desc(), F.col(tie).asc()], k, "_topk_rank")
    return top.groupBy(*keys).agg(F.sum(col).alias(out))


def top_k_concentration(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    k: int,
    tie: str,
    totals: DataFrame | None = None,
    total_col: str = "total",
) -> DataFrame:
    """Share (%) of each group's total held by its ``k`` largest values.

    ``totals`` (with ``keys`` and ``total_col``) may come from a different
    population and keeps all its columns; the top-k sums are left-joined onto
    it by equality (a NULL key never matches, leaving ``concentration`` NULL).
    By default the group's own sum is the total.
    """
    top = top_k_sum(df, keys, col, k, tie, "top_k_sum")
    if totals is None:
        totals = df.groupBy(*keys).agg(F.sum(col).alias(total_col))
    joined = totals.join(top, list(keys), "left")
    return joined.withColumn(
        "concentration",
        F.when(F.col(total_col) != 0, F.col("top_k_sum") * F.lit(100.0) / F.col(total_col)),
    )


def nps(promoters: Column, detractors: Column, total: Column) -> Column:
    """Net-promoter style score: promoter share minus detractor share, in percent (DOUBLE)."""
    return F.when(total != 0, promoters * F.lit(100.0) / total - detractors * F.lit(100.0) / total)
