"""Exact order statistics of groups of any size, without a sort and without a group in one task.

``F.percentile`` keeps every distinct value of a group in the memory of one task. Here a rank is found by narrowing:

1. The values are counted once per (group, value) with partial aggregation (:func:`value_counts`), so a value that half of
   all rows share is one row.
2. Every wanted rank starts with its group's whole value range. While some range holds more than ``limit`` distinct values,
   it is split in ``bins`` of equal width, the values are counted per bin (a bounded histogram per rank: at most ``bins``
   rows), and the bin that holds the rank becomes the new range, from its least to its greatest value.
3. What is left, at most ``limit`` distinct values per rank, is put in order and the value at the rank is taken.

Only the largest number of distinct values in a range reaches the driver, once a round. A round divides the width of the
ranges by ``bins``; on small groups no round is needed. NULL values are ignored, NULL keys are a group; a group without
values has no row in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from shelfwise.session import materialize

#: Distinct values that are put in order in one task for one rank, and bins of a round.
LIMIT = 1 << 14
BINS = 1 << 11

_MEASURE = "_q_measure"


def value_counts(rows: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Counted distinct values: the keys, ``_q_measure`` (name), ``_q_value``, ``_q_n``; one row per group, measure and value."""
    pairs = F.array(*[F.struct(F.lit(name).alias(_MEASURE), v.alias("_q_value")) for name, v in values.items()])
    long = rows.select(*keys, F.inline(pairs)).where(F.col("_q_value").isNotNull())
    return long.groupBy(*keys, _MEASURE, "_q_value").agg(F.count(F.lit(1)).alias("_q_n"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_q_{k}"]) for k in keys], F.lit(True))


def order_statistics(
    counted: DataFrame,
    keys: Sequence[str],
    ranks: Callable[[Column], Column],
    value: str = "_q_value",
    weight: str = "_q_n",
    limit: int = LIMIT,
    bins: int = BINS,
) -> DataFrame:
    """The values at given ranks of every group: the keys, ``rank`` (from 0), ``value``, ``below``, ``same`` and ``total``.

    ``counted`` has one row per group and distinct value with its number of rows (the caller keeps it persisted, as it is read
    a few times). ``ranks`` maps a group's number of rows to an array of its wanted ranks. ``below``, ``same`` and ``total``
    count the group's rows with a smaller value, an equal value and any value.
    """
    v, n = F.col(value), F.col(weight)
    groups = counted.groupBy(*keys).agg(F.sum(n).alias("_q_total"), F.min(v).alias("_q_lo"), F.max(v).alias("_q_hi"), F.count(F.lit(1)).alias("_q_kinds"))
    wanted = groups.select(
        *[F.col(k).alias(f"_q_{k}") for k in keys],
        F.explode(F.array_distinct(ranks(F.col("_q_total")))).alias("_q_rank"),
        "_q_lo",
        "_q_hi",
        "_q_kinds",
        "_q_total",
        F.lit(0).cast("bigint").alias("_q_below"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    named = [f"_q_{k}" for k in keys]
    while True:
        # Few rows (groups x ranks): Spark broadcasts them where their bytes allow, else joins by the keys.
        inside = counted.join(wanted, _same(counted, wanted, keys) & v.between(F.col("_q_lo"), F.col("_q_hi")), "inner")
        most = wanted.agg(F.max("_q_kinds")).first()[0]
        if most is None or most <= limit:
            break
        width = F.col("_q_hi").cast("double") - F.col("_q_lo").cast("double")
        share = F.when(width > 0, (v.cast("double") - F.col("_q_lo").cast("double")) / width).otherwise(F.lit(0.0))
        bin_ = F.least(F.floor(share * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
        histogram = inside.groupBy(*named, "_q_rank", "_q_total", "_q_below", bin_.alias("_q_bin")).agg(
            F.sum(n).alias("_q_n"), F.min(v).alias("_q_lo"), F.max(v).alias("_q_hi"), F.count(F.lit(1)).alias("_q_kinds")
        )
        narrowed = _at_rank(histogram, named, "_q_lo").select(*named, "_q_rank", "_q_total", "_q_lo", "_q_hi", "_q_kinds", F.col("_q_before").alias("_q_below"))
        narrowed = materialize(narrowed)  # few rows; a written round ends the lineage of those before
        wanted.unpersist()
        wanted = narrowed
    last = inside.select(*named, "_q_rank", "_q_total", "_q_below", v.alias("_q_lo"), n.alias("_q_n"))
    return _at_rank(last, named, "_q_lo").select(
        *[F.col(f"_q_{k}").alias(k) for k in keys],
        F.col("_q_rank").alias("rank"),
        F.col("_q_lo").alias("value"),
        F.col("_q_before").alias("below"),
        F.col("_q_n").alias("same"),
        F.col("_q_total").alias("total"),
    )


def _at_rank(items: DataFrame, named: Sequence[str], order: str) -> DataFrame:
    """Of the counted items of each rank (at most ``limit`` or ``bins``) the one that holds it, with ``_q_before`` rows below."""
    earlier = Window.partitionBy(*named, "_q_rank").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_q_below") + F.coalesce(F.sum("_q_n").over(earlier), F.lit(0))
    rank = F.col("_q_rank")
    return items.withColumn("_q_before", before).where((F.col("_q_before") <= rank) & (rank < F.col("_q_before") + F.col("_q_n")))


def _position(total: Column, p: float) -> Column:
    return (total - F.lit(1)).cast("double") * F.lit(float(p))


def group_percentiles(
    rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]], discrete: bool = False, limit: int = LIMIT, bins: int = BINS
) -> DataFrame:
    """One row per group with the keys and an exact percentile for every ``out name -> (value, p)``.

    Continuous percentiles interpolate linearly (DOUBLE); discrete ones are the first value whose rank reaches ``p`` of the
    rows, in the value's own type. A group without any value of a measure has NULL there. ``keys=[]`` gives one row. The
    values of all measures must have one type when discrete.
    """
    measures: dict[str, Column] = {}
    of: dict[str, str] = {}
    for out, (value, _) in wanted.items():
        text = str(value)
        of[out] = text
        measures.setdefault(text, value if discrete else value.cast("double"))
    names = {text: f"m{i}" for i, text in enumerate(measures)}
    counted = value_counts(rows, keys, {names[t]: v for t, v in measures.items()}).persist(StorageLevel.MEMORY_AND_DISK)
    by_measure = {m: sorted({p for out, (_, p) in wanted.items() if names[of[out]] == m}) for m in names.values()}

    def place(p: float, total: Column) -> tuple[Column, Column]:
        if discrete:
            at = F.greatest(F.ceil(total.cast("double") * F.lit(float(p))).cast("bigint") - 1, F.lit(0))
            return at, at
        return F.floor(_position(total, p)).cast("bigint"), F.ceil(_position(total, p)).cast("bigint")

    def ranks(total: Column) -> Column:
        out = F.array().cast("array<bigint>")
        for m, ps in by_measure.items():
            mine = F.array(*[x for p in ps for x in place(p, total)])
            out = F.when(F.col(_MEASURE) == m, mine).otherwise(out)
        return out

    found = order_statistics(counted, [*keys, _MEASURE], ranks, limit=limit, bins=bins)
    columns = []
    for out, (_, p) in wanted.items():
        mine = F.col(_MEASURE) == names[of[out]]
        low, high = place(p, F.col("total"))
        below, above = (F.max(F.when(mine & (F.col("rank") == r), F.col("value"))) for r in (low, high))
        if discrete:
            columns.append(below.alias(out))
            continue
        at = F.max(F.when(mine, _position(F.col("total"), p)))
        low, high = F.floor(at), F.ceil(at)
        columns.append(F.when(below == above, below).otherwise((high - at) * below + (at - low) * above).alias(out))
    return found.groupBy(*keys).agg(*columns)


def percentiles(
    rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]], exact: bool = True, discrete: bool = False
) -> DataFrame:
    """:func:`group_percentiles`, or with ``exact=False`` the approximate percentiles of a bounded sketch in one pass."""
    if exact:
        return group_percentiles(rows, keys, wanted, discrete)
    return rows.groupBy(*keys).agg(*[F.percentile_approx(v if discrete else v.cast("double"), p).alias(out) for out, (v, p) in wanted.items()])


def with_percentiles(
    stats: DataFrame, rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]], exact: bool = True, discrete: bool = False
) -> DataFrame:
    """Per-group statistics with percentiles of the same groups' ``rows`` beside them (NULL keys are a group)."""
    found = percentiles(rows, keys, wanted, exact, discrete)
    found = found.select(*[F.col(k).alias(f"_p_{k}") for k in keys], *wanted)
    if not keys:
        return stats.crossJoin(F.broadcast(found))  # one row
    on = reduce(lambda a, b: a & b, [stats[k].eqNullSafe(found[f"_p_{k}"]) for k in keys])
    return stats.join(found, on, "left").drop(*[f"_p_{k}" for k in keys])
