"""Ranking operators that never gather a whole group into one task.

``Window.partitionBy(k).orderBy(o)`` sends every row of a key to one task; a
category holding a third of the catalogue then sorts in a single task. The
operators here give the same numbers with work that spreads evenly:

* :func:`group_row_number` / :func:`group_ntile` - exact ROW_NUMBER / NTILE per
  group (or globally, ``keys=[]``). Rows are range-partitioned on
  ``(keys, order)`` (a hot key spans many partitions), numbered locally with
  ``monotonically_increasing_id`` after a sort within the partition, then
  shifted by the row counts of the same group in earlier partitions. The
  per-(partition, group) count table has at most ``partitions + groups`` rows.
  The numbered rows are materialised once (checkpoint or persist) so the
  count table and the rows agree on partition ids.
* :func:`moving_frame` - aggregates over ROWS BETWEEN a few PRECEDING AND
  FOLLOWING after the same range partitioning: every chunk of a group gets the
  few rows before and after it from its neighbours and computes its frames.
* :func:`ntile_by_cuts` - global NTILEs of several measures without any sort of
  the rows: the rows at the bucket starts are selected by counting
  (:mod:`shelfwise.operators.quantiles`), every row compares with them.
* :func:`top_n_per_group` - ROW_NUMBER <= n as a lone window + filter, which
  Catalyst turns into a partial ``WindowGroupLimit`` before the shuffle: at
  most ``n`` rows per group leave each map task.
* :func:`global_ranks` - RANK over a whole frame under several orders at once:
  the first row number of each tie group, from one distributed numbering of
  all orders together.
* :func:`positions_in_group` - ROW_NUMBER position and group size for a few
  selected rows (e.g. the top-n) without sorting the population: each
  population row meets only the selected rows of its own group (bounded
  fan-out) and is counted with partial aggregation.

The order must be total (end with a unique column such as ``product_id``) so
the numbers are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from shelfwise.operators.joins import sized
from shelfwise.operators.quantiles import order_statistics, value_counts
from shelfwise.session import materialize

_MASK33 = (1 << 33) - 1


def _null_safe_on(left: str, right: str, keys: Sequence[str], right_names: Sequence[str]) -> Column:
    conds = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{rk}")) for k, rk in zip(keys, right_names)]
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], num_partitions: int | None):
    spec = [F.col(k).asc() for k in keys] + list(order)
    # Without an explicit count AQE may coalesce adjacent (still contiguous)
    # ranges of small inputs; the result is materialised once, so both readers
    # (count table and numbering) see the same partitions.
    if num_partitions:
        ranged = df.repartitionByRange(int(num_partitions), *spec)
    else:
        ranged = df.repartitionByRange(*spec)
    ranged = ranged.sortWithinPartitions(*spec)
    mid = F.monotonically_increasing_id()
    ranged = ranged.withColumn("_sw_mid", mid).select(
        "*",
        F.shiftright("_sw_mid", 33).alias("_sw_part"),
        F.col("_sw_mid").bitwiseAND(F.lit(_MASK33)).alias("_sw_idx"),
    ).drop("_sw_mid")
    return ranged


def _chunked(df, keys, order, num_partitions):
    """The rows in range partitions, and the table of chunks (a group's rows in one partition) with the rows before them."""
    # The numbered rows are materialised once: the count table and the rows it
    # is joined back to must see the same range bounds and the same local order.
    # (Column pruning would otherwise plan two different range exchanges whose
    # sampled bounds need not agree.) A reliable checkpoint in the shared
    # checkpoint folder when one is configured, else persisted: a lost block is
    # then recomputed through the same fixed partitioner.
    ranged = materialize(_ranged(df, keys, order, num_partitions))
    knames = [f"_sw_k{i}" for i in range(len(keys))]
    counts = ranged.groupBy("_sw_part", *[F.col(k).alias(kn) for k, kn in zip(keys, knames)]).agg(
        F.min("_sw_idx").alias("_sw_first"), F.count(F.lit(1)).alias("_sw_cnt")
    )
    # Tiny table (<= partitions + groups rows): prefix sums over partitions.
    by_key = Window.partitionBy(*knames)
    counts = counts.select(
        "_sw_part",
        *knames,
        "_sw_first",
        F.coalesce(
            F.sum("_sw_cnt").over(by_key.orderBy("_sw_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_sw_before"),
        "_sw_cnt",
        F.sum("_sw_cnt").over(by_key).alias("_sw_size"),
    )
    return ranged, sized(counts), knames


def _numbered(df, keys, order, num_partitions):
    ranged, counts, knames = _chunked(df, keys, order, num_partitions)
    on = (F.col("r._sw_part") == F.col("c._sw_part")) & _null_safe_on("r", "c", keys, knames)
    joined = ranged.alias("r").join(counts.alias("c"), on, "inner")
    rn = F.col("r._sw_idx") - F.col("c._sw_first") + F.col("c._sw_before") + F.lit(1)
    return joined.select("r.*", rn.alias("_sw_rn"), F.col("c._sw_size").alias("_sw_size")).drop(
        "_sw_part", "_sw_idx"
    )


def group_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "row_number",
    num_partitions: int | None = None,
    size_col: str | None = None,
) -> DataFrame:
    """Exact ``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)`` at scale.

    NULL keys form one group, as in a window. ``size_col`` optionally keeps the
    group size (``COUNT(*) OVER (PARTITION BY keys)``). Frames of any size are
    range-partitioned.
    """
    out_df = _numbered(df, keys, order, num_partitions).withColumnRenamed("_sw_rn", out)
    out_df = out_df.withColumn(out, F.col(out).cast("bigint"))
    if size_col:
        return out_df.withColumnRenamed("_sw_size", size_col)
    return out_df.drop("_sw_size")


def ntile_of(rn: Column, size: Column, n: int) -> Column:
    """NTILE(n) bucket of 1-based row ``rn`` in a group of ``size`` rows.

    The first ``size % n`` buckets hold one row more than the others.
    """
    q = F.floor(size / F.lit(n)).cast("bigint")
    r = size % F.lit(n)
    big = r * (q + F.lit(1))
    return (
        F.when(rn <= big, F.floor((rn - F.lit(1)) / (q + F.lit(1))) + F.lit(1))
        .otherwise(r + F.floor((rn - F.lit(1) - big) / q) + F.lit(1))
        .cast("bigint")
    )


def group_ntile(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    out: str = "ntile",
    num_partitions: int | None = None,
) -> DataFrame:
    """Exact ``NTILE(n) OVER (PARTITION BY keys ORDER BY order)``; ``keys=[]`` is global."""
    numbered = _numbered(df, keys, order, num_partitions)
    return numbered.withColumn(out, ntile_of(F.col("_sw_rn"), F.col("_sw_size"), n)).drop("_sw_rn", "_sw_size")


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank"
) -> DataFrame:
    """Rows with ``ROW_NUMBER() <= n`` per group, keeping the number in ``out``.

    Planned as WindowGroupLimit (partial limit before the shuffle).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n).withColumn(
        out, F.col(out).cast("bigint")
    )


def _precedes(p: str, s: str, spec: Sequence[tuple[str, str]]) -> Column:
    """Population row ``p`` sorts strictly before selected row ``s`` under ``spec``.

    ``spec`` items are ``(column, direction)`` with direction ``asc`` (NULLs
    first) or ``desc`` (NULLs last), Spark's defaults.
    """
    before = F.lit(False)
    equal_so_far = F.lit(True)
    for col, direction in spec:
        pc, sc = F.col(f"{p}.{col}"), F.col(f"{s}.{col}")
        if direction == "asc":
            lt = (pc.isNull() & sc.isNotNull()) | (pc < sc)
        elif direction == "desc":
            lt = (pc.isNotNull() & sc.isNull()) | (pc > sc)
        else:
            raise ValueError(direction)
        before = before | (equal_so_far & F.coalesce(lt, F.lit(False)))
        equal_so_far = equal_so_far & pc.eqNullSafe(sc)
    return before


def positions_in_group(
    selected: DataFrame,
    population: DataFrame,
    keys: Sequence[str],
    orders: dict[str, Sequence[tuple[str, str]]],
    id_col: str,
    size_col: str = "group_size",
) -> DataFrame:
    """For each selected row, its ROW_NUMBER under each named order and its group size.

    ``selected`` must be a subset of ``population`` (same ``id_col`` values)
    and small (e.g. top-n per group). Each population row is paired only with
    the selected rows of its own group, then counted with partial
    aggregation, so no group is sorted or gathered in one task.
    """
    cols = sorted({c for spec in orders.values() for c, _ in spec} | {id_col})
    # Persisted once: the planner (by bytes), the pairing join and the final join all
    # read the same selected rows.
    selected = sized(selected)
    sel = selected.select(*keys, *[c for c in cols if c not in keys])
    pop = population.select(*keys, *[c for c in cols if c not in keys])
    on = _null_safe_on("p", "s", keys, keys)
    pairs = pop.alias("p").join(sel.alias("s"), on, "inner")
    aggs = [F.count(F.lit(1)).alias(size_col)]
    for name, spec in orders.items():
        aggs.append((F.count_if(_precedes("p", "s", spec)) + F.lit(1)).alias(name))
    pos = pairs.groupBy(F.col(f"s.{id_col}").alias(id_col)).agg(*aggs)
    return selected.join(pos, id_col, "inner")


def global_ranks(df: DataFrame, id_col: str, orders: Mapping[str, str], descending: bool = True) -> DataFrame:
    """Exact ``RANK() OVER (ORDER BY column)`` for every ``out name -> column``, in one distributed numbering.

    Each row (``id_col`` is unique, NULL may be one of its values) gives one entry per order; all entries are range-partitioned on
    (order, value) together and numbered, and the rank of a value is the first number of its tie group. NULLs sort last when
    descending, first when ascending, as Spark orders them.
    """
    types = dict(df.dtypes)
    floating = {c: types[c] in ("float", "double") for c in orders.values()}
    # One sortable type for all columns: exact numbers as decimals, floating ones as they are.
    entry = lambda out, c: F.struct(
        F.lit(out).alias("_gr_order"),
        F.struct(
            (F.lit(None) if floating[c] else F.col(c)).cast("decimal(38,10)").alias("exact"),
            (F.col(c) if floating[c] else F.lit(None)).cast("double").alias("floating"),
        ).alias("_gr_value"),
    )
    long = df.select(F.col(id_col).alias("_gr_id"), F.inline(F.array(*[entry(o, c) for o, c in orders.items()])))
    by_value = F.col("_gr_value").desc() if descending else F.col("_gr_value").asc()
    numbered = group_row_number(long, ["_gr_order"], [by_value, F.col("_gr_id").asc()], "_gr_rn")
    firsts = numbered.groupBy(F.col("_gr_order").alias("_gr_o"), F.col("_gr_value").alias("_gr_v")).agg(F.min("_gr_rn").alias("_gr_rank"))
    ranked = numbered.join(firsts, (F.col("_gr_order") == F.col("_gr_o")) & F.col("_gr_value").eqNullSafe(F.col("_gr_v")), "inner")
    ranked = ranked.groupBy("_gr_id").agg(*[F.max(F.when(F.col("_gr_order") == out, F.col("_gr_rank"))).alias(out) for out in orders])
    return df.join(ranked, F.col(id_col).eqNullSafe(F.col("_gr_id")), "inner").drop("_gr_id")


def moving_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    before: int,
    after: int,
    aggs: Mapping[str, Column],
    num_partitions: int | None = None,
) -> DataFrame:
    """Exact aggregates over ``ROWS BETWEEN before PRECEDING AND after FOLLOWING`` of groups of any size.

    One range partitioning on ``(keys, order)``; every chunk (a group's rows in one partition) then takes the ``before`` rows
    before it and the ``after`` rows after it from its neighbours, at most ``before + after`` rows a chunk, and a window over the
    chunk computes its frames. No row is copied to its neighbours' places and no rows are joined with rows.
    """
    ranged, counts, knames = _chunked(df, keys, order, num_partitions)
    on = (F.col("r._sw_part") == F.col("c._sw_part")) & _null_safe_on("r", "c", keys, knames)
    joined = ranged.alias("r").join(counts.alias("c"), on, "inner")
    rn = F.col("r._sw_idx") - F.col("c._sw_first") + F.col("c._sw_before")
    rows = joined.select("r.*", rn.alias("_mf_rn"), F.col("c._sw_before").alias("_mf_from"), F.col("c._sw_cnt").alias("_mf_cnt")).drop("_sw_idx")
    place = F.col("_mf_rn") - F.col("_mf_from")
    # A row next to a chunk's end is among the last rows of the chunk before, or, if that is shorter, of one before that.
    edge = rows.where((place < after) | (F.col("_mf_cnt") - place <= before)).drop("_sw_part", "_mf_from", "_mf_cnt")
    wanted = F.flatten(
        F.array(
            F.sequence(F.col("_sw_before") - before, F.col("_sw_before") - 1) if before else F.array().cast("array<bigint>"),
            F.sequence(F.col("_sw_before") + F.col("_sw_cnt"), F.col("_sw_before") + F.col("_sw_cnt") + after - 1) if after else F.array().cast("array<bigint>"),
        )
    )
    chunks = counts.select(F.col("_sw_part").alias("_sw_part"), *knames, F.explode(wanted).alias("_mf_want"))
    halo = edge.alias("e").join(chunks.alias("h"), (F.col("e._mf_rn") == F.col("h._mf_want")) & _null_safe_on("e", "h", keys, knames), "inner")
    halo = halo.select("e.*", F.col("h._sw_part").alias("_sw_part")).withColumn("_mf_halo", F.lit(True))
    both = rows.drop("_mf_from", "_mf_cnt").withColumn("_mf_halo", F.lit(False)).unionByName(halo)
    frame = Window.partitionBy("_sw_part", *keys).orderBy("_mf_rn").rowsBetween(-before, after)
    return both.select("*", *[a.over(frame).alias(out) for out, a in aggs.items()]).where(~F.col("_mf_halo")).drop("_sw_part", "_mf_rn", "_mf_halo")


def ntile_by_cuts(df: DataFrame, id_col: str, measures: Mapping[str, str], n: int) -> DataFrame:
    """Exact global ``NTILE(n) OVER (ORDER BY column, id)`` for every ``out name -> column``, without sorting the rows.

    A bucket begins at a rank that follows from the number of rows. The value at that rank is found by counting values
    (:func:`order_statistics`); where the value is shared, the id that begins the bucket is found the same way among the ids
    that share it. Each row then compares itself with the ``n - 1`` starts of each measure, a table of that size. Ids are
    unique; rows with a NULL measure are not ranked and get NULL.
    """
    counted = value_counts(df, [], {out: F.col(c) for out, c in measures.items()}).persist(StorageLevel.MEMORY_AND_DISK)

    def starts(total: Column) -> Column:
        q, r = F.floor(total / F.lit(n)).cast("bigint"), total % F.lit(n)
        ranks = F.array(*[(q * F.lit(b) + F.least(F.lit(b), r)).cast("bigint") for b in range(1, n)])
        return F.filter(ranks, lambda x: x < total)

    # The starts are measures x (n - 1) values, whatever the number of rows: literals of the following plans.
    cuts = order_statistics(counted, ["_q_measure"], starts).collect()
    counted.unpersist()
    split = [(i, r) for i, r in enumerate(cuts) if r["rank"] > r["below"]]
    first_id: dict[int, object] = {}
    if split:
        hits = [F.when(F.col(measures[r["_q_measure"]]) == F.lit(r["value"]), F.lit(i)) for i, r in split]
        ties = df.select(F.col(id_col).alias("_nt_id"), F.explode(F.array_compact(F.array(*hits))).alias("cut"), F.lit(1).cast("bigint").alias("_nt_one"))
        offset = reduce(lambda a, x: a.when(F.col("cut") == x[0], F.lit(x[1]["rank"] - x[1]["below"])), split, F.when(F.lit(False), F.lit(0)))
        found = order_statistics(ties, ["cut"], lambda total: F.array(offset.cast("bigint")), value="_nt_id", weight="_nt_one")
        first_id = {r["cut"]: r["value"] for r in found.collect()}
    out_cols = {}
    for out, c in measures.items():
        v, bucket = F.col(c), F.lit(1)
        for i, r in enumerate(cuts):
            if r["_q_measure"] == out:
                tie = (v == F.lit(r["value"])) & (F.col(id_col) >= F.lit(first_id[i])) if i in first_id else v == F.lit(r["value"])
                bucket = bucket + ((v > F.lit(r["value"])) | tie).cast("int")
        out_cols[out] = F.when(v.isNotNull(), bucket.cast("bigint"))
    return df.withColumns(out_cols)
