"""Scale-safe operators equal their single-task window equivalents."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators import (
    box_stats,
    fold_of,
    global_ranks,
    group_ntile,
    group_percentiles,
    group_row_number,
    hash_sample,
    hash_split,
    moving_frame,
    ntile_by_cuts,
    ntile_of,
    order_statistics,
    positions_in_group,
    top_n_per_group,
    value_counts,
)
from shelfwise.plans.common import parsed
from shelfwise.sources import load_products

from .conftest import SF_MEDIUM


@pytest.fixture(scope="module")
def rows(spark):
    p = parsed(load_products(spark, SF_MEDIUM))
    return p.select("product_id", "main_category", "rating", "review_count", "price").cache()


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_group_row_number_matches_window(rows, parts):
    order = [F.col("rating").desc(), F.col("review_count").desc(), F.col("product_id").asc()]
    a = group_row_number(rows, ["main_category"], order, "rn", num_partitions=parts)
    b = rows.select("product_id", F.row_number().over(Window.partitionBy("main_category").orderBy(*order)).alias("w"))
    j = a.join(b, "product_id")
    assert j.count() == rows.count()
    assert j.where(F.col("rn") != F.col("w")).count() == 0


@pytest.mark.parametrize("parts", [2, 7])
def test_global_ntile_matches_window(rows, parts):
    order = [F.col("price").asc(), F.col("product_id").asc()]
    a = group_ntile(rows, [], order, 4, "q", num_partitions=parts)
    b = rows.select("product_id", F.ntile(4).over(Window.orderBy(*order)).alias("w"))
    assert a.join(b, "product_id").where(F.col("q") != F.col("w")).count() == 0
    sizes = [r["count"] for r in a.groupBy("q").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_ntile_formula_small_groups(spark):
    # 5 rows in 4 buckets -> sizes 2,1,1,1; 3 rows -> 1,2,3
    df = spark.range(1, 6).select(F.col("id").alias("rn"))
    got = [r.b for r in df.select(ntile_of(F.col("rn"), F.lit(5), 4).alias("b")).orderBy("rn").collect()]
    assert got == [1, 1, 2, 3, 4]
    df3 = spark.range(1, 4).select(F.col("id").alias("rn"))
    got3 = [r.b for r in df3.select(ntile_of(F.col("rn"), F.lit(3), 4).alias("b")).orderBy("rn").collect()]
    assert got3 == [1, 2, 3]


def test_positions_in_group(rows):
    order = [F.col("rating").desc(), F.col("review_count").desc(), F.col("product_id").asc()]
    top = top_n_per_group(rows, ["main_category"], order, 5, "r")
    pos = positions_in_group(
        top, rows, ["main_category"], {"pop": [("review_count", "desc"), ("product_id", "asc")]}, "product_id"
    )
    w = Window.partitionBy("main_category")
    ref = rows.select(
        "product_id",
        F.row_number().over(w.orderBy(F.col("review_count").desc(), "product_id")).alias("pop2"),
        F.count(F.lit(1)).over(w).alias("n2"),
    )
    j = pos.join(ref, "product_id")
    assert j.count() == top.count()
    assert j.where((F.col("pop") != F.col("pop2")) | (F.col("group_size") != F.col("n2"))).count() == 0


def test_top_n_plans_window_group_limit(rows):
    order = [F.col("rating").desc(), F.col("product_id").asc()]
    plan = top_n_per_group(rows, ["main_category"], order, 5, "r")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hash_sample_is_stable(rows):
    a = [r.product_id for r in hash_sample(rows, 50).collect()]
    b = [r.product_id for r in hash_sample(rows.repartition(5), 50).collect()]
    assert sorted(a) == sorted(b) and len(a) == 50


@pytest.mark.parametrize("descending", [True, False])
def test_global_ranks_match_window_rank(rows, descending):
    many = rows.withColumn("odd", F.when(F.col("product_id") % 3 != 0, F.col("price").cast("double") / 7))
    orders = {"r": "rating", "v": "review_count", "p": "price", "o": "odd"}
    a = global_ranks(many, "product_id", orders, descending=descending)
    w = {o: F.rank().over(Window.orderBy(F.col(c).desc() if descending else F.col(c).asc())).alias(f"w_{o}") for o, c in orders.items()}
    j = a.join(many.select("product_id", *w.values()), "product_id")
    assert j.count() == rows.count()
    for o in orders:
        assert j.where(F.col(o) != F.col(f"w_{o}")).count() == 0


def test_global_ranks_keep_a_null_id(spark):
    df = spark.createDataFrame([("a", 1), (None, 3), ("b", 3), ("c", None)], "k string, n int")
    got = {r.k: r.rank for r in global_ranks(df, "k", {"rank": "n"}).collect()}
    assert got == {None: 1, "b": 1, "a": 3, "c": 4}


@pytest.mark.parametrize("parts, before, after", [(1, 2, 2), (5, 2, 2), (40, 2, 2), (64, 3, 0), (64, 0, 4)])
def test_moving_frame_matches_window(rows, parts, before, after):
    """Many partitions make chunks of one row, whose neighbours' neighbours are needed."""
    order = [F.col("rating").asc(), F.col("product_id").asc()]
    few = rows.where(F.col("product_id") % 9 == 0) if parts > 8 else rows
    a = moving_frame(few, ["main_category"], order, before, after, {"s": F.sum("price"), "n": F.count("price")}, num_partitions=parts)
    w = Window.partitionBy("main_category").orderBy(*order).rowsBetween(-before, after)
    b = few.select("product_id", F.sum("price").over(w).alias("ws"), F.count("price").over(w).alias("wn"))
    j = a.join(b, "product_id")
    assert j.count() == few.count() and a.columns == [*few.columns, "s", "n"]
    assert j.where(~F.col("s").eqNullSafe(F.col("ws")) | (F.col("n") != F.col("wn"))).count() == 0


@pytest.mark.parametrize("n, size", [(4, 1000), (4, 3), (7, 20), (4, 1), (4, 0)])
def test_ntile_by_cuts_matches_window(spark, n, size):
    """One value is shared by half of all rows; bucket starts fall inside its ties."""
    df = spark.range(size).select(
        ((F.col("id") * 7919) % 10007).alias("i"),
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 11).alias("a"),
        (F.col("id") % 13).cast("decimal(6,2)").alias("b"),
        F.sqrt(F.col("id")).alias("c"),
    )
    got = ntile_by_cuts(df, "i", {"qa": "a", "qb": "b", "qc": "c"}, n)
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    for q, c in (("qa", "a"), ("qb", "b"), ("qc", "c")):
        w = df.select(F.col("i").alias("j"), F.ntile(n).over(Window.orderBy(c, "i")).alias("w"))
        assert got.join(w, F.col("i") == F.col("j")).where(F.col(q) != F.col("w")).count() == 0
    assert got.count() == size


def test_ntile_by_cuts_narrows_large_ties(spark, monkeypatch):
    from functools import partial

    from shelfwise.operators import quantiles, ranking

    monkeypatch.setattr(ranking, "order_statistics", partial(quantiles.order_statistics, limit=20, bins=16))
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 2 == 0, 1.5).otherwise(F.col("id") / 10).alias("v"))
    got = ntile_by_cuts(df, "id", {"q": "v"}, 4)
    w = df.select(F.col("id").alias("j"), F.ntile(4).over(Window.orderBy("v", "id")).alias("w"))
    assert got.join(w, F.col("id") == F.col("j")).where(F.col("q") != F.col("w")).count() == 0


@pytest.fixture(scope="module")
def spread(spark):
    """One group with a third of all rows, one with a single row, one of NULL values, a NULL key; values over many magnitudes."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, (F.col("id") % 4).cast("string")).alias("k"),
        F.exp(F.pmod(F.xxhash64("id"), F.lit(1000)) / 60.0).alias("x"),
        F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)).cast("decimal(4,1)") / 10).alias("y"),
    )
    return df.unionByName(spark.createDataFrame([("one", -2.5, None), ("none", None, None)], "k string, x double, y decimal(10,6)")).cache()


@pytest.mark.parametrize("limit, bins", [(1 << 14, 1 << 11), (30, 8), (2, 5)])
def test_group_percentiles_match_percentile(spread, limit, bins):
    ps = (0.0, 0.25, 0.5, 0.7, 1.0)
    wanted = {f"{c}{i}": (F.col(c), p) for c in "xy" for i, p in enumerate(ps)}
    for keys in (["k"], []):
        got = group_percentiles(spread, keys, wanted, limit=limit, bins=bins)
        assert "percentile" not in got._jdf.queryExecution().toString()
        true = spread.groupBy(*keys).agg(*[F.percentile(F.col(c).cast("double"), p).alias(f"{c}{i}") for c in "xy" for i, p in enumerate(ps)])
        a = {tuple(r) for r in got.collect()}
        b = {tuple(r) for r in true.collect() if any(v is not None for v in tuple(r)[len(keys) :])}
        assert a == b


def test_one_group_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"))
    counted = value_counts(df, [], {"v": F.col("v")}).persist()
    got = order_statistics(counted, ["_q_measure"], lambda n: F.array(F.lit(0), F.ceil(n * 0.33) - 1, F.ceil(n * 0.8) - 1, n - 1)).collect()
    values = sorted(r.v for r in df.collect())
    assert {r["rank"]: r["value"] for r in got} == {i: values[i] for i in (0, 329_999, 799_999, 999_999)}
    discrete = group_percentiles(df, [], {"a": (F.col("v"), 0.33), "b": (F.col("v"), 0.8)}, discrete=True).first()
    assert tuple(discrete) == (values[329_999], values[799_999])
    counted.unpersist()


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert group_percentiles(empty, ["k"], {"m": (F.col("x"), 0.5)}).count() == 0
    assert [r.m for r in group_percentiles(empty, [], {"m": (F.col("x"), 0.5)}).collect()] == [None]
    assert box_stats(empty, ["k"], "x").count() == 0


def test_small_frame_path_matches_window(rows):
    order = [F.col("review_count").desc(), F.col("product_id").asc()]
    a = group_row_number(rows, ["main_category"], order, "rn", size_col="n")
    w = Window.partitionBy("main_category")
    b = rows.select(
        "product_id", F.row_number().over(w.orderBy(*order)).alias("w"), F.count(F.lit(1)).over(w).alias("n2")
    )
    j = a.join(b, "product_id")
    assert j.where((F.col("rn") != F.col("w")) | (F.col("n") != F.col("n2"))).count() == 0


def test_split_and_folds_spread_small_ids(spark):
    ids = spark.range(5000).withColumnRenamed("id", "product_id")
    train, test = hash_split(ids, 0.8)
    assert abs(train.count() - 4000) < 150 and train.count() + test.count() == 5000
    folds = [r["count"] for r in train.groupBy(fold_of(5).alias("f")).count().collect()]
    assert len(folds) == 5 and max(folds) - min(folds) < 150
    first = train.where("product_id < 1000").count()
    assert abs(first - 800) < 60
