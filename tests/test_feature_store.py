"""Life of the stored feature table, and files of the sink."""

import gc
import os

from pyspark.sql import functions as F

from shelfwise.plans.feature_store import FeatureStore
from shelfwise.plans.sinks import save_results


def test_a_table_is_made_once_and_ends_with_its_readers(spark):
    store, made = FeatureStore(spark), []

    def build(n):
        made.append(n)
        return spark.range(n)

    a, b = store.open("k1", lambda: build(5)), store.open("k1", lambda: build(5))
    assert made == [5] and a.count() == b.count() == 5 and store.tables() == {"k1": 2}
    path = store._tables["k1"].path
    c = store.open("k2", lambda: build(7))
    assert store.tables() == {"k1": 2, "k2": 1} and a.count() == 5  # still read
    del a, b
    gc.collect()
    d = store.open("k3", lambda: build(9))
    assert set(store.tables()) == {"k2", "k3"} and not os.path.exists(path.removeprefix("file:"))
    assert (c.count(), d.count(), made) == (7, 9, [5, 7, 9])
    store.release_all()
    assert store.tables() == {}


def test_the_key_follows_input_and_code(spark, tmp_path):
    store = FeatureStore(spark)
    for name in ("x", "y"):
        spark.range(3).write.parquet(str(tmp_path / name))
    x, y = (spark.read.parquet(str(tmp_path / n)) for n in "xy")
    keys = {store.key("a", x, save_results), store.key("a", y, save_results), store.key("b", x, save_results), store.key("a", x, FeatureStore)}
    assert len(keys) == 4 and store.key("a", x, save_results) in keys


def test_sink_writes_few_files_per_category(spark, tmp_path):
    rows = spark.range(30_000).repartition(24).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 10).cast("string")).alias("main_category"), F.col("id").alias("product_id"), F.sha2(F.col("id").cast("string"), 256).alias("name")
    )
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        out = save_results(rows, str(tmp_path))["processed_data"]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    files = {d: len([f for f in os.listdir(f"{out}/{d}") if f.endswith(".parquet")]) for d in os.listdir(out) if "=" in d}
    assert len(files) == 11 and 2 <= files.pop("main_category=hot") <= 24
    assert sum(files.values()) < 60  # 24 tasks held rows of every category: 240 files without rebalancing
    assert spark.read.parquet(out).count() == 30_000
