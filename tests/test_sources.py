"""Sources, sinks and streaming ingestion."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import features as fe
from shelfwise.plans import sinks
from shelfwise.schema import RAW_COLUMNS
from shelfwise.sources import (
    load_products,
    read_catalogue_csv,
    read_catalogue_csv_by_name,
    read_catalogue_parquet,
    with_products,
)
from shelfwise.streaming import ingest_catalogue

from .conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="shelfwise-test-", dir="/tmp")


def test_products_match_duckdb(spark, duck):
    s = load_products(spark, SF_SMALL, materialise=False).toPandas().sort_values("product_id").reset_index(drop=True)
    o = duck.execute(with_products("SELECT * FROM products")).df().sort_values("product_id").reset_index(drop=True)
    assert list(s.columns) == ["product_id", *RAW_COLUMNS]
    assert len(s) == len(o) == 204
    assert s.fillna("<NULL>").astype(str).equals(o[s.columns].fillna("<NULL>").astype(str))


def test_csv_reader_roundtrip(spark):
    pdf = load_products(spark, SF_SMALL).toPandas()
    d = _tmp()
    half = len(pdf) // 2
    pdf.iloc[:half][list(RAW_COLUMNS)].to_csv(os.path.join(d, "a.csv"), index=False)
    pdf.iloc[half:][list(RAW_COLUMNS)].to_csv(os.path.join(d, "b.csv"), index=False)
    df = read_catalogue_csv(spark, d)
    assert df.count() == len(pdf)
    assert set(df.columns) == {"product_id", *RAW_COLUMNS}
    assert df.select("product_id").distinct().count() == len(pdf)
    # all-text schema: the rating column stays text even where it is clean
    assert dict(df.dtypes)["ratings"] == "string"


def test_csv_union_by_name_allows_missing_columns(spark):
    d = _tmp()
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write("ratings,name,main_category\n4.1,a,Cat\n")
    with open(os.path.join(d, "y.csv"), "w") as f:
        f.write("name,discount_price\nb,₹10\n")
    df = read_catalogue_csv_by_name(spark, [os.path.join(d, "x.csv"), os.path.join(d, "y.csv")])
    rows = {r.name: r for r in df.collect()}
    assert rows["a"].ratings == "4.1" and rows["a"].discount_price is None
    assert rows["b"].discount_price == "₹10" and rows["b"].main_category is None


def test_missing_input_raises(spark):
    with pytest.raises(ValueError):
        read_catalogue_csv(spark, "/tmp/does-not-exist-shelfwise/*.csv")
    with pytest.raises(ValueError):
        read_catalogue_parquet(spark, "/tmp/does-not-exist-shelfwise")


def test_empty_folder_and_unknown_header_raise(spark):
    empty, other = _tmp(), _tmp()
    with pytest.raises(ValueError):
        read_catalogue_csv(spark, empty)
    with open(os.path.join(other, "x.csv"), "w") as f:
        f.write("alpha,beta\n1,2\n")
    with pytest.raises(ValueError):
        read_catalogue_csv(spark, other)


def test_csv_columns_follow_the_header(spark):
    d = _tmp()
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write("ratings,extra,name,discount_price\n4.2,z,a,₹10\n")
    row = read_catalogue_csv(spark, d).first()
    assert (row.ratings, row.name, row.discount_price, row.main_category) == ("4.2", "a", "₹10", None)
    assert "extra" not in row.asDict()
    with open(os.path.join(d, "y.csv"), "w") as f:
        f.write("name,ratings,extra,discount_price\nb,3.9,z,₹11\n")
    with pytest.raises(Exception):  # a second header is an error, never a silent shift of columns
        read_catalogue_csv(spark, d).collect()


def test_stream_row_numbers_are_dense_over_many_partitions(spark):
    from shelfwise.streaming.ingest import _with_row_number

    got = _with_row_number(spark.range(0, 5000, 1, 700)).agg(F.count("_row"), F.countDistinct("_row"), F.min("_row"), F.max("_row")).first()
    assert tuple(got) == (5000, 5000, 0, 4999)


def test_sink_partitions_by_category(spark):
    feats = fe.features(fe.clean(load_products(spark, SF_SMALL)), with_ranks=False)
    out = sinks.save_results(feats, _tmp())
    back = spark.read.parquet(out["processed_data"])
    assert back.count() == feats.count()
    assert any(name.startswith("main_category=") for name in os.listdir(out["processed_data"]))


def test_streaming_ingest(spark):
    pdf = load_products(spark, SF_SMALL).toPandas()
    src, table, ckpt = _tmp(), _tmp(), _tmp()
    pdf.iloc[:100][list(RAW_COLUMNS)].to_csv(os.path.join(src, "cat1.csv"), index=False)
    pdf.iloc[100:][list(RAW_COLUMNS)].to_csv(os.path.join(src, "cat2.csv"), index=False)
    q = ingest_catalogue(spark, src, os.path.join(table, "t"), checkpoint_location=os.path.join(ckpt, "c"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(table, "t"))
    assert out.count() == len(pdf)
    assert out.select("product_id").distinct().count() == len(pdf)
    # re-running on the same checkpoint takes no file twice
    q2 = ingest_catalogue(spark, src, os.path.join(table, "t"), checkpoint_location=os.path.join(ckpt, "c"))
    q2.awaitTermination(120)
    assert spark.read.parquet(os.path.join(table, "t")).count() == len(pdf)


def test_sql_over_registered_views(spark):
    from shelfwise.sources import register_catalogue

    products = load_products(spark, SF_SMALL)
    register_catalogue(products)
    n = spark.sql("SELECT COUNT(*) AS n FROM products").first().n
    assert n == products.count()
    valid = spark.sql(
        "SELECT main_category, COUNT(*) AS c, AVG(rating) AS r FROM products_parsed "
        "WHERE v_price AND v_rating AND v_count GROUP BY main_category"
    )
    assert valid.agg(F.sum("c")).first()[0] > 0


def test_files_of_one_header_are_one_read(spark, tmp_path):
    heads = ["name,ratings", "ratings,name,extra", "name,main_category"]
    for i in range(60):
        (tmp_path / f"f {i:02}.csv").write_text(heads[i % 3] + f"\nn{i},4.{i % 10}\n")
    (tmp_path / "empty.csv").write_text("")
    out = read_catalogue_csv_by_name(spark, [str(tmp_path)])
    got = {(r.name, r.ratings, r.main_category) for r in out.collect()}
    wanted = [(f"n{i}", f"4.{i % 10}", None) if i % 3 == 0 else (f"4.{i % 10}", f"n{i}", None) if i % 3 == 1 else (f"n{i}", None, f"4.{i % 10}") for i in range(60)]
    assert got == set(wanted)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
