"""Stored partials of batches equal a scan of everything."""

from pyspark.sql import functions as F

from shelfwise.plans import incremental as inc
from shelfwise.sources import load_products

from .conftest import SF_SMALL


def test_batches_equal_a_scan(spark, tmp_path):
    products = load_products(spark, SF_SMALL)
    whole = {r.main_category: r for r in inc.category_statistics(inc.partials(products)).collect()}
    folder = str(tmp_path / "parts")
    batches = [products.where(F.pmod("product_id", F.lit(3)) == b) for b in range(3)]
    for b in (0, 1, 1, 2):  # the second batch is tried again
        inc.append(batches[b], folder, str(b))
    merged = {r.main_category: r for r in inc.category_statistics(inc.load(spark, folder)).collect()}
    assert merged == whole
    names = {r.main_category: r.n for r in products.groupBy("main_category").agg(F.countDistinct(F.coalesce("name", F.lit(""))).alias("n")).collect()}
    assert all(abs(merged[c].approx_names - n) <= max(1, 0.05 * n) for c, n in names.items())


def test_merging_is_associative(spark):
    products = load_products(spark, SF_SMALL)
    a, b, c = (inc.partials(products.where(F.pmod("product_id", F.lit(3)) == i)) for i in range(3))
    left = inc.merge(inc.merge(a.unionByName(b)).unionByName(c))
    right = inc.merge(a.unionByName(inc.merge(b.unionByName(c))))
    assert {tuple(r) for r in inc.category_statistics(left).collect()} == {tuple(r) for r in inc.category_statistics(right).collect()}
