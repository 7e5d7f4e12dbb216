"""MLlib steps run end to end on the smallest fixture (reduced folds)."""

from pyspark.sql import functions as F

from shelfwise.operators import rank_auc
from shelfwise.plans import features as fe
from shelfwise.plans import ml
from shelfwise.sources import load_products

from .conftest import SF_SMALL


def _feats(spark):
    return fe.features(fe.clean(load_products(spark, SF_SMALL)), with_ranks=False)


def test_rating_model_and_importances(spark):
    feats = _feats(spark)
    m = ml.rating_model(feats, num_trees=10, max_depth=4)
    assert m.rmse >= 0 and m.train_rows + m.test_rows == feats.count()
    imp = ml.feature_importances(m.model, feats)
    names = [r.feature for r in imp.collect()]
    assert "discount_price_clean" in names and any(n.startswith("category_encoded") for n in names)
    assert abs(sum(r.importance for r in imp.collect()) - 1.0) < 1e-6


def test_success_model(spark):
    m = ml.success_model(_feats(spark), folds=2, parallelism=2)
    assert 0.0 <= m.auc <= 1.0
    assert m.best_reg_param in (0.01, 0.1, 1.0)


def test_clusters(spark):
    summary = ml.cluster_summary(ml.clusters(_feats(spark)))
    rows = summary.collect()
    assert len(rows) == 5
    assert sum(r["count"] for r in rows) == _feats(spark).count()


def test_success_label_uses_threshold_in_plan(spark):
    labelled = ml.success_label(_feats(spark))
    assert labelled.where(F.col("is_successful") == 1).count() > 0


def test_rank_auc_counts_pairs(spark):
    rows = [("a", 1, 0.1, 0), ("a", 2, 0.4, 1), ("a", 3, 0.4, 0), ("a", 4, 0.9, 1), ("a", 5, None, 1), ("b", 6, 1.0, 1), (None, 7, 2.0, 0), (None, 8, 3.0, 1)]
    got = {r.k: r.auc for r in rank_auc(spark.createDataFrame(rows, "k string, i int, s double, y int"), "s", "y", "i", ["k"]).collect()}
    assert got == {"a": 0.875, "b": None, None: 1.0}


def test_folds_prepare_once(spark, monkeypatch):
    """One preparation per fold and one for the final model, whatever the grid."""
    from pyspark.ml import Pipeline

    fitted, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, *a, **k: fitted.append(1) or fit(self, *a, **k))
    m = ml.success_model(_feats(spark), folds=3, parallelism=3)
    assert len(fitted) == 4 and len(m.metrics) == 9 and max(m.metrics) <= 1.0
