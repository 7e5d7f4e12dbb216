"""Registered queries: name -> (Spark callable(spark, sf_dir), oracle SQL or None).

Every query derives the catalogue from the fixture tables of ``sf_dir``
(``part`` + ``lineitem``), so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.oracle_sql import advanced as oa
from shelfwise.oracle_sql import dashboard as od
from shelfwise.oracle_sql import exploration as ox
from shelfwise.oracle_sql import features as of
from shelfwise.oracle_sql import kpi as ok
from shelfwise.plans import advanced as ad
from shelfwise.plans import dashboard as db
from shelfwise.plans import exploration as ex
from shelfwise.plans import features as fe
from shelfwise.plans import incremental as inc
from shelfwise.plans import kpi
from shelfwise.plans import ml
from shelfwise.plans.feature_store import store_of
from shelfwise.session import ensure_checkpoint_dir
from shelfwise.sources import load_products

QueryFn = Callable[[SparkSession, str], DataFrame]


def _on_products(fn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_products(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


REGISTRY: dict[str, tuple[QueryFn, str | None]] = {
    "e1_dataset_overview": (_on_products(ex.dataset_overview), ox.E1),
    "e2_format_check": (_on_products(ex.format_check), ox.E2),
    "e3_missing_profile": (_on_products(ex.missing_profile), ox.E3),
    "e4_duplicate_summary": (_on_products(ex.duplicate_summary), ox.E4),
    "e5_category_distribution": (_on_products(ex.category_distribution), ox.E5),
    "e6_price_by_category": (_on_products(ex.price_by_category), ox.E6),
    "e7_rating_by_category": (_on_products(ex.rating_by_category), ox.E7),
    "e8_quality_histogram": (_on_products(ex.quality_histogram), ox.E8),
    "e9_price_rating_buckets": (_on_products(ex.price_rating_buckets), ox.E9),
    "e10_quality_card": (_on_products(ex.quality_card), ox.E10),
    "a1_top_products": (_on_products(ad.top_products), oa.A1),
    "a1_all_ranks": (_on_products(lambda p: ad.top_products(p, all_ranks=True)), oa.A1_RANKS),
    "a2_category_scoreboard": (_on_products(ad.category_scoreboard), oa.A2),
    "a2_all_ranks": (_on_products(lambda p: ad.category_scoreboard(p, all_ranks=True)), oa.A2_RANKS),
    "a3_price_positions": (_on_products(ad.price_positions), oa.A3_ROWS),
    "a3_price_recommendations": (_on_products(ad.price_recommendations), oa.A3),
    "a4_satisfaction_segments": (_on_products(ad.satisfaction_segments), oa.A4),
    "a5_performance_cohorts": (_on_products(ad.performance_cohorts), oa.A5),
    "a6_strategic_positions": (_on_products(ad.strategic_positions), oa.A6),
    "a6_all_ranks": (_on_products(lambda p: ad.strategic_positions(p, all_ranks=True)), oa.A6_RANKS),
    "a7_market_opportunities": (_on_products(ad.market_opportunities), oa.A7),
    "k1_executive_card": (_on_products(kpi.executive_card), ok.K1),
    "k2_performance_trends": (_on_products(kpi.performance_trends), ok.K2_TRENDS),
    "k2_trending_summary": (_on_products(kpi.trending_summary), ok.K2),
    "k3_category_performance": (_on_products(kpi.category_performance), ok.K3),
    "k3_all_ranks": (_on_products(lambda p: kpi.category_performance(p, all_ranks=True)), ok.K3_RANKS),
    "k4_pricing_intelligence": (_on_products(kpi.pricing_intelligence), ok.K4),
    "k4_price_spread": (_on_products(lambda p: kpi.pricing_intelligence(p, spread=True)), ok.K4_SPREAD),
    "k5_satisfaction_nps": (_on_products(kpi.satisfaction_nps), ok.K5),
    "k6_revenue_impact": (_on_products(kpi.revenue_impact), ok.K6),
    "k6_all_ranks": (_on_products(lambda p: kpi.revenue_impact(p, all_ranks=True)), ok.K6_RANKS),
    "k7_competition": (_on_products(kpi.competition), ok.K7),
    "k8_action_priorities": (_on_products(kpi.action_priorities), ok.K8),
    "k9_success_tracking": (_on_products(kpi.success_tracking), ok.K9),
}


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category statistics from the merged partials of three batches of the catalogue (the exact columns)."""
    products = load_products(spark, sf_dir)
    batches = [inc.partials(products.where(F.pmod("product_id", F.lit(3)) == b)) for b in range(3)]
    return inc.category_statistics(batches[0].unionByName(batches[1]).unionByName(batches[2])).drop("approx_names")


REGISTRY["e5_incremental_statistics"] = (_incremental, ox.E5_INCREMENTAL)


def _feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table of the catalogue, made once per application."""
    products = load_products(spark, sf_dir)
    store = store_of(spark)
    return store.open(store.key(sf_dir, products, fe.features), lambda: fe.features(fe.clean(products), with_ranks=False))


def _feature_step(step) -> QueryFn:
    """Pipeline step over the feature table, reported to 6 decimals."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        feats = _feats(spark, sf_dir)
        out = fe.report(step(feats))
        out._reads = feats  # the table stays open as long as the result
        return out

    run.__name__ = getattr(step, "__name__", "feature_step")
    return run


REGISTRY.update(
    {
        "p2_clean": (lambda spark, sf_dir: fe.report(fe.clean(load_products(spark, sf_dir))), of.P2),
        "p3_features": (_feature_step(fe.add_ranks), of.P3),
        "p7a_category_performance": (_feature_step(fe.category_performance), of.P7A),
        "p7b_price_elasticity": (_feature_step(fe.price_elasticity), of.P7B),
        "p7c_market_opportunity_top": (_feature_step(fe.market_opportunity_top), of.P7C),
        "p8a_top_categories": (_feature_step(fe.top_categories), of.P8A),
        "p8b_improvement_opportunities": (_feature_step(fe.improvement_opportunities), of.P8B),
        "p8c_underpriced_quality": (_feature_step(fe.underpriced_quality), of.P8C),
    }
)


def _dash(step) -> QueryFn:
    """Dashboard data set over the coerce-cleaned catalogue, reported to 6 decimals."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fe.report(step(db.load_clean(load_products(spark, sf_dir))))

    run.__name__ = getattr(step, "__name__", "dashboard_step")
    return run


REGISTRY.update(
    {
        "d1_dashboard_clean": (_dash(lambda d: d), od.D1),
        "d2a_category_counts": (_dash(db.category_counts), od.D2A),
        "d2b_rating_histogram": (_dash(db.rating_histogram), od.D2B),
        "d2c_price_rating_sample": (_dash(db.price_rating_sample), od.D2C),
        "d2d_top_quality_categories": (_dash(db.top_quality_categories), od.D2D),
        "d3a_category_metrics": (_dash(db.category_metrics), od.D3A),
        "d3b_category_heatmap": (_dash(db.category_heatmap), od.D3B),
        "d4a_rating_by_segment": (_dash(db.rating_by_segment), od.D4A),
        "d4b_price_boxes": (_dash(db.price_boxes), od.D4B),
        "d4c_discount_rating_sample": (_dash(db.discount_rating_sample), od.D4C),
        "d4d_price_density": (_dash(db.price_density), od.D4D),
        "d4e_underpriced_products": (_dash(db.underpriced_products), od.D4E),
        "d5a_success_flags": (_dash(db.success_flags), od.D5A),
        "d5b_success_by_category": (_dash(db.success_by_category), od.D5B),
        "d5c_performance_sample": (_dash(db.performance_sample), od.D5C),
        "d5d_success_factors": (_dash(db.success_factors), od.D5D),
        "d5e_success_overview": (_dash(db.success_overview), od.D5E),
        "d6a_subcategory_market": (_dash(db.subcategory_market), od.D6A),
        "d6b_market_gaps": (_dash(db.market_gaps), od.D6B),
        "d7a_key_metrics": (_dash(db.key_metrics), od.D7A),
        "d7b_top5_quality_categories": (_dash(lambda d: db.top_quality_categories(d, 5)), od.D7B),
        "d7c_strategic_insights": (_dash(db.strategic_insights), od.D7C),
        "d7_executive_lines": (_dash(db.executive_lines), od.D7_LINES),
        "d5c_marked_sample": (_dash(db.marked_sample), od.D5C_MARKED),
        "d8_correlation_matrix": (_dash(lambda d: db.correlation_matrix(d)), od.D8),
        "d8_filtered_correlation": (
            _dash(lambda d: db.correlation_matrix(d, category_filter=('Category 0', 'Category 1'), price_range=(500.0, 5000.0))),
            od.D8_FILTERED,
        ),
        "d9_category_drilldown": (_dash(db.category_drilldown), od.D9),
        "d9_category_rating_histogram": (_dash(db.category_rating_histogram), od.D9_HIST),
    }
)


def _rating_path(spark: SparkSession, sf_dir: str) -> str | None:
    """Where P4 leaves its fitted model for P7d: the shared folder, by the key of the feature table."""
    folder = ensure_checkpoint_dir(spark)
    products = load_products(spark, sf_dir)
    return folder and f"{folder.rstrip('/')}/rating-model-{store_of(spark).key(sf_dir, products, ml.rating_model)}"


def _fit_rating_model(spark: SparkSession, sf_dir: str) -> ml.RatingModel:
    """Train the rating model; the fitted pipeline is part of P4's output, in the shared folder where there is one."""
    m = ml.rating_model(_feats(spark, sf_dir))
    if path := _rating_path(spark, sf_dir):
        m.model.write().overwrite().save(path)
    return m


def _fitted_rating_model(spark: SparkSession, sf_dir: str):
    """The model that P4 stored for the same input and code, else one fitted now."""
    if path := _rating_path(spark, sf_dir):
        try:
            return PipelineModel.load(path)
        except (AnalysisException, Py4JJavaError):  # not stored yet
            pass
    return _fit_rating_model(spark, sf_dir).model


def _rating_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest rating model (always trained), hold-out RMSE."""
    m = _fit_rating_model(spark, sf_dir)
    return ml.model_report(spark, [("rmse", m.rmse), ("train_rows", m.train_rows), ("test_rows", m.test_rows)])


def _success_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: cross-validated logistic regression, hold-out AUC and chosen parameters."""
    m = ml.success_model(_feats(spark, sf_dir))
    return ml.model_report(
        spark, [("auc", m.auc), ("best_reg_param", m.best_reg_param), ("best_elastic_net", m.best_elastic_net)]
    )


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KMeans cluster sizes and means."""
    return fe.report(ml.cluster_summary(ml.clusters(_feats(spark, sf_dir))))


def _importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7d: importance of every feature of the rating model."""
    feats = _feats(spark, sf_dir)
    return fe.report(ml.feature_importances(_fitted_rating_model(spark, sf_dir), feats))


REGISTRY.update(
    {
        "p4_rating_model": (_rating_model, None),
        "p4_category_index": (_feature_step(ml.category_index), of.P4_INDEX),
        "p4_baseline_rmse": (_feature_step(ml.baseline_rmse), of.P4_RMSE),
        "p5_split_counts": (_feature_step(ml.split_counts), of.P5_SPLIT),
        "p5_factor_auc": (_feature_step(ml.factor_auc), of.P5_AUC),
        "p5_success_model": (_success_model, None),
        "p6_cluster_summary": (_clusters, None),
        "p7d_feature_importance": (_importances, None),
    }
)


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
