"""MLlib models of the pipeline (P4 rating regression, P5 success classification,
P6 clustering, P7d feature importance).

Training data is the feature table, materialised once (reliable checkpoint
in the cluster's shared checkpoint folder, else persisted) because cross
validation reads it dozens of times. Splits hash ``product_id`` so they do
not depend on partitioning. Thresholds stay in the plan (one-row aggregate
cross join), not on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel
from pyspark.util import inheritable_thread_target

from shelfwise.functions import round_to
from shelfwise.operators import fold_of, group_percentiles, hash_split, in_train, join_group_stats, one_row, rank_auc
from shelfwise.plans.features import mean_fixed
from shelfwise.schema import (
    CV_FOLDS,
    KMEANS_K,
    LR_ELASTIC_NET_PARAMS,
    LR_MAX_ITER,
    LR_REG_PARAMS,
    RF_MAX_DEPTH,
    RF_NUM_TREES,
    SEED,
    TRAIN_FRACTION,
)
from shelfwise.session import materialize

RATING_FEATURES = ("discount_price_clean", "no_of_ratings_clean", "discount_percentage", "category_encoded")
SUCCESS_FEATURES = (
    "discount_price_clean",
    "discount_percentage",
    "price_vs_category_avg",
    "category_encoded",
    "price_segment_encoded",
)
CLUSTER_FEATURES = ("discount_price_clean", "ratings_clean", "no_of_ratings_clean", "discount_percentage", "quality_score")


@dataclass
class RatingModel:
    model: PipelineModel
    rmse: float
    train_rows: int
    test_rows: int


def _model_input(feats: DataFrame, cols) -> DataFrame:
    needed = {"product_id", "main_category", "ratings_clean", "no_of_ratings_clean", *cols}
    needed -= {"category_encoded", "price_segment_encoded"}
    if "price_segment_encoded" in cols:
        needed.add("price_segment")
    return feats.select(*sorted(needed))


def rating_model(feats: DataFrame, num_trees: int = RF_NUM_TREES, max_depth: int = RF_MAX_DEPTH) -> RatingModel:
    """Random forest predicting the rating from price, reviews, discount and category."""
    data = materialize(_model_input(feats, RATING_FEATURES))
    train, test = hash_split(data, TRAIN_FRACTION)
    pipeline = Pipeline(
        stages=[
            StringIndexer(inputCol="main_category", outputCol="category_index", handleInvalid="keep"),
            OneHotEncoder(inputCol="category_index", outputCol="category_encoded"),
            VectorAssembler(inputCols=list(RATING_FEATURES), outputCol="features"),
            StandardScaler(inputCol="features", outputCol="scaled_features"),
            RandomForestRegressor(
                featuresCol="scaled_features",
                labelCol="ratings_clean",
                numTrees=num_trees,
                maxDepth=max_depth,
                seed=SEED,
            ),
        ]
    )
    model = pipeline.fit(train)
    rmse = RegressionEvaluator(labelCol="ratings_clean", predictionCol="prediction", metricName="rmse").evaluate(
        model.transform(test)
    )
    return RatingModel(model, rmse, train.count(), test.count())


def feature_importances(model: PipelineModel, feats: DataFrame) -> DataFrame:
    """P7d: importance of every assembled feature (one-hot slots named by category)."""
    spark = feats.sparkSession
    forest = model.stages[-1]
    sample = model.transform(feats.limit(1))
    meta = sample.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for attr in group:
            names[attr["idx"]] = attr["name"]
    imp = forest.featureImportances.toArray().tolist()
    rows = [(names.get(i, f"feature_{i}"), float(v)) for i, v in enumerate(imp)]
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame(rows, schema).orderBy(F.col("importance").desc(), "feature")


def success_label(feats: DataFrame, rating_threshold: float = 4.0, review_quantile: float = 0.7) -> DataFrame:
    """Label ``is_successful``: rating >= 4 and reviews >= the discrete 70th percentile."""
    thr = one_row(group_percentiles(feats, [], {"_rthr": (F.col("no_of_ratings_clean"), review_quantile)}, discrete=True))
    ok = (F.col("ratings_clean") >= rating_threshold) & (F.col("no_of_ratings_clean") >= F.col("_rthr"))
    return feats.crossJoin(thr).withColumn("is_successful", ok.cast("int")).drop("_rthr")


@dataclass
class SuccessModel:
    model: object
    auc: float
    best_reg_param: float
    best_elastic_net: float
    metrics: list[float]


def success_model(feats: DataFrame, folds: int = CV_FOLDS, parallelism: int | None = None) -> SuccessModel:
    """P5: logistic regression with a 3 x 3 grid and k-fold cross validation (AUC).

    ``parallelism`` (default: the grid size) is the number of model fits run
    at once; each fit is itself a distributed job.
    """
    data = materialize(success_label(_model_input(feats, SUCCESS_FEATURES)))
    train, test = hash_split(data, TRAIN_FRACTION)
    # Folds from the id's key (not a seeded random split): the same folds for any partitioning of the input.
    train = train.withColumn("_fold", fold_of(folds))
    lr = LogisticRegression(featuresCol="scaled_features", labelCol="is_successful", maxIter=LR_MAX_ITER)
    preparation = Pipeline(
        stages=[
            StringIndexer(inputCol="main_category", outputCol="category_index", handleInvalid="keep"),
            StringIndexer(inputCol="price_segment", outputCol="price_segment_index", handleInvalid="keep"),
            OneHotEncoder(inputCol="category_index", outputCol="category_encoded"),
            OneHotEncoder(inputCol="price_segment_index", outputCol="price_segment_encoded"),
            VectorAssembler(inputCols=list(SUCCESS_FEATURES), outputCol="features"),
            StandardScaler(inputCol="features", outputCol="scaled_features"),
        ]
    )
    grid = (
        ParamGridBuilder()
        .addGrid(lr.regParam, list(LR_REG_PARAMS))
        .addGrid(lr.elasticNetParam, list(LR_ELASTIC_NET_PARAMS))
        .build()
    )
    evaluator = BinaryClassificationEvaluator(labelCol="is_successful")
    metrics = cross_validate(preparation, lr, grid, evaluator, train, "_fold", folds, parallelism or len(grid))
    best = grid[max(range(len(grid)), key=lambda i: (metrics[i], -i))]
    prepared = preparation.fit(train)
    fitted = lr.fit(_vectors(prepared, train), best)
    model = PipelineModel([*prepared.stages, fitted])
    auc = evaluator.evaluate(model.transform(test))
    return SuccessModel(model, auc, float(fitted.getRegParam()), float(fitted.getElasticNetParam()), metrics)


def _vectors(prepared: PipelineModel, rows: DataFrame) -> DataFrame:
    return prepared.transform(rows).select("scaled_features", "is_successful")


def cross_validate(preparation: Pipeline, estimator, grid, evaluator, train: DataFrame, fold_col: str, folds: int, parallelism: int) -> list[float]:
    """Mean metric of every parameter map over the folds; the preparation is fitted once per fold.

    Indexers, encoders and the scaler have no parameters in the grid, so each fold fits them once on its training rows and keeps the
    prepared vectors (two narrow columns); only the estimator is fitted per parameter map, ``parallelism`` fits at once.
    """
    totals = [0.0] * len(grid)
    for fold in range(folds):
        inside, outside = train.where(F.col(fold_col) != fold), train.where(F.col(fold_col) == fold)
        prepared = preparation.fit(inside)
        learn, check = (_vectors(prepared, rows).persist(StorageLevel.MEMORY_AND_DISK) for rows in (inside, outside))

        def metric(i: int, learn: DataFrame = learn, check: DataFrame = check) -> float:
            return evaluator.evaluate(estimator.fit(learn, grid[i]).transform(check))

        with ThreadPool(processes=max(1, min(parallelism, len(grid)))) as pool:
            for i, value in enumerate(pool.map(inheritable_thread_target(train.sparkSession)(metric), range(len(grid)))):
                totals[i] += value / folds
        learn.unpersist()
        check.unpersist()
    return totals


def split_counts(feats: DataFrame, folds: int = CV_FOLDS) -> DataFrame:
    """Rows per part, fold (training part only) and label of the success model."""
    part = F.when(in_train(TRAIN_FRACTION), F.lit("train")).otherwise(F.lit("test"))
    labelled = success_label(feats.select("product_id", "ratings_clean", "no_of_ratings_clean")).withColumn("part", part)
    fold = F.when(F.col("part") == "train", fold_of(folds))
    return labelled.groupBy("part", fold.alias("fold"), "is_successful").agg(F.count(F.lit(1)).alias("n"))


def factor_auc(feats: DataFrame, factors: Sequence[str] = ("discount_percentage", "price_vs_category_avg", "quality_score", "no_of_ratings_clean")) -> DataFrame:
    """AUC of single factors as predictors of success on the test rows: what the success model has to beat."""
    labelled = success_label(feats.select("product_id", "ratings_clean", *dict.fromkeys([*factors, "no_of_ratings_clean"])))
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), round_to(F.col(f).cast("double"), 6).alias("score")) for f in factors])
    long = labelled.where(~in_train(TRAIN_FRACTION)).select("product_id", "is_successful", F.inline(pairs))
    return rank_auc(long, "score", "is_successful", "product_id", ["factor"])


def category_index(feats: DataFrame) -> DataFrame:
    """The category index of the models: most frequent first among the training rows, then by name."""
    train, _ = hash_split(feats.select("product_id", "main_category"), TRAIN_FRACTION)
    labels = StringIndexer(inputCol="main_category", outputCol="category_index", handleInvalid="keep").fit(train).labels
    index = feats.sparkSession.createDataFrame(list(enumerate(labels)), "category_index int, main_category string")
    return index.join(train.groupBy("main_category").agg(F.count(F.lit(1)).alias("train_rows")), "main_category")


def baseline_rmse(feats: DataFrame) -> DataFrame:
    """RMSE on the test rows of the mean rating of the category's training rows: what the rating model has to beat."""
    train, test = hash_split(feats.select("product_id", "main_category", "ratings_clean"), TRAIN_FRACTION)
    means = train.groupBy("main_category").agg(mean_fixed("ratings_clean").alias("prediction"))
    guessed = join_group_stats(test, means, ["main_category"])
    rmse = RegressionEvaluator(labelCol="ratings_clean", predictionCol="prediction", metricName="rmse").evaluate(guessed)
    return guessed.agg(F.count(F.lit(1)).alias("test_rows")).withColumn("rmse", F.lit(float(rmse)))


def clusters(feats: DataFrame, k: int = KMEANS_K) -> DataFrame:
    """KMeans on 5 scaled features; returns rows with their ``prediction``."""
    data = materialize(feats.select("product_id", "name", "main_category", *CLUSTER_FEATURES))
    assembled = VectorAssembler(inputCols=list(CLUSTER_FEATURES), outputCol="features").transform(data)
    scaled = StandardScaler(inputCol="features", outputCol="scaled_features").fit(assembled).transform(assembled)
    model = KMeans(featuresCol="scaled_features", k=k, seed=SEED).fit(scaled)
    return model.transform(scaled)


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Per-cluster size and mean price, rating, reviews and discount."""
    return (
        clustered.groupBy("prediction")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("discount_price_clean").alias("avg_price"),
            F.avg("ratings_clean").alias("avg_rating"),
            F.avg("no_of_ratings_clean").alias("avg_reviews"),
            F.avg("discount_percentage").alias("avg_discount"),
        )
        .orderBy("prediction")
    )


def model_report(spark, rows: list[tuple[str, float]]) -> DataFrame:
    schema = T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])
    return spark.createDataFrame([(k, float(v)) for k, v in rows], schema)
