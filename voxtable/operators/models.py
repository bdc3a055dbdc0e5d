"""Classifiers on Spark ML: training, comparison, storage and batch scoring."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from voxtable.functions import arrays as A
from voxtable.operators.evaluation import class_metrics
from voxtable.operators.features import (
    PcaResult, as_doubles, feature_columns, fit_pca, index_label, order_features)
from voxtable.operators.sampling import class_weight
from voxtable.session import path_exists

# Long names of two labels, seed and sizes of the compared models.
LABEL_NAMES = {"B": "Benign", "M": "Malignant"}
SEED = 42
PERCEPTRON_ITERATIONS = 200
PERCEPTRON_MIN_HIDDEN = 8
FOREGROUND = 0.0


COMPARED = ("logistic", "forest", "linear_svm", "boosted_trees", "perceptron")
LINEAR = COMPARED[0], COMPARED[2]         # what a stored model may be; only the first gives probabilities


def estimator(kind: str, n_features: int = 0) -> Any:
    """An unfitted classifier of columns ``features`` and ``label``; only the perceptron needs the width."""
    if kind == "perceptron":
        hidden = max(n_features, PERCEPTRON_MIN_HIDDEN)
        made = MultilayerPerceptronClassifier(layers=[n_features, hidden, 2], maxIter=PERCEPTRON_ITERATIONS)
    else:
        made = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "linear_svm": LinearSVC,
                "boosted_trees": GBTClassifier}[kind]()
    if made.hasParam("seed"):
        made.set(made.getParam("seed"), SEED)
    return made.setFeaturesCol("features").setLabelCol("label")


def train_models(train: DataFrame, test: DataFrame, n_features: int) -> DataFrame:
    """Metric table of all classifiers, one row each; train and test are cached across the fits."""
    spark = train.sparkSession
    level = StorageLevel.MEMORY_AND_DISK
    train, test = train.persist(level), test.persist(level)
    rows = []
    try:
        for name in COMPARED:
            scored = estimator(name, n_features).fit(train).transform(test).select(
                "label", "prediction", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("score"))
            rows.append((name, *class_metrics(scored).first()))
    finally:
        train.unpersist()
        test.unpersist()
    return spark.createDataFrame(
        rows, "model string, accuracy double, precision_1 double, recall_1 double, f1_weighted double, roc_auc double")


def leaderboard(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("roc_auc"), F.desc("accuracy"), "model")


# ---- stored model -----------------------------------------------------------------------

def fit_pipeline(df: DataFrame, label: str, kind: str = "logistic", variance: float = 0.95,
                 label_names: Mapping[str, str] = LABEL_NAMES) -> tuple[PipelineModel, dict[str, Any]]:
    """One model from raw features to prediction, and its metadata.

    The label is indexed outside the model, so rows without a label can be scored.  Predictions are named by the
    label's own values, or by ``label_names`` where it has them.
    """
    if kind not in LINEAR:
        raise ValueError(f"a stored model is one of {', '.join(LINEAR)}, not {kind!r}")
    names = feature_columns(df, label)
    labelled = index_label(as_doubles(df, names), label)
    pca: PcaResult = fit_pca(labelled, names, variance)
    reduced = pca.model.transform(labelled)
    tail = Pipeline(stages=[
        StandardScaler(inputCol="pca_features", outputCol="features", withMean=True, withStd=True),
        estimator(kind)]).fit(reduced)
    values = labelled.schema["label"].metadata["ml_attr"]["vals"]
    label_map = {str(float(i)): label_names.get(v, v) for i, v in enumerate(values)}
    meta = {"feature_order": names, "label_map": label_map, "pca_components": pca.k, "served_model": kind,
            "produces_probability": kind == "logistic"}
    return PipelineModel([*pca.model.stages, *tail.stages]), meta


def save_model(spark: SparkSession, model: PipelineModel, meta: dict[str, Any], path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, Any]]:
    if not path_exists(spark, f"{path}/metadata"):
        raise FileNotFoundError(f"No model metadata at {path!r}; fit and save the model first")
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    return PipelineModel.load(f"{path}/model"), meta


def label_predictions(scored: DataFrame, meta: dict[str, Any]) -> DataFrame:
    """Text of the prediction and the probability of class 1 (null when the model has none)."""
    names = F.create_map(*[F.lit(x) for kv in meta["label_map"].items() for x in kv])
    prob = (F.get(vector_to_array("probability"), F.lit(1)) if meta.get("produces_probability")
            else F.lit(None).cast("double"))
    return scored.withColumns({"diagnosis": F.element_at(names, F.col("prediction").cast("string")),
                               "positive_probability": prob})


def score_table(df: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Batch scoring with the stored model; also accepts a streaming table."""
    model, meta = load_model(df.sparkSession, path)
    rows = order_features(df, meta["feature_order"], keep)
    return label_predictions(model.transform(rows), meta).select(
        *keep, "prediction", "diagnosis", "positive_probability")


# ---- slice ranking ----------------------------------------------------------------------

SLICE_FEATURES = ["px_mean", "px_max", "px_std", "px_p99", "px_foreground"]


def slice_features(slices: DataFrame) -> DataFrame:
    """Summary numbers of each slice, computed inside its row."""
    n = F.size("pixels")
    mean = A.total("pixels") / n
    s = slices.withColumn("px_mean", mean)
    dev = F.aggregate("pixels", F.struct(F.lit(0.0).alias("s"), F.col("px_mean").alias("m")),
                      lambda acc, v: F.struct((acc["s"] + (v - acc["m"]) * (v - acc["m"])).alias("s"), acc["m"].alias("m")))
    fg = F.size(F.filter("pixels", lambda v: v > FOREGROUND)) / n
    return s.withColumns({
        "px_max": F.array_max("pixels"), "px_std": F.sqrt(dev["s"] / n),
        "px_p99": A.percentile_of("pixels", 0.99), "px_foreground": fg}).drop("pixels")


def fit_slice_ranker(features: DataFrame, flag: str = "has_lesion") -> PipelineModel:
    """Weighted logistic model of lesion presence from :func:`slice_features`."""
    w = class_weight(features, flag).select("pos_weight").scalar()
    rows = features.withColumns({"label": F.col(flag).cast("double"),
                                 "weight": F.when(F.col(flag), w).otherwise(F.lit(1.0))})
    return Pipeline(stages=[
        VectorAssembler(inputCols=SLICE_FEATURES, outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight")]).fit(rows)


def rank_slices(model: PipelineModel, features: DataFrame) -> DataFrame:
    return model.transform(features).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "features", "rawPrediction", "probability", "prediction")
