"""Training and scoring on ``pyspark.ml``, chosen by an algorithm record."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.columns import col, numeric_columns, require
from millrace.operators import metrics
from millrace.operators.project import mark_correct, remap_anomaly, signed_error
from millrace.session import dealt


@dataclass(frozen=True)
class Algorithm:
    """What to train: name, kind, and options handed to the estimator."""

    name: str
    type: str
    input_variables: Mapping[str, object] = field(default_factory=dict)
    scoring: str | None = None

    @property
    def is_supervised(self) -> bool:
        return self.type in ("classification", "regression")

    @staticmethod
    def from_json(text: str) -> "Algorithm":
        record = json.loads(text)
        return Algorithm(record["name"], record["type"], record.get("input_variables") or {}, record.get("scoring"))


def _boosted_classifier(classes: int, options: dict):
    tree = GBTClassifier(**{"seed": 1, "maxIter": 20, **options})
    return tree if classes <= 2 else OneVsRest(classifier=tree)


def _linear_svc(classes: int, options: dict):
    svc = LinearSVC(**options)
    return svc if classes <= 2 else OneVsRest(classifier=svc)


#: (type, name) -> factory(number of classes, options) -> estimator
REGISTRY: dict[tuple[str, str], Callable] = {
    ("classification", "LogisticRegression"): lambda k, o: LogisticRegression(**o),
    ("classification", "LinearSupportVectorMachines"): _linear_svc,
    ("classification", "GaussianNaiveBayes"): lambda k, o: NaiveBayes(**{"modelType": "gaussian", **o}),
    ("classification", "RandomForest"): lambda k, o: RandomForestClassifier(**{"seed": 1, "numTrees": 100, **o}),
    ("classification", "GradientBoosting"): _boosted_classifier,
    ("regression", "LinearRegression"): lambda k, o: LinearRegression(**o),
    ("regression", "RobustLinearRegression"): lambda k, o: LinearRegression(**{"loss": "huber", **o}),
    ("regression", "RandomForest"): lambda k, o: RandomForestRegressor(**{"seed": 1, "numTrees": 100, **o}),
    ("regression", "GradientBoosting"): lambda k, o: GBTRegressor(**{"seed": 1, "maxIter": 20, **o}),
    ("clustering", "KMeans"): lambda k, o: KMeans(**{"k": 2, "seed": 1, **o}),
}


def _own_models() -> dict[tuple[str, str], Callable]:
    """(type, name) -> trainer(table, features, options) of the models that are not Spark's.

    Drift models keep the reference table and are applied to another one by ``transform``.
    """
    from millrace.operators import anomaly, kernels, meanshift
    from millrace.operators.drift import DriftModel

    def forest(df, features, o):
        o = {"trees": o.pop("n_estimators", 100), **o}
        return anomaly.train_isolation_forest(df, o.pop("key", features), features, **o)

    return {
        ("anomaly", "IsolationForest"): forest,
        ("anomaly", "OneClassSVM"): lambda df, features, o: kernels.train_one_class_machine(df, features, **o),
        ("anomaly", "DistanceRule"): lambda df, features, o: anomaly.train_one_class(df, features, **o),
        ("clustering", "MeanShift"): lambda df, features, o: meanshift.train_mean_shift(df, features, **o),
        ("drift", "KolmogorovSmirnov"): lambda df, features, o: DriftModel(df, tuple(features), "KolmogorovSmirnov", o),
        ("drift", "SpotDiff"): lambda df, features, o: DriftModel(df, tuple(features), "SpotDiff", o),
    }


def feature_names(df: DataFrame, label: str | None, features: Sequence[str] | None) -> list[str]:
    return require(df, features) if features else numeric_columns(df, (label,))


def train(df: DataFrame, algorithm: Algorithm, label: str | None = None, features: Sequence[str] | None = None) -> PipelineModel:
    """Fit a pipeline that turns a table into the same table plus ``predictions``.

    Classes may be of any type; predictions are in the labels' own spelling (as text).
    """
    if algorithm.name == "AdaBoost":
        from millrace.operators.boosting import train_adaboost

        return train_adaboost(df, algorithm, label, feature_names(df, label, features))
    if algorithm.name == "BayesianRidgeRegression":
        from millrace.operators.ridge import train_bayesian_ridge

        return train_bayesian_ridge(df, label, feature_names(df, label, features), **algorithm.input_variables)
    if algorithm.name in ("XGBoost", "CatBoost") and algorithm.is_supervised:
        from millrace.operators.gradient import train_second_order
        from millrace.operators.ordered_targets import train_ordered_targets

        fit = train_second_order if algorithm.name == "XGBoost" else train_ordered_targets
        return fit(df, algorithm, label, feature_names(df, label, features))
    if algorithm.name in ("SupportVectorMachines", "SupportVectorRegression"):
        from millrace.operators.kernels import train_kernel_machine

        options = dict(algorithm.input_variables)
        if options.pop("kernel", "rbf") != "linear":
            return train_kernel_machine(df, algorithm, label, feature_names(df, label, features))
        linear = "LinearSupportVectorMachines" if algorithm.type == "classification" else "RobustLinearRegression"
        algorithm = Algorithm(linear, algorithm.type, options, algorithm.scoring)
    own = _own_models()
    key = (algorithm.type, algorithm.name)
    if key in own:
        return own[key](df, feature_names(df, label, features), dict(algorithm.input_variables))
    if key not in REGISTRY:
        raise ValueError(f"unknown algorithm {key}; one of {sorted([*REGISTRY, *own])}")
    names = feature_names(df, label, features)
    assembler = VectorAssembler(inputCols=names, outputCol="__features", handleInvalid="error")
    prepared, back, classes = df, None, 0
    if algorithm.type == "classification":
        index = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="error").fit(df)
        prepared, classes = index.transform(df), len(index.labels)
        back = IndexToString(inputCol="__prediction", outputCol="predictions", labels=index.labels)
    prediction = "__prediction" if back else "predictions"
    estimator = REGISTRY[key](classes, dict(algorithm.input_variables))
    _set(estimator, featuresCol="__features", predictionCol=prediction)
    if algorithm.is_supervised:
        _set(estimator, labelCol="__label" if back else label)
    if isinstance(estimator, OneVsRest):
        _set(estimator.getClassifier(), featuresCol="__features")
    needed = [*names, "__label"] if back else [*names, label] if algorithm.is_supervised else names
    # fitting passes over the rows many times: keep just the columns it reads, in all tasks
    held = assembler.transform(dealt(prepared.select([col(c) for c in needed]))).drop(*names).persist()
    try:
        fitted = estimator.fit(held)
    finally:
        held.unpersist()
    return PipelineModel([assembler, fitted, *([back] if back else [])])


def _set(stage, **params) -> None:
    for name, value in params.items():
        stage.set(stage.getParam(name), value)


def score(model, df: DataFrame, label: str | None = None, algorithm_type: str = "classification") -> DataFrame:
    """The table plus ``predictions`` and, where a label is present, how they compare with it.

    Predictions stay on their row; nothing is joined by position.
    """
    out = model.transform(df)
    out = out.drop(*[c for c in out.columns if c not in df.columns and c != "predictions"])
    if label is None or label not in df.columns:
        return out
    if algorithm_type == "classification":
        out = out.withColumn("predictions", col("predictions").cast(df.schema[label].dataType))
        return mark_correct(out, label)
    if algorithm_type == "regression":
        return signed_error(out, label)
    if algorithm_type == "anomaly":
        return mark_correct(remap_anomaly(out), label)
    return out


def score_table(scored: DataFrame, label: str, algorithm_type: str) -> DataFrame:
    """The one-row metrics table of a kind of model."""
    if algorithm_type in ("classification", "anomaly"):
        return metrics.classification_scores(scored, label)
    if algorithm_type == "regression":
        return metrics.regression_scores(scored, label)
    if algorithm_type == "clustering":
        return metrics.clustering_scores(scored, label)
    raise ValueError(f"no scores for {algorithm_type}")


def linear_attribution(
    df: DataFrame, coefficients: Mapping[str, float], background: DataFrame | None = None
) -> DataFrame:
    """Add ``attr_<c>`` = coefficient × (x - mean of x): the exact additive attribution of a linear model."""
    names = require(df, coefficients)
    means = (background if background is not None else df).agg(*[F.avg(col(c)).alias(c) for c in names]).first()
    return df.withColumns({f"attr_{c}": F.lit(float(coefficients[c])) * (col(c) - F.lit(means[c])) for c in names})


def linear_coefficients(model: PipelineModel) -> dict[str, float]:
    """Feature name -> coefficient of a fitted linear pipeline."""
    names = model.stages[0].getInputCols()
    return dict(zip(names, np.asarray(model.stages[1].coefficients.toArray(), float).tolist()))


def probability_of(model: PipelineModel, df: DataFrame, value: str) -> DataFrame:
    """Add ``probability`` of one class."""
    labels = model.stages[-1].getLabels()
    out = model.transform(df)
    return out.withColumn("probability", vector_to_array("probability")[labels.index(str(value))]).select(
        [col(c) for c in df.columns] + [F.col("probability")]
    )


def summarize_kmeans_ids(df: DataFrame, column: str, clusters: int = 10, seed: int = 0) -> DataFrame:
    """Replace a column by its k-means cluster over all rows, numbered in order of the centres."""
    vector = VectorAssembler(inputCols=[column], outputCol="__v", handleInvalid="skip")
    model = KMeans(k=clusters, seed=seed, featuresCol="__v", predictionCol="__c").fit(vector.transform(df))
    centers = [float(c[0]) for c in model.clusterCenters()]
    place = {c: i for i, c in enumerate(sorted(range(len(centers)), key=centers.__getitem__))}
    order = F.array(*[F.lit(place[i]) for i in range(len(centers))])
    out = model.transform(vector.transform(df))
    return out.withColumn(column, F.get(order, F.col("__c")).cast("double")).drop("__v", "__c")
