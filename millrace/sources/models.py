"""Saving and loading fitted models: Spark's pipelines in Spark's own format, the package's models as JSON text (never by
unpickling)."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import SparkSession

from millrace.columns import col
from millrace.operators.anomaly import DistanceRule, IsolationForest
from millrace.operators.boosting import BoostedTrees
from millrace.operators.drift import DriftModel
from millrace.operators.gradient import GradientTrees, Tree
from millrace.operators.kernels import FourierMap, KernelMachine, OneClassMachine
from millrace.operators.meanshift import MeanShiftModel
from millrace.operators.ordered_targets import CodedTrees
from millrace.operators.ridge import LinearFit
from millrace.operators.scale import Scaler

_OWN = {c.__name__: c for c in (BoostedTrees, CodedTrees, DistanceRule, DriftModel, FourierMap, GradientTrees, IsolationForest, KernelMachine, LinearFit, MeanShiftModel, OneClassMachine, Scaler, Tree)}
_TREES = {"classifier": DecisionTreeClassificationModel, "regressor": DecisionTreeRegressionModel}


def _plain(value):
    if dataclasses.is_dataclass(value):
        return {"class": type(value).__name__} | {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    if isinstance(value, tuple):
        return {"tuple": [_plain(v) for v in value]}
    return {"dict": value} if isinstance(value, dict) else value


def _restored(value):
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.asarray(value["array"], float)
    if "tuple" in value:
        return tuple(_restored(v) for v in value["tuple"])
    if "dict" in value:
        return value["dict"]
    return _OWN[value["class"]](**{k: _restored(v) for k, v in value.items() if k != "class"})


def save_model(model, path: str) -> None:
    """Write a Spark pipeline or one of the package's models to a folder; an older one there is replaced."""
    if type(model).__name__ not in _OWN:
        model.write().overwrite().save(path)
        return
    kind = None
    if isinstance(model, BoostedTrees):  # its trees are Spark's
        kind = "classifier" if isinstance(model.trees[0], DecisionTreeClassificationModel) else "regressor"
        for i, tree in enumerate(model.trees):
            tree.write().overwrite().save(f"{path}/trees/{i}")
        model = dataclasses.replace(model, trees=(len(model.trees),))
    if isinstance(model, CodedTrees):  # a table per category column
        for i, table in enumerate(model.statistics):
            table.write.mode("overwrite").parquet(f"{path}/statistics/{i}")
        model, kind = dataclasses.replace(model, statistics=(len(model.statistics),)), "coded"
    if isinstance(model, DriftModel):  # its reference is a table
        key = model.options.get("key")
        columns = dict.fromkeys([*([key] if isinstance(key, str) else key or []), *model.features])
        model.reference.select([col(c) for c in columns]).write.mode("overwrite").parquet(f"{path}/reference")
        model, kind = dataclasses.replace(model, reference=None), "drift"
    text = json.dumps({"kind": kind, "model": _plain(model)})
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/own")


def load_model(path: str):
    """The model that ``save_model`` wrote to a folder."""
    spark = SparkSession.getActiveSession()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/own")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return PipelineModel.load(path)
    record = json.loads(spark.read.text(f"{path}/own").first()[0])
    model = _restored(record["model"])
    if record["kind"] == "drift":
        return dataclasses.replace(model, reference=spark.read.parquet(f"{path}/reference"))
    if record["kind"] == "coded":
        return dataclasses.replace(model, statistics=tuple(spark.read.parquet(f"{path}/statistics/{i}") for i in range(model.statistics[0])))
    if record["kind"]:
        trees = tuple(_TREES[record["kind"]].load(f"{path}/trees/{i}") for i in range(model.trees[0]))
        model = dataclasses.replace(model, trees=trees)
    return model
