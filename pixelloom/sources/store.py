"""Models and their maps on disk: <path>/meta.json, <path>/model, <path>/map."""

from __future__ import annotations

import importlib
import json
import warnings

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators import classify, transform

KINDS = {"PCA": transform.PCA, "Clusters": classify.Clusters, "MLC": classify.MLC, "Supervised": classify.Supervised, "Validation": classify.Validation}


def _plain(x):
    if isinstance(x, np.ndarray):
        return {"array": x.tolist()}
    if isinstance(x, (np.integer, np.floating)):
        return x.item()
    if isinstance(x, tuple):
        return {"tuple": [_plain(v) for v in x]}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if type(x).__name__ in KINDS:
        return {"kind": type(x).__name__, "fields": {k: _plain(v) for k, v in vars(x).items() if k != "model"}}
    if isinstance(x, dict):
        return {"dict": {k: _plain(v) for k, v in x.items()}}
    return x


def _back(x):
    if isinstance(x, list):
        return [_back(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "array" in x:
        return np.array(x["array"])
    if "tuple" in x:
        return tuple(_back(v) for v in x["tuple"])
    if "dict" in x:
        return {k: _back(v) for k, v in x["dict"].items()}
    fields = {k: _back(v) for k, v in x["fields"].items()}
    return KINDS[x["kind"]](**fields, **({"model": None} if x["kind"] == "Supervised" else {}))


def save(model, path: str, map_: DataFrame | None = None) -> None:
    """Write a fitted PCA, Clusters, MLC, Supervised or Validation, and its map, to any
    file system that Spark has; ``meta.json`` is a text table of one line."""
    spark = SparkSession.builder.getOrCreate()
    meta = _plain(model)
    if isinstance(model, classify.Supervised):
        if isinstance(model.model, classify.MLC):
            meta["mlc"] = _plain(model.model)
        else:
            meta["class"] = f"{type(model.model).__module__}.{type(model.model).__name__}"
            model.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta.json")
    if map_ is not None:
        map_.write.mode("overwrite").parquet(f"{path}/map")


def load(spark: SparkSession, path: str) -> tuple[object, DataFrame | None]:
    """(model, map); a missing map gives a warning and None."""
    meta = json.loads(spark.read.text(f"{path}/meta.json").first()[0])
    model = _back(meta)
    if "mlc" in meta:
        model.model = _back(meta["mlc"])
    elif "class" in meta:
        module, name = meta["class"].rsplit(".", 1)
        model.model = getattr(importlib.import_module(module), name).load(f"{path}/model")
    try:
        return model, spark.read.parquet(f"{path}/map")
    except AnalysisException:
        warnings.warn(f"{path} has no map", stacklevel=2)
        return model, None
