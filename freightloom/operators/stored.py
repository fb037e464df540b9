"""Fitted models in a folder, with the contract that rows must keep to be scored by them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession

from freightloom.operators.boosting import Ensemble

VERSION = 1


@dataclass
class Stored:
    """A model and its contract: the features in order with their types, the label, and what else was said of it."""

    model: PipelineModel | Ensemble
    features: dict[str, str]
    label: str
    notes: dict[str, str]

    def check(self, df: DataFrame) -> None:
        """ValueError where a feature is missing or has another type; more columns may be there."""
        there = dict(df.dtypes)
        missing = [f for f in self.features if f not in there]
        other = [f"{f} is {there[f]}, not {t}" for f, t in self.features.items() if f in there and there[f] != t]
        if missing or other:
            raise ValueError("; ".join([*[f"no column {f}" for f in missing], *other]))

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """All columns of `df` and `name`: the chance of 1, of each class (an array), or the value."""
        self.check(df)
        if isinstance(self.model, Ensemble):
            out = self.model.chances()
            return df.withColumn(name, out[0] if len(self.model.start) == 1 else out)
        out = self.model.transform(df)
        if "probability" not in out.columns:
            return out.withColumnRenamed("prediction", name).select(*df.columns, name)
        p = vector_to_array("probability")
        return out.withColumn(name, p[1] if self.model.stages[-1].numClasses == 2 else p).select(*df.columns, name)


def save(model: PipelineModel | Ensemble, path: str, train: DataFrame, features: list[str], label: str, notes: Mapping[str, str] | None = None) -> str:
    """Writes a model under `path`, which must not exist; feature types are those of `train`. Spark writes all of it, so
    that any store that Spark can write to serves."""
    types = dict(train.dtypes)
    own = model.to_json() if isinstance(model, Ensemble) else None
    contract = {"version": VERSION, "features": {f: types[f] for f in features}, "label": label, "notes": dict(notes or {}), "trees": own}
    spark = train.sparkSession
    if own is None:
        model.save(f"{path}/model")
    spark.createDataFrame([(json.dumps(contract),)], "value string").coalesce(1).write.text(f"{path}/contract")
    return path


def load(spark: SparkSession, path: str) -> Stored:
    """The model under `path`; ValueError where another version wrote it."""
    contract = json.loads(spark.read.text(f"{path}/contract", wholetext=True).first()[0])
    if contract["version"] != VERSION:
        raise ValueError(f"written by version {contract['version']}, this is {VERSION}")
    model = Ensemble.from_json(contract["trees"]) if contract["trees"] else PipelineModel.load(f"{path}/model")
    return Stored(model, contract["features"], contract["label"], contract["notes"])
