"""The models as Spark ML estimators, so that they stand in a Pipeline, take parameters by name, and are saved and loaded with it."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from tidewell.operators.models import FITTERS, LinearRisk, fit
from tidewell.operators.trees import TreeRisk


class _Shared(Params):
    features: Param = Param(Params._dummy(), "features", "feature columns", TypeConverters.toListString)
    predictionCol: Param = Param(Params._dummy(), "predictionCol", "column of the scores", TypeConverters.toString)


class RiskEstimator(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a survival model of a registered kind (cox, coxnet, componentwise, boosting, forest); settings: its parameters as a JSON object."""

    kind: Param = Param(Params._dummy(), "kind", "registered kind of model", TypeConverters.toString)
    settings: Param = Param(Params._dummy(), "settings", "parameters of the kind, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, kind: str = "cox", features: list[str] | None = None, settings: str = "{}", predictionCol: str = "risk"):
        super().__init__()
        self._setDefault(kind="cox", settings="{}", predictionCol="risk", features=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RiskModel:
        kind = self.getOrDefault("kind")
        if kind not in FITTERS:
            raise ValueError(f"no model of kind {kind}; there are {', '.join(FITTERS)}")
        found = fit(kind, dataset, self.getOrDefault("features"), **json.loads(self.getOrDefault("settings")))
        return RiskModel()._set(features=self.getOrDefault("features"), predictionCol=self.getOrDefault("predictionCol"), model=found.to_json())


class RiskModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted model; its numbers are a parameter, so it is saved with the others."""

    model: Param = Param(Params._dummy(), "model", "the fitted model, as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(predictionCol="risk", features=[])

    def risk(self) -> LinearRisk | TreeRisk:
        text = self.getOrDefault("model")
        return (TreeRisk if '"trees"' in text else LinearRisk).from_json(text)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.risk().transform(dataset, self.getOrDefault("predictionCol"))


def registry(models: dict[str, dict], features: list[str]) -> dict[str, RiskEstimator]:
    """Estimators by name from a configuration {name: {"kind", "enabled", "params"}}; those that aren't enabled are left out."""
    kept = {n: m for n, m in models.items() if m.get("enabled", True)}
    return {n: RiskEstimator(kind=m.get("kind", n), features=features, settings=json.dumps(m.get("params", {}))) for n, m in kept.items()}
