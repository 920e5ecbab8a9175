"""Fitted predictors, each as one pipeline model with its features inside: save it, load it, score bare sample rows."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, functions as F

from assayframe import schemas as S
from assayframe.operators import features as FT, models, neighbors
from assayframe.operators.features import FeatureStage, KeyedStage

#: Feature sets that change what a predictor does; others are accepted and left out.
USES: dict[str, set[str]] = {"constant": set(), "mean": set(), "knn": set()}


class Constant(FeatureStage):
    """One value for every row: a given constant, or the mean of the training rows."""

    value = Param(Params._dummy(), "value", "predicted value", TypeConverters.toFloat)

    def __init__(self, value: float = 0.0):
        super().__init__()
        self._setDefault(value=0.0)
        self._set(value=float(value))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return models.predict_constant(dataset, self.getOrDefault(self.value))


class Neighbors(KeyedStage):
    """The training rows that can be chosen, and the number of neighbours."""

    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)

    def __init__(self, table: DataFrame | None = None, k: int = 5):
        super().__init__(table)
        self._setDefault(k=5)
        self._set(k=k)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return neighbors.knn_predict(self.table, dataset, keep=dataset.columns, k=self.getOrDefault(self.k))


def used_features(model: str, names: Sequence[str]) -> list[str]:
    """The asked feature sets that the model can use; the others are left out with a warning."""
    if model not in USES and model not in models.LEARNERS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(sorted({*USES, *models.LEARNERS}))}")
    FT.feature_sets([n for n in names if n not in FT.SETS])  # an unknown name is an error, whatever the model
    kept = [n for n in names if n in USES.get(model, set(FT.SETS))]
    if len(kept) < len(names):
        warnings.warn(f"{model} does not use: {', '.join(sorted(set(names) - set(kept)))}", stacklevel=2)
    return kept


def fit(train: DataFrame, model: str, features: Sequence[str] = (), params: dict | None = None,
        tables: Mapping[str, DataFrame] | None = None, target: str = S.TARGET, row_id: str = "sample_id") -> PipelineModel:
    """Fit a named predictor on the annotated rows, with the conditions and the named feature sets as what it sees."""
    params, rows = params or {}, train.where(F.col(target).isNotNull())
    chosen = used_features(model, features)
    if model == "constant":
        return PipelineModel([Constant(float(params.get("value", 0.0)))])
    if model == "mean":
        return PipelineModel([Constant(rows.select(F.avg(target)).first()[0])])
    if model == "knn":
        return PipelineModel([Neighbors(rows.select(row_id, *S.CONDITIONS, target), int(params.get("k", 5)))])
    made = FT.stages(FT.feature_sets(chosen, tables))
    featured = rows
    for stage in made:
        featured = stage.transform(featured)
    with models.training_rows(featured.select(target, "features")) as narrow:
        return PipelineModel([*made, models.learner(model, params).fit(narrow)])


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    return model.transform(df).select(*(keep if keep is not None else df.columns), models.PREDICTION)

