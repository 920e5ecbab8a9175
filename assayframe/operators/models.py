"""Predictors: constant, mean, trees, linear head, external batch models; a registry and persistence."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayframe import schemas as S
from assayframe.functions import encode as E, numeric as N, text as X
from assayframe.operators import metrics as M

PREDICTION = "predicted_pcmc"
#: Thresholds a tree may try for a feature; the conditions and counts here have fewer values, so none is lost.
MAX_BINS = 128
#: Training rows of one task, and the tasks that a smaller table is dealt over at most.
ROWS_PER_TASK = 1 << 18
FEW_TASKS = 8


def predict_constant(df: DataFrame, value: float = 0.0, prediction: str = PREDICTION) -> DataFrame:
    return df.withColumn(prediction, F.lit(float(value)))


def predict_mean(train: DataFrame, df: DataFrame, target: str = S.TARGET, prediction: str = PREDICTION) -> DataFrame:
    return df.withColumn(prediction, train.select(F.avg(target)).scalar())


def condition_features(df: DataFrame) -> DataFrame:
    """Numeric features without nulls, as Spark's learners need them: a presence mask stands beside
    each filled value, so 'absent' stays distinguishable from 0."""
    c = F.col(S.SUBJECT)
    out = df.withColumns({
        "x_carbons": X.count_char(c).cast("double"),
        "x_tail": X.leading_run_length(c).cast("double"),
        "x_length": F.length(c).cast("double"),
        "x_temperature": F.coalesce(F.col(S.TEMPERATURE), F.lit(S.DEFAULT_TEMPERATURE)),
        "x_conc": F.coalesce(F.col(S.CONCENTRATION), F.lit(0.0)),
        "x_conc_mask": N.number_mask(F.col(S.CONCENTRATION)),
        "x_additive_mask": N.text_mask(F.col(S.ADDITIVE)),
    })
    hot = E.one_hot_fixed(X.subject_class(c), S.SUBJECT_CLASSES, "x_class")
    return out.withColumns({k: v.cast("double") for k, v in hot.items()})


CONDITION_COLUMNS = [
    "x_carbons", "x_tail", "x_length", "x_temperature", "x_conc", "x_conc_mask", "x_additive_mask",
    *[f"x_class_{level}" for level in [*S.SUBJECT_CLASSES, "nan"]],
]


def forest(params: dict | None = None, prediction: str = PREDICTION) -> RandomForestRegressor:
    # Deep trees: caching each row's node per tree saves walking the trees again at every level.
    settings = {"numTrees": 20, "maxDepth": 17, "seed": S.SEED, "featureSubsetStrategy": "all",
                "cacheNodeIds": True, "maxMemoryInMB": 1024, "maxBins": MAX_BINS, **(params or {})}
    return RandomForestRegressor(labelCol=S.TARGET, featuresCol="features", predictionCol=prediction, **settings)


def boosting(params: dict | None = None, prediction: str = PREDICTION) -> GBTRegressor:
    settings = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "seed": S.SEED, "maxBins": MAX_BINS, **(params or {})}
    return GBTRegressor(labelCol=S.TARGET, featuresCol="features", predictionCol=prediction, **settings)


def linear_head(params: dict | None = None, prediction: str = PREDICTION) -> LinearRegression:
    settings = {"loss": "huber", "epsilon": 1.35, "regParam": 0.01, "maxIter": 50, **(params or {})}
    return LinearRegression(labelCol=S.TARGET, featuresCol="features", predictionCol=prediction, **settings)


LEARNERS: dict[str, Callable] = {"rf": forest, "gbt": boosting, "linear": linear_head}


def learner(name: str, params: dict | None = None, prediction: str = PREDICTION):
    if name not in LEARNERS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(LEARNERS))}")
    return LEARNERS[name](params, prediction)


def pipeline(name: str, columns: Sequence[str] = tuple(CONDITION_COLUMNS), params: dict | None = None) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), learner(name, params)])


@contextmanager
def training_rows(narrow: DataFrame, deal: bool = True) -> Iterator[DataFrame]:
    """The narrow feature table, persisted (memory, then local disk; lost blocks are recomputed) in as many tasks as its rows need.

    A learner passes over the rows many times. In each pass every task of a deep forest sends the counts of all open nodes, whether it
    has rows of them or not, and each of the many stages of boosting returns one result for each task: so the number of tasks
    follows the rows, not the session's shuffle setting. With ``deal`` they are dealt evenly, otherwise neighbouring partitions are joined.
    """
    most = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if most <= FEW_TASKS:  # few already, whatever the rows
        dealt = (narrow.repartition(most) if deal else narrow).persist()
        try:
            yield dealt
        finally:
            dealt.unpersist()
        return
    narrow = narrow.persist()
    try:
        tasks = min(most, max(FEW_TASKS, -(-narrow.count() // ROWS_PER_TASK)))
        dealt = (narrow.repartition(tasks) if deal else narrow.coalesce(tasks)).persist()
        try:
            yield dealt
        finally:
            dealt.unpersist()
    finally:
        narrow.unpersist()


def fit(train: DataFrame, name: str, columns: Sequence[str] = tuple(CONDITION_COLUMNS), params: dict | None = None) -> PipelineModel:
    """Fit on the annotated rows. A forest does much work per row in each pass, so its rows are dealt evenly; boosting makes many
    light passes and takes the partitions as they come."""
    narrow = train.where(F.col(S.TARGET).isNotNull()).select(S.TARGET, *columns)
    with training_rows(narrow, deal=name == "rf") as rows:
        return pipeline(name, columns, params).fit(rows)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    return model.transform(df).select(*(keep if keep is not None else df.columns), PREDICTION)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def gated_features(samples: DataFrame, scalers: DataFrame, main: str, other: str, width: int) -> DataFrame:
    """Rows with the gated array ``features``: subject vector, scaled covariates, additive vector and masks. An absent additive vector
    is all zeros, as the gate would make it."""
    scaled = M.scale_with_mask(samples, scalers)
    gated = N.gated_vector(
        F.col(main), F.col("temp_scaled"), F.coalesce(F.col(other), F.array_repeat(F.lit(0.0), width)), F.col("conc_scaled"),
        F.col("additive_mask"), F.col("conc_mask"))
    return scaled.withColumn("features", F.transform(gated, lambda x: F.coalesce(N.finite_or(x, 0.0), F.lit(0.0))))


def linear_scorer(coefficients: Sequence[float], intercept: float, batch_size: int = 64) -> Callable[..., Column]:
    """A batch scorer over numeric columns; the model object is built once per Python worker."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        weights = np.asarray(coefficients, dtype=float)

        def predict(inputs: np.ndarray) -> np.ndarray:
            return inputs.astype(float) @ weights + intercept

        return predict

    udf = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[len(coefficients)]])
    return lambda *columns: udf(F.array(*columns))


def score_table(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], np.ndarray]], schema: str,
                prediction: str = PREDICTION) -> DataFrame:
    """User model over whole Arrow batches; ``make_model`` runs once per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            yield batch.assign(**{prediction: model(batch)})

    return df.mapInPandas(run, schema)
