"""Cross-validation and model selection. Exact models run all folds in one plan; learners loop over folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import product
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from assayframe import schemas as S
from assayframe.operators import metrics as M, models, neighbors, splits
from assayframe.session import materialize

T = TypeVar("T")


def expand_grid(grid: dict[str, Sequence]) -> list[dict]:
    """Cartesian product of the value lists; an empty grid is one empty candidate."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_table(folds: DataFrame, grid: dict[str, Sequence]) -> DataFrame:
    """Every candidate for every row of ``folds``; the candidates are literals, so nothing is joined."""
    candidates = expand_grid(grid)
    structs = [F.struct(F.lit(i).alias("candidate"), *[F.lit(v).alias(k) for k, v in c.items()]) for i, c in enumerate(candidates)]
    return folds.withColumn("_c", F.explode(F.array(*structs))).select(*folds.columns, "_c.*")


def select_best(results: DataFrame, by: str = "fold", error: str = "mae", candidate: str = "candidate") -> DataFrame:
    """Least validation error per fold; on a tie the earlier candidate."""
    order = F.struct(F.col(error), F.col(candidate))
    return results.groupBy(by).agg(
        F.min_by(candidate, order).alias("best_candidate"), F.min(error).alias("best_error"))


def assign_folds(df: DataFrame, key: str, k: int = 5, bins: int = 4, target: str = S.TARGET) -> DataFrame:
    """Annotated rows with their stratum and outer fold."""
    rows = df.where(F.col(target).isNotNull())
    return splits.stratified_kfold(splits.with_quantile_bin(rows, target, bins), key, k)


def cv_mean(folded: DataFrame, k: int = 5, target: str = S.TARGET) -> DataFrame:
    """Train and test error of the mean model for every fold, from two aggregates over the rows.

    The training mean of a fold is the total minus the fold's own share, so no row is copied per fold.
    """
    sums = folded.groupBy("fold").agg(F.count(target).alias("n"), F.sum(target).alias("s"))
    per_fold = sums.agg(F.sum("n").alias("N"), F.sum("s").alias("T"), F.collect_list(F.struct("fold", "n", "s")).alias("f"))
    means = per_fold.select(F.transform("f", lambda x: F.struct(
        x["fold"].alias("model_fold"), ((F.col("T") - x["s"]) / (F.col("N") - x["n"])).alias("mean")))).scalar()
    rows = folded.select("fold", F.col(target).alias("y")).withColumn("m", F.explode(means)).select(
        F.col("m.model_fold").alias("model_fold"), "fold", "y", F.col("m.mean").alias("p"))
    scored = rows.withColumn("side", F.when(F.col("fold") == F.col("model_fold"), "test").otherwise("train"))
    return _sides(M.regression_metrics(scored, "y", "p", ["model_fold", "side"]))


def _sides(long: DataFrame) -> DataFrame:
    """(model_fold, side, mae, r2) to one row per fold."""
    pick = lambda side, m: F.max(F.when(F.col("side") == side, F.col(m))).alias(f"{side}_{m}")
    return long.groupBy(F.col("model_fold").alias("fold")).agg(
        pick("train", "mae"), pick("train", "r2"), pick("test", "mae"), pick("test", "r2"))


def cv_knn(folded: DataFrame, key: str, ks: Sequence[int] = (5,), n_folds: int = 5, target: str = S.TARGET) -> DataFrame:
    """Nested cross-validation of the neighbour model: k is chosen per fold on the inner split, then the
    outer training rows are used whole. Folds are a grouping key of one search, not a loop."""
    rows = materialize(folded.select(key, *S.CONDITIONS, target, "bin", "fold"))
    best = None
    if len(ks) > 1:
        inner = materialize(splits.nested_split(rows, key, n_folds))
        train = inner.where(F.col("part") == "train").withColumn("model_fold", F.col("outer_fold"))
        val = inner.where(F.col("part") == "val").withColumn("model_fold", F.col("outer_fold"))
        results = None
        for i, k in enumerate(ks):
            scored = neighbors.knn_predict(train, val, row_id=key, target=target, keep=[target], by=["model_fold"], k=k)
            one = M.regression_metrics(scored, target, by=["model_fold"]).select("model_fold", "mae", F.lit(i).alias("candidate"))
            results = one if results is None else results.unionByName(one)
        best = materialize(select_best(results, "model_fold"))
    copies = rows.withColumn("model_fold", F.explode(F.array(*[F.lit(i) for i in range(n_folds)])))
    outer = copies.withColumn("side", F.when(F.col("fold") == F.col("model_fold"), "test").otherwise("train"))
    train = outer.where(F.col("side") == "train")
    parts = []
    for i, k in enumerate(ks):
        ask, base = outer, train
        if best is not None:
            chosen = best.where(F.col("best_candidate") == i).select("model_fold")
            ask, base = ask.join(chosen, "model_fold", "left_semi"), base.join(chosen, "model_fold", "left_semi")
        scored = neighbors.knn_predict(base, ask, row_id=key, target=target, keep=[target, "side"], by=["model_fold"], k=k)
        parts.append(scored.withColumn("k", F.lit(k)))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    folds = _sides(M.regression_metrics(scored, target, by=["model_fold", "side"]))
    chosen_k = scored.groupBy(F.col("model_fold").alias("fold")).agg(F.min("k").alias("k"))
    return folds.join(chosen_k, "fold")


#: Fits that run side by side.
PARALLEL_FITS = 5


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], T]], parallel: int = PARALLEL_FITS) -> list[T]:
    """Run driver-side jobs at once, each in a thread with the caller's session and local properties; results in the jobs' order.

    A small fit leaves most cores idle between its many short stages, so several share them. At the first error the
    jobs that have not begun are dropped, and the error is raised.
    """
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        made = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        try:
            return [f.result() for f in made]
        except BaseException:
            for f in made:
                f.cancel()
            raise


def cv_learner(featured: DataFrame, name: str, columns: Sequence[str], grid: dict[str, Sequence] | None = None,
               key: str = "sample_id", n_folds: int = 5, target: str = S.TARGET, parallel: int = PARALLEL_FITS) -> DataFrame:
    """Nested cross-validation of a Spark learner. ``featured`` carries bin and fold. With more than one candidate each fold
    chooses its own by the error on its inner validation rows; then the fold's outer training rows are used whole.

    Every fit and every score is a distributed job; the fits of all folds and candidates run side by side.
    """
    spark = featured.sparkSession
    rows = materialize(featured.select(key, target, "bin", "fold", *columns))
    candidates = expand_grid(grid or {})
    chosen = {fold: 0 for fold in range(n_folds)}
    if len(candidates) > 1:
        inner = materialize(splits.nested_split(rows, key, n_folds))

        def validate(fold: int, i: int) -> tuple[float, int]:
            here = inner.where(F.col("outer_fold") == fold)
            model = models.fit(here.where(F.col("part") == "train"), name, columns, candidates[i])
            scored = models.score(model, here.where(F.col("part") == "val"), [target])
            return M.regression_metrics(scored, target).first()["mae"], i

        pairs = [(fold, i) for fold in range(n_folds) for i in range(len(candidates))]
        errors = side_by_side(spark, [partial(validate, *p) for p in pairs], parallel)
        for fold in range(n_folds):
            chosen[fold] = min(e for (f, _), e in zip(pairs, errors) if f == fold)[1]

    def outer(fold: int) -> list[tuple]:
        model = models.fit(rows.where(F.col("fold") != fold), name, columns, candidates[chosen[fold]])
        side = F.when(F.col("fold") == fold, "test").otherwise("train")
        scored = models.score(model, rows.withColumn("side", side), [target, "side"])
        return [(fold, r["side"], r["mae"], r["r2"]) for r in M.regression_metrics(scored, target, by=["side"]).collect()]

    out = [r for part in side_by_side(spark, [partial(outer, f) for f in range(n_folds)], parallel) for r in part]
    long = spark.createDataFrame(out, "model_fold int, side string, mae double, r2 double")
    picked = spark.createDataFrame([(f, i) for f, i in chosen.items()], "fold int, candidate int")
    return _sides(long).join(picked, "fold")
