import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from assayframe import schemas as S
from assayframe.functions import numeric as N
from assayframe.operators import clean, metrics as M, models, pca, profile, robust, selection
from assayframe.plans import queries as Q
from assayframe.session import materialize
from assayframe.sources import catalog


@pytest.fixture(scope="module")
def train(spark, folder):
    return materialize(models.condition_features(clean.annotated(catalog.everything(spark, folder)).limit(400)))


def mae(df):
    return M.regression_metrics(df).first()["mae"]


@pytest.mark.parametrize("name,params", [("rf", {"numTrees": 5, "maxDepth": 8}), ("gbt", {"maxIter": 5}), ("linear", {})])
def test_learners_beat_or_match_the_mean_and_survive_saving(train, tmp_path, name, params):
    model = models.fit(train, name, params=params)
    scored = models.score(model, train)
    if name != "linear":
        assert mae(scored) < mae(models.predict_mean(train, train))
    models.save(model, str(tmp_path / name))
    again = models.score(models.load(str(tmp_path / name)), train)
    assert scored.select("predicted_pcmc").toPandas().equals(again.select("predicted_pcmc").toPandas())


def test_nested_selection_of_a_learner_chooses_per_fold(spark, folder):
    """Side by side or one after the other: the same folds, choices and errors; a hopeless candidate is never chosen."""
    rows = models.condition_features(selection.assign_folds(clean.annotated(Q.merged(spark, folder)).limit(300), "sample_id"))
    rows = materialize(rows.withColumn(S.TARGET, F.col("x_carbons") * 0.1))  # a depth of one cannot follow it
    grid = {"maxDepth": [1, 6], "numTrees": [2]}
    run = lambda parallel: sorted(map(tuple, selection.cv_learner(rows, "rf", models.CONDITION_COLUMNS, grid, parallel=parallel).collect()))
    together = run(5)
    assert len(together) == 5 and {r[-1] for r in together} == {1} and together == run(1)


def test_jobs_side_by_side(spark):
    done = selection.side_by_side(spark, [lambda i=i: spark.range(i).count() for i in range(7)], 3)
    assert done == list(range(7))
    with pytest.raises(ZeroDivisionError):
        selection.side_by_side(spark, [lambda: 1 // 0, lambda: 2], 2)


def test_unknown_model():
    with pytest.raises(ValueError, match="unknown model"):
        models.learner("nothing")


def test_default_settings():
    rf, gbt = models.forest(), models.boosting()
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getSeed(), rf.getFeatureSubsetStrategy()) == (20, 17, 42, "all")
    assert (gbt.getMaxIter(), gbt.getSeed()) == (100, 42)
    assert models.forest({"numTrees": 3}).getNumTrees() == 3


def test_table_scorer_builds_its_model_per_partition(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    out = models.score_table(df, lambda: (lambda batch: batch["x"] * 2), "x double, predicted_pcmc double")
    assert sorted(r["predicted_pcmc"] for r in out.collect()) == [2.0 * i for i in range(10)]


def test_embedding_head_scores_every_described_row(spark, folder):
    out = Q.QUERIES["predict_embedding_head"](spark, folder).toPandas()
    assert len(out) and out["predicted_pcmc"].notna().all() and out["sample_id"].is_unique


def test_huber(spark):
    df = spark.createDataFrame([(0.2,), (-0.5,), (2.0,)], "e double")
    assert [r[0] for r in df.select(N.huber(F.col("e"))).collect()] == pytest.approx([0.02, 0.125, 0.875])


def test_profile_grid(spark):
    df = spark.createDataFrame([("CC", 99.0), ("CCC", 99.0)], "surfactant_smiles string, temperature double")
    out = profile.grid(df, profile.linspace(0, 100, 20)).toPandas()
    assert len(out) == 40 and out["temperature"].min() == 0.0 and out["temperature"].max() == 100.0


def test_pca_invariants(spark, folder):
    rows, fitted = Q.fitted_pca(spark, folder)
    scores = pca.scores(rows, "features", fitted, ["sample_id"]).toPandas()
    z = scores[[f"PC{i + 1}" for i in range(10)]].to_numpy()
    assert np.allclose(z.mean(axis=0), 0, atol=1e-8)
    cov = np.cov(z.T, bias=True)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-6)
    ratio = [r["ratio"] for r in pca.variance(rows, fitted).collect()]
    assert ratio == sorted(ratio, reverse=True) and 0 < sum(ratio) <= 1 + 1e-9
    load = pca.loadings(rows, fitted).toPandas().set_index("feature").loc[fitted.names].to_numpy()
    assert np.allclose(np.linalg.norm(load, axis=0), 1)
    assert (load[np.abs(load).argmax(axis=0), range(10)] > 0).all()
    table = pca.standardize(rows, "features")
    x = np.stack(table.select("sample_id", "features").toPandas().set_index("sample_id").loc[scores["sample_id"], "features"])
    assert np.allclose(x @ load, z, atol=1e-8)
    assert Q.QUERIES["top_loadings"](spark, folder).groupBy("component").count().toPandas()["count"].tolist() == [12, 12]


@pytest.mark.parametrize("block", [4, 9, 256])
def test_pca_of_a_block_equals_all_directions(spark, block):
    """Blocks narrower than the vector, missing and infinite entries, an empty and a constant position, a large offset."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 30)) * 3 + rng.normal(size=(300, 30)) * 0.2 + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8] = np.nan, 5.0
    x[3, 2] = np.inf
    names = [f"f{i}" for i in range(30)]
    df = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r],) for r in x] + [(None,)], "v array<double>").repartition(4)
    fitted = pca.fit(df, "v", names, 4, exclude=["f0"], block=block)
    x[3, 2] = np.nan
    keep = [i for i in range(1, 30) if i != 7]
    filled = np.where(np.isnan(x[:, keep]), np.nanmean(x[:, keep], axis=0), x[:, keep])
    sd = filled.std(axis=0)
    z = (filled - filled.mean(axis=0)) / np.where(sd > 1e-6, sd, 1.0)
    values = np.sort(np.linalg.eigvalsh(z.T @ z / len(z)))[::-1]
    assert fitted.names == [names[i] for i in keep] and np.allclose(fitted.values, values[:4], atol=1e-6) and fitted.total == pytest.approx(values.sum())
    assert (fitted.residuals < 1e-6).all() and (fitted.passes == 1) == (block == 256)
    scored = pca.scores(df, "v", fitted, [])
    assert scored.count() == 300
    assert all(abs(v) < 1e-6 for r in pca.checks(scored, fitted).collect() for v in r[1:])


def test_pca_of_nothing_and_unknown_names(spark):
    empty = spark.createDataFrame([(None,)], "v array<double>")
    with pytest.raises(ValueError, match="no vectors"):
        pca.fit(empty, "v", ["a"])
    with pytest.raises(ValueError, match="unknown columns"):
        pca.fit(spark.createDataFrame([([1.0],)], "v array<double>"), "v", ["a"], exclude=["b"])
    assert pca.standardize(empty, "v").collect() == [(None,)]


def test_standardize_drops_empty_positions_and_survives_constants(spark):
    rows = [([1.0, None, 5.0, 1.0],), ([2.0, None, 5.0, None],), ([4.0, None, 5.0, float("inf")],)]
    df = spark.createDataFrame(rows, "v array<double>")
    out = np.array([r["v"] for r in pca.standardize(df, "v").collect()])
    assert out.shape == (3, 3) and np.allclose(out[:, 1], 0) and np.allclose(out[:, 2], 0)
    assert out[:, 0].std() == pytest.approx(1) and out[:, 0].mean() == pytest.approx(0)
    raw = np.array([r["v"] for r in pca.standardize(df, "v", scale=False).collect()])
    assert sorted(raw[:, 0]) == pytest.approx([-4 / 3, -1 / 3, 5 / 3])


def huber_rows(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=(n, 3)), np.ones(n), np.zeros(n)]
    y = x[:, :3] @ [1.0, -2.0, 0.5] + 3 + rng.standard_t(1.5, n)
    return x, y, spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)] + [(None, 1.0), ([0.0] * 5, None)], "features array<double>, pcmc double").repartition(3)


def test_huber_head_is_optimal_and_robust(spark, tmp_path):
    x, y, df = huber_rows(spark)
    head = robust.fit(df, "features", steps=200)
    loss = lambda w, b: np.where(np.abs(r := y - x @ w - b) <= 0.5, r * r / 2, 0.5 * (np.abs(r) - 0.25)).mean()
    best = loss(head.weights, head.intercept)
    for i in range(5):
        for step in (1e-3, -1e-3):
            moved = head.weights.copy()
            moved[i] += step
            assert loss(moved, head.intercept) >= best - 1e-9
    assert np.abs(robust.gradient(df, "features", head) + np.append(robust.RIDGE * head.weights, 0)).max() < 1e-8
    assert np.allclose(head.weights[:3], [1.0, -2.0, 0.5], atol=0.25)
    model = PipelineModel([robust.LinearHead(head)])
    models.save(model, str(tmp_path / "head"))
    again = models.load(str(tmp_path / "head")).transform(df.dropna()).toPandas()
    assert np.allclose(again["predicted_pcmc"], np.stack(again["features"]) @ head.weights + head.intercept)


def test_huber_steps_equal_plain_reweighting(spark):
    x, y, df = huber_rows(spark)
    wide, at = np.c_[x, np.ones(len(x))], np.zeros(6)
    for step in range(4):
        r = np.abs(y - wide @ at)
        w = np.ones(len(y)) if step == 0 else np.minimum(1, 0.5 / r)
        at = np.linalg.solve((wide * w[:, None]).T @ wide + robust.RIDGE * len(y) * np.diag([1] * 5 + [0]), wide.T @ (w * y))
    head = robust.fit(df, "features", steps=4)
    assert np.allclose(np.append(head.weights, head.intercept), at, atol=1e-8) and head.steps == 4


def test_huber_of_nothing(spark):
    with pytest.raises(ValueError, match="no rows"):
        robust.fit(spark.createDataFrame([], "features array<double>, pcmc double"), "features")


@pytest.mark.parametrize("deal", [True, False])
def test_tasks_of_a_fit_follow_the_rows_and_not_the_shuffle_setting(spark, monkeypatch, deal):
    rows = spark.range(0, 3000, 1, 40).selectExpr("id * 1.0 AS pcmc", "id % 7 * 1.0 AS x")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        with models.training_rows(rows, deal) as few:
            assert few.rdd.getNumPartitions() == models.FEW_TASKS
            assert few.agg(F.count("x"), F.sum("pcmc")).first()[:] == (3000, 3000 * 2999 / 2)
        monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
        with models.training_rows(rows, deal) as more:
            assert more.rdd.getNumPartitions() == 30
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
