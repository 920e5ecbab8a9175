import numpy as np
import pandas as pd
import pytest

from assayframe.operators import neighbors as NB

DIMS = ["a", "b", "c"]


def brute(queries, rows, k, by=()):
    out = {}
    for _, q in queries.iterrows():
        near = rows
        for col in by:
            near = near[near[col] == q[col]]
        if near.empty:
            continue
        d2 = ((near[DIMS].to_numpy(float) - q[DIMS].to_numpy(float)) ** 2).sum(axis=1)
        d2 = np.round(np.round(d2, 9) + np.where(near["cat"] == q["cat"], 0.0, 2.0), 9)
        best = near.assign(d2=d2).sort_values(["d2", "id"]).head(k)
        out[q["query_id"]] = best["v"].mean()
    return out


def fixture(seed, n=150, m=80, spread=6, folds=1):
    rng = np.random.default_rng(seed)
    make = lambda size: pd.DataFrame({
        "a": rng.integers(0, spread, size).astype(float), "b": rng.integers(0, 40, size) * 2.5,
        "c": np.round(rng.random(size) * 0.1, 2), "cat": rng.choice(["", "x", "y"], size, p=[0.6, 0.3, 0.1]),
        "fold": rng.integers(0, folds, size)})
    rows = make(n)
    rows["id"] = [f"r{i:05d}" for i in rng.permutation(n)]
    rows["v"] = rng.random(n)
    # a hot point with a third of the rows, and far away rows
    rows.loc[: n // 3, ["a", "b", "c", "cat"]] = [3.0, 50.0, 0.05, "x"]
    rows.loc[n - 2:, "b"] = 900.0
    queries = make(m)
    queries["query_id"] = [f"q{i}" for i in range(m)]
    queries.loc[m - 3:, "cat"] = "never seen"
    queries.loc[m - 2:, "b"] = -300.0
    return queries, rows


def run(spark, queries, rows, k, by):
    out = NB.estimate(spark.createDataFrame(queries), NB.lowest(spark.createDataFrame(rows), [*by, *DIMS, "cat"], "id", k),
                      by=by, dims=DIMS, category="cat", value="v", row_id="id", k=k)
    return {r["query_id"]: r["estimate"] for r in out.collect()}


@pytest.mark.parametrize("seed,k", [(1, 5), (2, 1), (3, 9)])
def test_equals_brute_force(spark, seed, k):
    queries, rows = fixture(seed)
    got, want = run(spark, queries, rows, k, []), brute(queries, rows, k)
    assert got.keys() == want.keys()
    assert all(got[q] == pytest.approx(want[q], abs=1e-12) for q in want)


def test_groups_stay_apart_and_may_be_smaller_than_k(spark):
    queries, rows = fixture(7, folds=3)
    rows = pd.concat([rows[rows["fold"] == 0], rows[rows["fold"] == 1].head(3)])
    got, want = run(spark, queries, rows, 5, ["fold"]), brute(queries, rows, 5, ["fold"])
    assert got.keys() == want.keys() and len(got) < len(queries)
    assert all(got[q] == pytest.approx(want[q], abs=1e-12) for q in want)


def test_grid_on_continuous_values(spark):
    rng = np.random.default_rng(11)
    rows = pd.DataFrame(rng.normal(0, 20, (300, 3)), columns=DIMS)
    rows["a"] = np.where(rng.random(300) < 0.4, rng.normal(5, 1e-3, 300), rows["a"])
    rows = rows.assign(cat="", id=[f"{i:04d}" for i in range(300)], v=rng.random(300))
    queries = pd.DataFrame(rng.normal(0, 25, (100, 3)), columns=DIMS).assign(cat="", query_id=[f"q{i}" for i in range(100)])
    got, want = run(spark, queries, rows, 5, []), brute(queries, rows, 5)
    assert all(got[q] == pytest.approx(want[q], abs=1e-12) for q in want)


def test_one_far_outlier_and_a_row_far_from_zero(spark):
    queries, rows = fixture(13)
    rows.loc[5, "a"] = 1e9
    rows.loc[6, "b"] = -1e15
    queries.loc[0, "a"] = 9e8
    got, want = run(spark, queries, rows, 4, []), brute(queries, rows, 4)
    assert got.keys() == want.keys()
    assert all(got[q] == pytest.approx(want[q], abs=1e-12) for q in want)


def test_cells_follow_the_bulk_of_the_data(spark):
    points = [(float(i % 50),) for i in range(999)]
    narrow = NB.cell_levels(*[spark.createDataFrame(points + more, "a double") for more in ([], [(1e9,)])], ["a"])
    assert 2.0 ** narrow[0] <= 1 and 2.0 ** narrow[-1] >= 1e9 and len(narrow) < 20


@pytest.mark.parametrize("name", ["*", "", "x"])
def test_a_category_may_have_any_name(spark, name):
    queries, rows = fixture(17)
    queries["cat"], rows["cat"] = queries["cat"].replace("y", name), rows["cat"].replace("y", name)
    got, want = run(spark, queries, rows, 5, []), brute(queries, rows, 5)
    assert all(got[q] == pytest.approx(want[q], abs=1e-12) for q in want)


def test_predict_without_any_concentration(spark):
    schema = "sample_id string, surfactant_smiles string, temperature double, additive_smiles string, additive_concentration double, pcmc double"
    train = spark.createDataFrame([("1", "CC", 20.0, None, None, 1.0), ("2", "CCCC", 20.0, None, None, 3.0)], schema)
    out = NB.knn_predict(train, train, keep=["sample_id"], k=1).collect()
    assert {r["sample_id"]: r["predicted_pcmc"] for r in out} == {"1": 1.0, "2": 3.0}


def test_rows_without_a_temperature_get_no_prediction(spark):
    schema = "sample_id string, surfactant_smiles string, temperature double, additive_smiles string, additive_concentration double, pcmc double"
    train = spark.createDataFrame([("1", "CC", 20.0, "x", 0.1, 1.0), ("2", "CCCC", 20.0, "x", float("inf"), 3.0)], schema)
    asked = spark.createDataFrame([("q", "CC", None, "x", 0.1, None), ("r", "CC", 20.0, "x", float("nan"), None)], schema)
    out = NB.knn_predict(train, asked, keep=["sample_id"], k=1).collect()
    assert {r["sample_id"]: r["predicted_pcmc"] for r in out} == {"q": None, "r": 1.0}


def test_rows_without_a_target_are_never_chosen(spark):
    schema = "sample_id string, surfactant_smiles string, temperature double, additive_smiles string, additive_concentration double, pcmc double"
    train = spark.createDataFrame([("a", "CCC", 20.0, None, None, None), ("b", "CCCC", 20.0, None, None, 2.0)], schema)
    asked = spark.createDataFrame([("q", "CCC", 20.0, None, None, None)], schema)
    assert [r.predicted_pcmc for r in NB.knn_predict(train, asked, keep=["sample_id"], k=1).collect()] == [2.0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_queries_far_outside_the_data(spark, seed):
    """On one or more sides, near and far, against dense and sparse tables: as brute force."""
    queries, rows = fixture(seed + 20, n=400, m=90)
    rng = np.random.default_rng(seed)
    rows.loc[len(rows) - 2:, "b"] = 50.0
    for d, at in (("a", 40.0), ("b", 500.0), ("c", 3.0)):
        some = rng.random(len(queries)) < 0.4
        queries.loc[some, d] = rng.choice([-at, at, 3 * at], some.sum())
    got, want = run(spark, queries, rows, 5, []), brute(queries, rows, 5)
    assert got.keys() == want.keys()
    assert all(got[q] == pytest.approx(want[q], abs=1e-12) for q in want)


def test_far_queries_meet_few_rows(spark):
    """A dense table and queries beyond its end: the pairs formed are few, as for queries inside."""
    rows = pd.DataFrame([(float(a), float(b), 0.0, "", f"r{a:03d}{b:03d}", 1.0) for a in range(60) for b in range(60)], columns=[*DIMS, "cat", "id", "v"])
    queries = pd.DataFrame([(float(a), b, 0.0, "", f"q{a}{b}") for a in range(0, 60, 10) for b in (-300.0, 30.0, 90.0, 5000.0)], columns=[*DIMS, "cat", "query_id"])
    q, r = spark.createDataFrame(queries), spark.createDataFrame(rows)
    near = NB.candidates(q.select("query_id", "cat", *DIMS), r, by=["cat"], dims=DIMS, k=5, levels=NB.cell_levels(q, r, DIMS), query_id="query_id", carry=["id"])
    counts = near.groupBy("query_id").count().toPandas()["count"]
    assert len(counts) == len(queries) and counts.max() < 200
