import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayframe.functions import numeric as N
from assayframe.operators import metrics as M, selection, splits


def order(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


@pytest.fixture(scope="module")
def keys(spark):
    return [f"k{i}" for i in range(503)]


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("parts", [1, 13])
def test_rank_is_exact_on_any_layout(spark, keys, digits, parts):
    df = spark.createDataFrame([(k,) for k in keys], "sample_id string").repartition(parts)
    got = {r["sample_id"]: r["rank"] for r in splits.shuffled_rank(df, "sample_id", hex_digits=digits).collect()}
    assert got == {k: i for i, k in enumerate(order(keys))}


def test_holdout_sizes(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "sample_id string")
    size = lambda out: out.where(F.col("split") == "test").count()
    assert size(splits.holdout(df, "sample_id", 0.2)) == 100
    assert size(splits.holdout(df, "sample_id", 0.1, rounding="ceil")) == 51


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [5.0] * 40, list(np.round(np.random.default_rng(0).normal(size=997), 3)), [1.0] * 300 + [2.0, 3.0, 9.0] * 7,
    list(range(10)), [0.1, 0.1, 0.2, 0.9]])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "y double")
    got = {r["fraction"]: r["value"] for r in splits.exact_quantiles(df, "y", [0.25, 0.5, 0.75]).collect()}
    assert got == pytest.approx({q: np.quantile(values, q) for q in (0.25, 0.5, 0.75)})


@pytest.mark.parametrize("last", [1, 40, 1 << 16])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_selection_at_any_rank(spark, monkeypatch, last, seed):
    """Tiny and huge numbers of both signs, both zeros, infinities, and many ties; every pass and the early end."""
    monkeypatch.setattr(splits, "LAST_VALUES", last)
    rng = np.random.default_rng(seed)
    values = np.concatenate([
        rng.normal(size=200) * 10.0 ** rng.integers(-300, 300, 200), [0.0, -0.0, 5e-324, -5e-324, np.inf, -np.inf, 1.7e308], np.full(300, 0.1),
        np.nextafter(0.1, 1) * np.ones(50), rng.integers(-5, 5, 400).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 3, "y double").repartition(5)
    ranks = sorted({0, len(values) - 1, *rng.integers(0, len(values), 6).tolist()})
    n, found = splits.at_ranks(df, "y", lambda n: ranks)
    assert n == len(values) and found == {r: np.sort(values)[r] for r in ranks}


def test_selection_of_nothing(spark):
    empty = spark.createDataFrame([(None,), (None,)], "y double")
    assert splits.at_ranks(empty, "y", lambda n: [0]) == (0, {})
    assert splits.exact_quantiles(empty, "y", [0.5]).collect() == []
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "y double")
    n, found = splits.at_ranks(nan, "y", lambda n: range(n))
    assert (found[0], found[1]) == (1.0, np.inf) and np.isnan(found[2])


def test_order_codes_keep_the_order_and_name_the_value():
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [np.inf, -np.inf, 0.0, 1e-320]]))
    codes = splits.order_codes(values)
    assert (np.diff(codes) > 0).all() and [splits.code_value(c) for c in codes] == values.tolist()


def test_row_keys_differ_wherever_values_do(spark):
    values = [1e-7, 2e-7, 0.0, 0.01, 0.010000000000000002, 1e12, 1e12 + 1, 1e300, 25.0, 37.483921, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    keys = [r[0] for r in df.select(N.key_text(F.col("v"))).collect()]
    assert len(set(keys)) == len(values) and keys[8] == "25.000000" and keys[9] == "37.483921" and keys[10] is None


def test_bins_are_right_closed_and_drop_duplicate_edges(spark):
    values = [1.0] * 6 + [2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values], "pcmc double")
    got = {r["pcmc"]: r["bin"] for r in splits.with_quantile_bin(df).collect()}
    # edges 1, 1, 1, 2.75, 5 -> 1, 2.75, 5
    assert got == {1.0: 0, 2.0: 0, 3.0: 1, 4.0: 1, 5.0: 1}


def test_folds_are_balanced_per_bin_and_nested_parts_disjoint(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"k{i}", float(v)) for i, v in enumerate(rng.normal(size=400))], "sample_id string, pcmc double")
    folded = selection.assign_folds(df, "sample_id").cache()
    counts = folded.groupBy("bin", "fold").count().toPandas()["count"]
    assert counts.min() == counts.max() == 20
    nested = splits.nested_split(folded, "sample_id").toPandas()
    assert len(nested) == 400 * 4 and not (nested["fold"] == nested["outer_fold"]).any()
    assert not nested.duplicated(["sample_id", "outer_fold"]).any()
    assert (nested.groupby("outer_fold")["part"].apply(lambda p: (p == "val").sum()) == 64).all()


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 3.0, 2.0), ("c", None, 1.0)],
                               "g string, pcmc double, predicted_pcmc double")
    got = {r["g"]: (r["n"], r["mae"], r["r2"]) for r in M.regression_metrics(df, by=["g"]).collect()}
    assert got == {"a": (2, 0.0, 1.0), "b": (2, 0.5, 0.0), "c": (2, 1.0, 0.0)}


def test_grid_and_tie_rule(spark):
    assert selection.expand_grid({}) == [{}]
    assert len(selection.expand_grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    df = spark.createDataFrame([(0, 1, 0.5), (0, 0, 0.5), (0, 2, 0.7), (1, 2, 0.1)], "fold int, candidate int, mae double")
    assert {r["fold"]: r["best_candidate"] for r in selection.select_best(df).collect()} == {0: 0, 1: 2}


def test_scalers_without_concentration(spark):
    df = spark.createDataFrame([(20.0, None), (20.0, None)], "temperature double, additive_concentration double")
    assert tuple(M.fit_scalers(df).first()) == (20.0, 1.0, 0.0, 1.0)


def test_covariance_matches_numpy_and_constant_column(spark):
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(size=(60, 3)), np.ones(60)]
    w = rng.integers(1, 4, 60).astype(float)
    df = spark.createDataFrame([(list(map(float, r)), float(v)) for r, v in zip(x, w)], "x array<double>, w double").repartition(5)
    want = np.cov(np.repeat(x, w.astype(int), axis=0).T, bias=True)
    for standardize in (False, True):
        got = {(r["i"], r["j"]): r["cov"] for r in M.covariance(df, "x", "w", standardize=standardize).collect()}
        sd = np.where(np.diag(want) > 1e-12, np.sqrt(np.diag(want)), 1.0) if standardize else np.ones(4)
        for (i, j), v in got.items():
            assert v == pytest.approx(want[i, j] / (sd[i] * sd[j]), abs=1e-9)
