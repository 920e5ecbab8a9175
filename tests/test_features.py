"""Feature sets inside saved models: what a learner sees, and that a loaded model scores the same in another session."""

import subprocess
import sys

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from assayframe import schemas as S
from assayframe.operators import clean, evaluate, features as FT, fitted, metrics as M, models
from assayframe.plans import queries as Q
from assayframe.session import materialize

SMALL = {"numTrees": 4, "maxDepth": 6}


@pytest.fixture(scope="module")
def tables(spark, folder):
    return {k: materialize(t) for k, t in Q.molecule_tables(spark, folder).items()}


@pytest.fixture(scope="module")
def rows(spark, folder):
    return materialize(clean.annotated(Q.merged(spark, folder)).limit(500))


def test_a_forest_sees_the_sets_it_is_given(rows, tables):
    mae = {names: M.regression_metrics(fitted.score(fitted.fit(rows, "rf", names, SMALL, tables), rows)).first()["mae"]
           for names in ((), ("expert",), ("lingo",), ("chen", "descr"))}
    assert len(set(mae.values())) == 4
    table = {r["features"]: r["train_mae"] for r in Q.QUERIES["rf_feature_sets"](rows.sparkSession, "/root/testdata/sf0.001").collect()}
    assert table.keys() == {"none", "expert", "chen"} and table["expert"] != table["none"]


@pytest.mark.parametrize("model,names,params", [
    ("rf", ["expert", "lingo"], SMALL), ("linear", ["descr"], {}), ("gbt", ["chen"], {"maxIter": 2}), ("knn", [], {"k": 3}), ("mean", [], {}),
    ("constant", [], {"value": 4.5})])
def test_saved_with_its_features(rows, tables, tmp_path, model, names, params):
    made = fitted.fit(rows, model, names, params, tables)
    path = str(tmp_path / "model")
    models.save(made, path)
    bare = rows.select("sample_id", *S.CONDITIONS)
    first = {r["sample_id"]: r["predicted_pcmc"] for r in fitted.score(made, bare).collect()}
    again = {r["sample_id"]: r["predicted_pcmc"] for r in fitted.score(models.load(path), bare).collect()}
    assert first and first == again


def test_a_new_session_scores_the_same(rows, tables, tmp_path):
    made = fitted.fit(rows, "rf", ["expert", "descr"], SMALL, tables)
    models.save(made, str(tmp_path / "model"))
    bare = rows.select("sample_id", *S.CONDITIONS).orderBy("sample_id").limit(20)
    bare.coalesce(1).write.parquet(str(tmp_path / "rows"))
    program = f"""
from assayframe.session import get_session
from assayframe.operators import fitted, models
spark = get_session("other", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
scored = fitted.score(models.load({str(tmp_path / "model")!r}), spark.read.parquet({str(tmp_path / "rows")!r}))
print("RESULT", sorted((r["sample_id"], r["predicted_pcmc"]) for r in scored.collect()))
"""
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=300, cwd=".")
    line = next((x for x in done.stdout.splitlines() if x.startswith("RESULT")), done.stderr[-500:])
    wanted = sorted((r["sample_id"], r["predicted_pcmc"]) for r in fitted.score(made, bare).collect())
    assert wanted and line == f"RESULT {wanted}"


def test_entries_of_hard_rows(spark):
    schema = "sample_id string, surfactant_smiles string, temperature double, additive_smiles string, additive_concentration double"
    rows = spark.createDataFrame([
        ("a", "CCC[N+]", 20.0, "Cl", 0.5), ("b", "CCCC", None, None, None), ("c", "", float("nan"), " ", float("inf")), ("d", None, 1.0, "CCCCCC", 0.0)], schema)
    tables = {"weights": spark.createDataFrame([("CCCC", 58.0), ("", None)], "key string, value double"),
              "vectors": spark.createDataFrame([("CCCC", [1.0, float("inf"), None]), ("CCC[N+]", [0.0, 2.0, 3.0]), ("Cl", [5.0, 0.0, 6.0])], "key string, value array<double>")}
    found = {(r["sample_id"], r["feature"]): r["value"] for r in FT.entries(FT.with_features(rows, ["expert", "lingo"], tables), ["expert", "lingo"], ["sample_id"], tables).collect()}
    of = lambda k: {f: v for (s, f), v in found.items() if s == k}
    assert of("a")["tail_c_number"] == 3 and of("a")["type_cationic"] == 1 and "molecular_weight_mask" not in of("a") and of("a")["concentration"] == 0.5
    assert of("b")["molecular_weight"] == 58 and of("b")["temperature"] == 25 and not any(f.startswith("lingo_additive") for f in of("b"))
    assert sum(v for f, v in of("b").items() if f.startswith("lingo_all")) == 1
    assert of("c") == {"temperature": 25.0, "type_nonionic": 1.0}
    assert sum(v for f, v in of("d").items() if f.startswith("lingo_additive")) == 3 and of("d")["type_nonionic"] == 1
    stage = FT.Vectors(tables["vectors"], width=3)
    two = {r["sample_id"]: r["v"] for r in stage.transform(rows).select("sample_id", vector_to_array("f_descr").alias("v")).collect()}
    assert two == {"a": [0.0, 2.0, 3.0, 5.0, 0.0, 6.0, 1.0], "b": [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]}


def test_sparse_counts_hold_only_what_is_there(spark):
    rows = spark.createDataFrame([("a", "CCCCC", 1.0, None, None)], "sample_id string, surfactant_smiles string, temperature double, additive_smiles string, additive_concentration double")
    vector = FT.with_features(rows, ["lingo"]).first()["features"]
    assert type(vector).__name__ == "SparseVector" and vector.size == 4 + 512 and len(vector.indices) == 2


def test_train_test_modes(rows, tmp_path):
    other = rows.limit(50)
    path = str(tmp_path / "m")
    assert evaluate.train_test("mean", rows, path=path) is None
    sides = {r["side"]: r["n"] for r in evaluate.train_test("mean", rows, rows).collect()}
    assert sides == {"train": 400, "test": 100}
    assert [r["side"] for r in evaluate.train_test("mean", test=other, path=path).collect()] == ["test"]
    assert {r["side"] for r in evaluate.train_test("rf", rows, other, params=SMALL).collect()} == {"train", "test"}
    for bad in ({}, {"test": other}):
        with pytest.raises(ValueError):
            evaluate.train_test("mean", **bad)


def test_names(rows):
    with pytest.raises(ValueError, match="unknown feature set"):
        fitted.fit(rows, "rf", ["nothing"])
    with pytest.raises(ValueError, match="unknown model"):
        fitted.fit(rows, "nothing")
    with pytest.raises(ValueError, match="needs the table"):
        fitted.fit(rows, "rf", ["descr"])
    with pytest.warns(UserWarning, match="lingo"):
        fitted.fit(rows, "mean", ["lingo"])


def test_one_molecule_on_most_rows_keeps_its_values(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("sample_id"), F.when(F.col("id") % 10 > 0, "CC").otherwise(F.concat(F.lit("C"), F.col("id").cast("string"))).alias(S.SUBJECT),
                                    F.col("id").cast("double").alias(S.TEMPERATURE), F.lit(None).cast("string").alias(S.ADDITIVE), F.lit(None).cast("double").alias(S.CONCENTRATION))
    table = rows.select(F.col(S.SUBJECT).alias("key")).distinct().withColumn("value", F.array(F.length("key").cast("double")))
    out = FT.Vectors(table, width=1).transform(rows).select(S.SUBJECT, vector_to_array("f_descr").alias("v"))
    assert out.count() == 5000 and out.where((F.col("v")[0] != F.length(S.SUBJECT)) | (F.col("v")[2] != 0)).count() == 0
