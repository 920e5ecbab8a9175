import pytest
from pyspark.errors import PySparkException

from assayframe import schemas as S
from assayframe.operators import combine, validate
from assayframe.sources import catalog, conform, files

HEADER = "surfactant_smiles,temperature,additive_smiles,additive_concentration,pcmc\n"


def test_csv_scan_binds_by_name_and_casts(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("pcmc,surfactant_smiles,temperature,additive_smiles\n2.5,\"CC,O\",20,\n,CCO,25.5,[Na+]\n")
    df = files.read_measurements_csv(spark, str(path))
    assert df.schema == S.MEASUREMENT_SCHEMA or [f.dataType for f in df.schema] == [f.dataType for f in S.MEASUREMENT_SCHEMA]
    rows = {r["surfactant_smiles"]: r for r in df.collect()}
    assert rows["CC,O"]["pcmc"] == 2.5 and rows["CC,O"]["additive_smiles"] is None
    assert rows["CCO"]["temperature"] == 25.5 and rows["CCO"]["pcmc"] is None
    assert rows["CCO"]["additive_concentration"] is None


def test_csv_scan_rejects_malformed_numbers(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(HEADER + "CCO,warm,,,1.0\n")
    with pytest.raises(PySparkException):
        files.read_measurements_csv(spark, str(path)).collect()


def test_csv_scan_needs_the_required_columns(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("surfactant_smiles,pcmc\nCCO,1.0\n")
    with pytest.raises(ValueError, match="temperature"):
        files.read_measurements_csv(spark, str(path))


def test_prediction_sink_round_trip(spark, tmp_path):
    scored = spark.createDataFrame(
        [("CCO", 20.0, None, None, 1.5, "x")], "surfactant_smiles string, temperature double, additive_smiles string, "
        "additive_concentration double, predicted_pcmc double, extra string")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        files.write_predictions(scored, path, fmt=fmt)
        back = spark.read.option("header", True).format(fmt).load(path)
        assert back.columns == [*S.CONDITIONS, "predicted_pcmc"] and back.count() == 1


def test_inline_samples_flatten(spark):
    df = conform.inline_samples(spark, [("CCO", 20.0, ("[Na+]", 0.1)), ("CCC", 25.0, None)])
    rows = {r[0]: tuple(r) for r in df.collect()}
    assert rows["CCO"] == ("CCO", 20.0, "[Na+]", 0.1)
    assert rows["CCC"] == ("CCC", 25.0, None, None)


def test_catalog_names(spark, folder):
    with pytest.raises(ValueError, match="unknown source"):
        catalog.load(spark, folder, "nothing")
    assert catalog.load(spark, folder, "paper1").columns == S.CANONICAL
    catalog.create_views(spark, folder)
    assert spark.sql("SELECT count(*) AS n FROM everything").first()["n"] == 2454


def test_union_needs_a_source(spark):
    with pytest.raises(ValueError):
        combine.union_sources([])
    with pytest.raises(ValueError):
        combine.union_selected({}, ["paper1"])


def test_enforce_names_the_broken_rule(spark):
    good = spark.createDataFrame([("CCO", 20.0, None, None, 1.0)], S.MEASUREMENT_SCHEMA)
    assert validate.enforce(good, annotated=True).count() == 1
    bad = spark.createDataFrame([("CCO", 20.0, "[Na+]", None, 1.0)], S.MEASUREMENT_SCHEMA)
    with pytest.raises(PySparkException, match="concentration_with_additive"):
        validate.enforce(bad).collect()


def test_csv_records_are_good_or_rejected(spark, tmp_path):
    """Malformed, short, long and incomplete records, columns in another order, further columns; nothing is lost."""
    (tmp_path / "a.csv").write_text(HEADER + "CCO,20,,,1.5\nCCO,warm,,,1.0\nCC,21\n\"C,C\",22,[Na+],0.5,2.5,extra\n,23,,,1.0\n")
    (tmp_path / "b.csv").write_text("pcmc,note,temperature,surfactant_smiles\n3.5,x,24,CCC\n,y,25,CCCC\n4.5,z,,CCCCC\n")
    scanned = files.scan_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    good, rejected = files.good_and_rejected(scanned)
    assert sorted(map(tuple, good.collect()), key=str) == [
        ("CCC", 24.0, None, None, 3.5), ("CCCC", 25.0, None, None, None), ("CCO", 20.0, None, None, 1.5)]
    found = sorted((r["rejected"], r["record"]) for r in rejected.collect())
    assert [r for r, _ in found] == ["incomplete", "incomplete", "malformed", "malformed", "malformed"]
    assert "CCO,warm,,,1.0" in [t for _, t in found] and "CC,21" in [t for _, t in found]
    assert good.columns == S.MEASUREMENT_SCHEMA.fieldNames()


def test_csv_scan_of_a_file_without_a_required_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("surfactant_smiles,pcmc\nCCO,1.0\n")
    with pytest.raises(ValueError, match="temperature"):
        files.scan_csv(spark, str(tmp_path / "a.csv"))


def test_observed_load_counts_in_the_same_pass(spark):
    rows = spark.createDataFrame([("CCO", 20.0, "[Na+]", None, 1.0), ("CC", 21.0, None, None, None)], S.MEASUREMENT_SCHEMA)
    seen_rows, seen = validate.observed(rows, annotated=True)
    assert seen_rows._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # no scan of its own
    assert seen_rows.count() == 2
    assert validate.broken(seen) == {"concentration_with_additive": 1, "target_not_null": 1}
    with pytest.raises(ValueError, match=r"concentration_with_additive \(1 rows\)"):
        validate.check(seen)
    good_rows, good = validate.observed(rows.where("pcmc IS NULL"))
    good_rows.collect()
    validate.check(good)


def test_strict_load_fails_where_a_constraint_is_broken(spark, folder):
    assert catalog.load(spark, folder, "paper1", strict=True).count() > 0
    with pytest.raises(PySparkException, match="concentration_with_additive"):
        catalog.load(spark, folder, "lab", strict=True).collect()
