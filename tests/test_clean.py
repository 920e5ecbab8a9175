import hashlib
import math
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayframe.functions import encode as E, grams, numeric as N, text as X
from assayframe.operators import clean, combine


def test_parse_number(spark):
    df = spark.createDataFrame([("UNK",), ("1,5",), ("2.5",), ("x",), (None,)], "t string")
    plain = [r[0] for r in df.select(N.parse_number(F.col("t"))).collect()]
    comma = [r[0] for r in df.select(N.parse_number(F.col("t"), decimal_comma=True)).collect()]
    assert plain == [None, None, 2.5, None, None]
    assert comma == [None, 1.5, 2.5, None, None]
    with pytest.raises(PySparkException):
        df.select(N.parse_number_strict(F.col("t"))).collect()


def test_blank_keeps_the_original_text(spark):
    df = spark.createDataFrame([("  ",), ("",), (" a.",), (None,)], "t string")
    assert [r[0] for r in df.select(X.blank_to_null(F.col("t"))).collect()] == [None, None, " a.", None]
    assert [r[0] for r in df.select(X.normalize_key(F.col("t"))).collect()][2] == "a"


def test_fill_mean_ignores_missing_and_leaves_an_empty_column_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "temperature double")
    assert sorted(r[0] for r in clean.fill_mean(df).collect()) == [1.0, 1.5, 2.0]
    none = spark.createDataFrame([(None,)], "temperature double")
    assert clean.fill_mean(none).first()[0] is None


def test_infinite_and_nan(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(N.finite_or(F.col("v"), 0.0)).collect()] == [0.0, 0.0, None, 1.0, None]


def test_merge_mean_groups_nulls_and_keeps_all_null_groups(spark):
    rows = [("a", 20.0, None, None, 1.0), ("a", 20.0, None, None, 3.0), ("a", 20.0, "x", 0.1, None), ("b", 20.0, None, None, None)]
    df = spark.createDataFrame(rows, "surfactant_smiles string, temperature double, additive_smiles string, additive_concentration double, pcmc double")
    out = {(r[0], r[2]): r["pcmc"] for r in combine.merge_mean(df).collect()}
    assert out == {("a", None): 2.0, ("a", "x"): None, ("b", None): None}


def test_replicates_single_row_has_zero_spread_and_first_skips_nulls(spark):
    schema = ("sample_id string, surfactant_smiles string, counterion string, additive_smiles string, additive_concentration double, "
              "temperature double, tail_c_number smallint, surfactant_type string, molecular_weight double, cmc double, pcmc double")
    rows = [("2", "CC.Na", "Na", None, None, 20.0, 2, "ionic", 1.0, 0.1, 1.0), ("1", "CC.Na", "Na", None, None, 20.0, None, "other", 2.0, 0.3, 3.0),
            ("3", "C", None, None, None, 20.0, 1, "t", 1.0, None, 4.0)]
    out = {r["surfactant_smiles"]: r for r in combine.aggregate_replicates(spark.createDataFrame(rows, schema)).collect()}
    pair = out["CC.Na"]
    assert (pair["tail_c_number"], pair["surfactant_type"], pair["pcmc"], pair["smiles_no_counterion"]) == (2, "other", 2.0, "CC")
    assert pair["pcmc_std"] == pytest.approx(math.sqrt(2))
    assert out["C"]["pcmc_std"] == 0.0 and out["C"]["cmc"] is None and out["C"]["cmc_std"] == 0.0


def test_subject_class_precedence(spark):
    texts = {"CC[O-].[N+]": "zwitterionic", "CC(=O)[O-]": "anionic", "C[NH3+]": "cationic", "CCO": "nonionic", "C[NH2+]C": "cationic"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", X.subject_class(F.col("t"))).collect()} == texts


def test_drop_known_treats_null_as_a_value(spark):
    test = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "surfactant_smiles string, i int")
    train = spark.createDataFrame([("a",), (None,)], "surfactant_smiles string")
    assert [r["i"] for r in combine.drop_known(test, train).collect()] == [3]
    spaced = spark.createDataFrame([(" a.", 1)], "surfactant_smiles string, i int")
    assert combine.drop_known(spaced, train).count() == 1
    assert combine.drop_known(spaced, train, normalize=True).count() == 0


@pytest.mark.parametrize("text", ["", "abc", "abcd", "aé😀b\nc" * 3, "xy" * 9000, "z" * 8195])
def test_qgrams_cover_the_whole_text(spark, text):
    expected = [text[i:i + 4] for i in range(len(text) - 3)]
    df = spark.createDataFrame([(1, text)], "k int, t string")
    pieces = df.select(F.explode(X.overlapping_pieces(F.col("t"), 3)).alias("p"))
    grams = [g for r in pieces.select(X.qgrams(F.col("p"))).collect() for g in r[0]]
    assert sorted(grams) == sorted(expected)
    assert (E.qgram_counts(df, "k", "t").agg(F.sum("n")).first()[0] or 0) == len(expected)


def test_one_hot_learned_null_level_and_unseen(spark):
    train = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "c string")
    asked = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    out = {r["c"]: (r["level_index"], r["n_levels"]) for r in E.one_hot_learned(asked, train, "c").collect()}
    assert out["z"] == (None, 3) and {out["a"][0], out[None][0]} < {0, 1, 2} and out["a"][0] != out[None][0]
    dense = E.one_hot_learned(asked, train, "c").select("c", E.dense_one_hot(F.col("level_index"), 3).alias("v")).collect()
    assert {r["c"]: sum(r["v"]) for r in dense} == {"a": 1.0, None: 1.0, "z": 0.0}


def test_feature_columns_skip_text_and_target(spark):
    df = spark.createDataFrame([("a", 1.0, 2, 3.0)], "s string, x double, i int, pcmc double")
    assert E.feature_columns(df) == ["x", "i"]


def test_qgram_counts_of_repeated_null_and_empty_keys(spark, monkeypatch):
    """Against a plain count: keys in several rows and batches, null as a key, no row for texts without a gram. One task adds up the
    counts of a bounded number of rows, whatever the shuffle setting."""
    texts = [(i % 7 or None, t) for i, t in enumerate(["abcabcabc", "é😀b\nc\0d" * 5, "", None, "abc", "xyz " * 3000, "中文字符 abcd"] * 9)]
    expected = Counter((k, int(hashlib.md5(t[i:i + 4].encode()).hexdigest()[:8], 16) % 256)
                       for k, t in texts if t is not None for i in range(len(t) - 3))
    df = spark.createDataFrame(texts, "k int, t string")
    for rows_per_batch in ("10000", "2"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
        try:
            assert {(r["k"], r["bucket"]): r["n"] for r in E.qgram_counts(df, "k", "t").collect()} == expected
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(E, "KEYS_PER_TASK", 2)
    out = E.qgram_counts(df, "k", "t")
    assert out.schema.simpleString() == "struct<k:int,bucket:int,n:bigint>"
    assert out.rdd.getNumPartitions() == 32


@pytest.mark.parametrize("size", [1, 10**9])
def test_grams_are_named_by_table_or_by_sorting(monkeypatch, size):
    monkeypatch.setattr(grams, "TABLE", size)
    text = "the cat sat on the mat, the cat sat"
    assert grams.buckets_of(text, 4, 256, {}).tolist() == [
        int(hashlib.md5(text[i:i + 4].encode()).hexdigest()[:8], 16) % 256 for i in range(len(text) - 3)]
