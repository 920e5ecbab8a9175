"""Named queries: (spark, folder) -> DataFrame. Each one applies library operators to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayframe import schemas as S
from assayframe.functions import encode as E, numeric as N, text as X
from assayframe.operators import (
    clean, combine, evaluate, features as FT, metrics as M, models, neighbors, pca, predlog, profile, robust, selection, splits, validate,
)
from assayframe.session import materialize, shared_folder, spread
from assayframe.sources import catalog, conform, files, standins as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FP_WIDTH = 64
KNN_GRID = (3, 5)
RF_GRID = {"maxDepth": [8, 17], "numTrees": [20]}
CONSTANT_GRID = (4.0, 4.5, 4.6, 5.0)
DUMMY_VALUE = 4.5
LINEAR_WEIGHTS = (0.05, 0.01, 0.5)
LINEAR_INTERCEPT = 2.0
PROFILE_TEMPERATURES = profile.linspace(0, 100, 20)
SWEEP_TEMPERATURES = profile.linspace(20, 60, 21)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: N.r6(F.col(c)) for c in columns})


def sample_key() -> F.Column:
    """A text key of a merged row, from its four conditions."""
    return F.concat_ws(
        "|", S.SUBJECT, N.key_text(F.col(S.TEMPERATURE)), F.coalesce(S.ADDITIVE, F.lit("-")),
        F.coalesce(N.key_text(F.col(S.CONCENTRATION)), F.lit("-")))


def merged(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.everything(spark, folder).withColumn("sample_id", sample_key())


def merged_annotated(spark: SparkSession, folder: str) -> DataFrame:
    """Merged rows with a target, written once: several operators read them again."""
    return materialize(clean.annotated(merged(spark, folder)))


def lab_samples(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drop_incomplete(V.lab(spark, folder))


def described(spark: SparkSession, folder: str) -> DataFrame:
    """Clean rows with the descriptor vector of their molecule."""
    return combine.attach(V.meas(spark, folder), V.descr(spark, folder), "mol_id")


# Scans and conforming


@query
def scan_lab(spark, folder):
    return rounded(V.lab(spark, folder).select("sample_id", *S.CANONICAL), S.TARGET)


@query
def conform_paper1(spark, folder):
    return rounded(conform.paper1(V.paper1(spark, folder)), S.TARGET)


@query
def conform_paper4(spark, folder):
    return rounded(conform.paper4(V.paper4(spark, folder)), S.TARGET)


@query
def conform_expert(spark, folder):
    return rounded(catalog.expert(spark, folder), S.TARGET)


@query
def conform_drop_policy(spark, folder):
    return rounded(conform.expert_by_drop(V.expert_raw(spark, folder)), S.TARGET)


@query
def flatten_samples(spark, folder):
    keyed = V.lab(spark, folder)
    nested = conform.nest_samples(keyed)
    return conform.flatten_samples(nested)


@query
def canonical_projection(spark, folder):
    raw = V.meas(spark, folder).withColumnRenamed(S.SUBJECT, "smiles").withColumn("extra", F.col("mol_id") + 1)
    return rounded(conform.canonical(raw, {"smiles": S.SUBJECT}), S.TARGET)


@query
def csv_round_trip(spark, folder):
    """Laboratory rows written as three CSV folders and loaded again: one as it is, one with its columns in another order and some
    temperatures that are no numbers, one with records that end early or lack the subject. Good rows, and rejected ones by reason."""
    rows = V.lab(spark, folder).select("mol_id", *S.CANONICAL)
    base = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    kind, odd = F.col("mol_id") % 3, F.col("mol_id") % 7 == 0
    files.write_table(rows.where(kind == 0).select(*S.CANONICAL), f"{base}/a", "csv")
    turned = rows.where(kind == 1).withColumn(S.TEMPERATURE, F.when(odd, F.lit("warm")).otherwise(F.col(S.TEMPERATURE).cast("string")))
    files.write_table(turned.select(*reversed(S.CANONICAL)), f"{base}/b", "csv")
    head = f"{S.SUBJECT},{S.TEMPERATURE},{S.TARGET}"
    text = lambda *c: F.concat_ws(",", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    ending = rows.where(kind == 2).withColumn(S.SUBJECT, F.when(F.col("mol_id") % 11 != 0, F.col(S.SUBJECT)))
    lines = ending.select(F.when(odd, text(S.SUBJECT, S.TEMPERATURE)).otherwise(text(S.SUBJECT, S.TEMPERATURE, S.TARGET)).alias(head))
    lines.write.option("header", True).option("quote", "\u0000").option("escapeQuotes", False).option("sep", "\u0001").csv(f"{base}/c")
    good, rejected = files.good_and_rejected(files.scan_csv(spark, [f"{base}/a", f"{base}/b", f"{base}/c"]))
    both = good.withColumn("rejected", F.lit(None).cast("string")).unionByName(
        rejected.select("rejected"), allowMissingColumns=True)
    return rounded(both, S.TARGET).groupBy("rejected", *S.CANONICAL).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def load_violations(spark, folder):
    """Broken constraints of every source, counted while it is read."""
    out = []
    for name in sorted(catalog.SOURCES):
        rows, seen = catalog.load_observed(spark, folder, name)
        rows.write.format("noop").mode("overwrite").save()
        out += [(name, rule, n) for rule, n in seen.get.items()]
    return spark.createDataFrame(out, "source string, rule string, n long")


# Cleaning


@query
def clean_sentinel_numeric(spark, folder):
    return V.meas_raw(spark, folder).select(
        "sample_id", N.parse_number(F.col("temp_raw")).alias("temperature"),
        N.parse_number(F.col("conc_raw")).alias("concentration"))


@query
def clean_decimal_comma(spark, folder):
    return V.meas_raw(spark, folder).select(
        "sample_id", N.parse_number(F.col("temp_raw"), decimal_comma=True).alias("temperature"),
        N.parse_number(F.col("conc_raw"), decimal_comma=True).alias("concentration"))


@query
def clean_blank_to_null(spark, folder):
    return V.meas_raw(spark, folder).select("sample_id", X.blank_to_null(F.col("additive_raw")).alias(S.ADDITIVE))


@query
def drop_null_subset(spark, folder):
    return clean.drop_null(V.meas_raw(spark, folder), clean.REQUIRED_RAW).select(
        "sample_id", "tail_raw", "molecular_weight", "surfactant_type")


@query
def drop_incomplete_additive(spark, folder):
    return clean.drop_incomplete(V.meas(spark, folder)).select("sample_id", S.ADDITIVE, S.CONCENTRATION)


@query
def fill_global_mean(spark, folder):
    return clean.fill_mean(V.meas(spark, folder)).select("sample_id", S.TEMPERATURE)


@query
def fill_constant(spark, folder):
    return clean.fill_constant(V.meas(spark, folder)).select("sample_id", S.TEMPERATURE)


@query
def clean_infinities(spark, folder):
    kind = F.col("mol_id") % 7
    value = (
        F.when(kind == 0, F.lit(float("inf"))).when(kind == 1, F.lit(float("-inf")))
        .when(kind == 2, F.lit(float("nan"))).otherwise(F.col(S.TARGET))
    )
    return V.meas(spark, folder).withColumn("v", value).select(
        "sample_id", N.r6(N.finite_or(F.col("v"), 0.0)).alias("as_zero"),
        N.r6(N.finite_or(F.col("v"), None)).alias("as_null"))


@query
def cleaning_funnel(spark, folder):
    return clean.cleaning_funnel(V.expert_raw(spark, folder)).select(
        F.col("step").cast("int").alias("step"), "rule", F.col("n_rows").cast("bigint").alias("n_rows"))


@query
def annotated_only(spark, folder):
    return rounded(clean.annotated(V.meas(spark, folder)).select("sample_id", *S.CANONICAL), S.TARGET)


@query
def missing_only(spark, folder):
    return clean.missing(V.meas(spark, folder)).select("sample_id", *S.CONDITIONS)


@query
def schema_violations(spark, folder):
    return validate.violations(V.meas(spark, folder), annotated=True)


# Joins


@query
def dedup_against_train(spark, folder):
    kept = combine.drop_known(V.lab(spark, folder), V.meas(spark, folder))
    return rounded(kept.select("sample_id", *S.CANONICAL), S.TARGET)


@query
def leakage_report(spark, folder):
    return combine.leakage_report(V.lab(spark, folder), V.meas(spark, folder))


@query
def attach_descriptors_inner(spark, folder):
    fp = F.col("fp")
    return described(spark, folder).select(
        "sample_id", "mol_id", N.r6(F.get(fp, F.lit(0))).alias("fp_first"),
        N.r6(F.get(fp, F.lit(FP_WIDTH - 1))).alias("fp_last"),
        N.r6(F.aggregate(fp, F.lit(0.0), lambda a, x: a + x)).alias("fp_sum"))


def two_roles(spark, folder):
    samples = V.meas(spark, folder).withColumn(
        "additive_mol_id", F.when(F.col(S.ADDITIVE).isNotNull(), F.col("mol_id") % 97))
    return combine.attach_two_roles(samples, V.descr(spark, folder), "mol_id", "additive_mol_id", "mol_id", "fp")


@query
def attach_descriptors_two_role(spark, folder):
    out = two_roles(spark, folder).select(
        "sample_id", "mol_id", "additive_mol_id", F.col("fp_additive").isNull().alias("additive_absent"),
        *[F.transform(c, N.r6).alias(c) for c in ("fp_all", "fp_additive")])
    return E.expand_vector(E.expand_vector(out, "fp_all", FP_WIDTH, "fp_all"), "fp_additive", FP_WIDTH, "fp_additive")


@query
def features_by_distinct_key(spark, folder):
    c = F.col(S.SUBJECT)
    return combine.features_by_distinct(V.meas(spark, folder), S.SUBJECT, {
        "tail_c_number": X.leading_run_length(c), "carbons": X.count_char(c), "surfactant_class": X.subject_class(c),
    }).select("sample_id", S.SUBJECT, "tail_c_number", "carbons", "surfactant_class")


def lab_profiles(spark, folder):
    return lab_samples(spark, folder).select(S.SUBJECT, S.ADDITIVE, S.CONCENTRATION).distinct()


@query
def profile_grid(spark, folder):
    return profile.grid(lab_profiles(spark, folder), PROFILE_TEMPERATURES)


@query
def observed_points_nullsafe(spark, folder):
    asked = lab_samples(spark, folder).select(S.SUBJECT, S.ADDITIVE).distinct()
    points = catalog.everything(spark, folder).select(S.SUBJECT, S.ADDITIVE, S.TEMPERATURE, S.TARGET)
    found = combine.observed_points(asked, points, [S.SUBJECT, S.ADDITIVE])
    return rounded(found, "observed_pcmc")


# Aggregation


@query
def merge_mean(spark, folder):
    parts = [catalog.paper1(spark, folder), catalog.paper4(spark, folder), catalog.lab(spark, folder)]
    return rounded(combine.merge_mean(combine.union_sources(parts)), S.TARGET)


@query
def aggregate_replicates(spark, folder):
    out = combine.aggregate_replicates(clean.clean_replicates(V.expert_raw(spark, folder)))
    return out.withColumns({
        "tail_c_number": F.col("tail_c_number").cast("int"),
        # molar values are small: keep twelve places of them
        "cmc": F.round("cmc", 12), "cmc_std": F.round("cmc_std", 12),
        S.TARGET: N.r6(F.col(S.TARGET)), "pcmc_std": N.r6(F.col("pcmc_std")),
    })


@query
def aggregate_targets(spark, folder):
    rows = clean.clean_replicates(V.expert_raw(spark, folder)).select(
        "sample_id", S.SUBJECT, S.TEMPERATURE, S.ADDITIVE, S.CONCENTRATION, "surfactant_type", "cmc", S.TARGET)
    out = combine.aggregate_targets(rows, [S.SUBJECT, S.TEMPERATURE], ["cmc", S.TARGET], "sample_id")
    return out.withColumns({"cmc": F.round("cmc", 12), S.TARGET: N.r6(F.col(S.TARGET))})


@query
def merged_everything(spark, folder):
    return rounded(catalog.everything(spark, folder), S.TARGET)


def lab_by_mean(spark, folder):
    train = clean.annotated(V.meas(spark, folder))
    return models.predict_mean(train, lab_samples(spark, folder))


METRICS = ("mae", "mse", "rmse", "r2")


@query
def regression_metrics(spark, folder):
    return rounded(M.regression_metrics(lab_by_mean(spark, folder)), *METRICS)


@query
def residuals_by_class(spark, folder):
    scored = lab_by_mean(spark, folder).withColumn("surfactant_class", X.subject_class(F.col(S.SUBJECT)))
    return rounded(M.regression_metrics(scored, by=["surfactant_class"]), *METRICS)


def folded_merged(spark, folder):
    return selection.assign_folds(merged_annotated(spark, folder), "sample_id")


CV_METRICS = ("train_mae", "train_r2", "test_mae", "test_r2")


@query
def cv_summary(spark, folder):
    out = M.fold_summary(selection.cv_mean(folded_merged(spark, folder)), CV_METRICS)
    return rounded(out, *out.columns)


@query
def target_summary(spark, folder):
    rows = V.meas(spark, folder).withColumn("surfactant_class", X.subject_class(F.col(S.SUBJECT)))
    parts = [M.numeric_summary(rows, c, ["surfactant_class"]).withColumn("measure", F.lit(c)) for c in (S.TARGET, S.TEMPERATURE)]
    return rounded(combine.union_sources(parts), "min", "max", "mean", "std")


@query
def fit_scalers(spark, folder):
    out = M.fit_scalers(clean.annotated(V.meas(spark, folder)))
    return rounded(out, *out.columns)


def validation_pool(spark, folder):
    """Training rows, and training and laboratory rows under one schema, marked by side."""
    train = merged_annotated(spark, folder).select("sample_id", *S.CANONICAL)
    test = materialize(lab_samples(spark, folder).select("sample_id", *S.CANONICAL))
    return train, evaluate.both_sides(train, test)


@query
def experiment_table(spark, folder):
    train, pool = validation_pool(spark, folder)
    configs = [("constant", {"value": DUMMY_VALUE}), ("mean", {}), ("knn", {"k": 5})]
    rows = [evaluate.experiment_row(train, pool, model, params, train_set="everything", test_set="lab") for model, params in configs]
    return rounded(combine.union_sources(rows), *CV_METRICS)


@query
def feature_covariance(spark, folder):
    # Features depend on the molecule alone: count rows per molecule first, then weight its vector.
    weights = V.meas(spark, folder).groupBy("mol_id").agg(F.count(F.lit(1)).alias("w"))
    return rounded(M.covariance(weights.join(V.descr(spark, folder), "mol_id"), "fp", "w"), "cov")


# Sorting, sets


@query
def log_newest_first(spark, folder):
    return predlog.newest_first(V.predlog(spark, folder))


@query
def union_sources(spark, folder):
    parts = [catalog.expert(spark, folder), catalog.paper1(spark, folder), catalog.paper4(spark, folder)]
    return rounded(combine.union_sources(parts), S.TARGET)


@query
def union_selected_sources(spark, folder):
    bare = V.paper1(spark, folder).select(
        F.col("smiles").alias(S.SUBJECT), F.col("T").alias(S.TEMPERATURE), F.col("pCMC").alias(S.TARGET))
    named = {"expert": conform.expert_by_drop(V.expert_raw(spark, folder)), "paper1": bare,
             "paper4": catalog.paper4(spark, folder)}
    return rounded(combine.union_selected(named, ["expert", "paper1"]), S.TARGET)


@query
def distinct_molecules(spark, folder):
    return combine.distinct_keys(V.meas(spark, folder), S.SUBJECT, S.SUBJECT)


# Splits and selection


@query
def holdout_split(spark, folder):
    rows = clean.annotated(V.meas(spark, folder)).select("sample_id")
    return splits.holdout(rows, "sample_id", 0.2)


@query
def holdout_split_ceil(spark, folder):
    rows = clean.annotated(V.meas(spark, folder)).select("sample_id")
    return splits.holdout(rows, "sample_id", 0.1, rounding="ceil")


@query
def kfold_assign(spark, folder):
    return splits.kfold(clean.annotated(V.meas(spark, folder)).select("sample_id"), "sample_id")


@query
def quantile_bins(spark, folder):
    rows = clean.annotated(V.meas(spark, folder)).select("sample_id", S.TARGET)
    return splits.with_quantile_bin(rows).select("sample_id", "bin")


@query
def stratified_kfold(spark, folder):
    return folded_merged(spark, folder).select("sample_id", "bin", "fold")


@query
def nested_split(spark, folder):
    folded = materialize(folded_merged(spark, folder).select("sample_id", "bin", "fold"))
    return splits.nested_split(folded, "sample_id").select("sample_id", "outer_fold", "part")


@query
def param_grid(spark, folder):
    rows = splits.kfold(clean.annotated(V.meas(spark, folder)).select("sample_id"), "sample_id")
    folds = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))
    return selection.grid_table(folds, {"k": [3, 5, 9], "max_depth": [8, 17]})


@query
def select_best_candidate(spark, folder):
    folded = materialize(folded_merged(spark, folder).select("sample_id", S.TARGET, "bin", "fold"))
    val = splits.nested_split(folded, "sample_id").where(F.col("part") == "val").withColumn("fold", F.col("outer_fold"))
    candidates = selection.grid_table(val.select("fold", S.TARGET), {"value": list(CONSTANT_GRID)})
    errors = M.regression_metrics(candidates, S.TARGET, "value", by=["fold", "candidate"]).withColumn("mae", N.r6(F.col("mae")))
    return selection.select_best(errors)


@query
def cv_mean_baseline(spark, folder):
    return rounded(selection.cv_mean(folded_merged(spark, folder)), *CV_METRICS)


@query
def cv_knn(spark, folder):
    return rounded(selection.cv_knn(folded_merged(spark, folder), "sample_id", KNN_GRID), *CV_METRICS)


@query
def cv_rf(spark, folder):
    featured = models.condition_features(folded_merged(spark, folder))
    return selection.cv_learner(featured, "rf", models.CONDITION_COLUMNS, RF_GRID)


# Functions and encoders


@query
def leading_run_length(spark, folder):
    return V.mol(spark, folder).select("mol_id", X.leading_run_length(F.col("smiles")).alias("tail_c_number"))


@query
def classify_by_substring(spark, folder):
    return V.mol(spark, folder).select("mol_id", X.subject_class(F.col("smiles")).alias("surfactant_class"))


@query
def strip_counterion(spark, folder):
    return V.mol(spark, folder).select("mol_id", X.first_part(F.col("smiles")).alias("smiles_no_counterion"))


@query
def count_char(spark, folder):
    return V.mol(spark, folder).select("mol_id", X.count_char(F.col("smiles")).alias("carbons"))


@query
def unit_conversions(spark, folder):
    rows = V.meas_raw(spark, folder).where(F.col("cmc").isNotNull())
    return rows.select(
        "sample_id", N.r6(N.neg_log10(F.col("cmc"))).alias("from_molar"),
        N.r6(N.from_neg_log10(F.col(S.TARGET)) * 1e6).alias("micromolar"),
        N.r6(N.log_micro_to_neg_log(F.log10(F.col("cmc") * 1e6))).alias("from_log_micro"))


@query
def format_prediction(spark, folder):
    p = F.col(S.TARGET)
    return lab_samples(spark, folder).select(
        "sample_id", F.round(p, 4).alias("predicted_pcmc"), N.scientific(N.from_neg_log10(p)).alias("predicted_cmc_m"))


@query
def presence_masks(spark, folder):
    return V.meas_raw(spark, folder).select(
        "sample_id", N.text_mask(F.col("additive_raw")).alias("additive_mask"),
        N.number_mask(N.parse_number(F.col("conc_raw"))).alias("conc_mask"))


@query
def scale_with_mask(spark, folder):
    scalers = M.fit_scalers(clean.annotated(V.meas(spark, folder)))
    out = M.scale_with_mask(V.lab(spark, folder), scalers)
    return rounded(out, "temp_scaled", "conc_scaled").select("sample_id", "temp_scaled", "conc_scaled", "additive_mask", "conc_mask")


@query
def gated_feature_vector(spark, folder):
    rows = two_roles(spark, folder).withColumn("fp_additive", F.coalesce("fp_additive", F.array_repeat(F.lit(0.0), FP_WIDTH)))
    scaled = M.scale_with_mask(rows, M.fit_scalers(V.meas(spark, folder)))
    vector = N.gated_vector(F.col("fp_all"), F.col("temp_scaled"), F.col("fp_additive"), F.col("conc_scaled"),
                            F.col("additive_mask"), F.col("conc_mask"))
    return scaled.withColumn("v", vector).select(
        "sample_id", F.size("v").alias("width"), N.r6(F.get("v", F.lit(0))).alias("first"),
        N.r6(F.get("v", F.lit(FP_WIDTH))).alias("temp"), N.r6(F.get("v", F.lit(FP_WIDTH + 1))).alias("additive_first"),
        N.r6(F.get("v", F.lit(2 * FP_WIDTH + 1))).alias("conc"),
        N.r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query
def one_hot_fixed(spark, folder):
    cls = F.when(F.col("mol_id") % 50 != 1, X.subject_class(F.col("smiles")))
    return V.mol(spark, folder).withColumns(E.one_hot_fixed(cls, S.SUBJECT_CLASSES, "type")).select(
        "mol_id", *[f"type_{level}" for level in [*S.SUBJECT_CLASSES, "nan"]])


@query
def one_hot_learned(spark, folder):
    return E.one_hot_learned(V.lab(spark, folder), V.meas(spark, folder), S.ADDITIVE).select(
        "sample_id", F.col("level_index").cast("bigint").alias("level_index"), "n_levels")


@query
def expand_vector_columns(spark, folder):
    joined = V.mol(spark, folder).select("mol_id").join(V.descr(spark, folder), "mol_id", "left")
    wide = E.expand_vector(joined, "fp", FP_WIDTH, "fp_all")
    return rounded(wide, *[f"fp_all_{i}" for i in range(FP_WIDTH)])


@query
def qgram_fingerprint(spark, folder):
    mols = V.mol(spark, folder).select("mol_id", "smiles")  # a file of millions of short rows is read by few tasks
    return E.qgram_counts(mols.repartition(E.key_tasks(mols, "mol_id")), "mol_id", "smiles")


@query
def qgram_documents(spark, folder):
    return E.qgram_counts(V.wide_table(spark, folder, "documents"), "doc_id", "text")


@query
def expert_features(spark, folder):
    weights = V.mol(spark, folder).select("mol_id", "molecular_weight")
    rows = E.expert_features(V.meas(spark, folder)).join(weights, "mol_id")
    return rows.select("sample_id", "tail_c_number", "surfactant_class", N.r6(F.col("molecular_weight")).alias("molecular_weight"))


@query
def descriptor_set(spark, folder):
    broken = V.descr(spark, folder).withColumn("fp", F.transform("fp", lambda x, i: F.when(
        (F.col("mol_id") % 25 == 0) & (i == 3), F.lit(float("inf"))).otherwise(x)))
    rows = combine.attach(V.meas(spark, folder), broken, "mol_id").withColumn("fp", E.clean_vector(F.col("fp")))
    return E.expand_vector(rows.select("sample_id", F.transform(F.slice("fp", 1, 19), N.r6).alias("fp")), "fp", 19, "descr")


KNOWN_ADDITIVE = "[Na+].[Cl-]"


def molecule_tables(spark, folder, wanted=("weights", "vectors")):
    """Weight and vector of each molecule text, of the lowest molecule number that has them; one additive has a vector too."""
    mols = V.mol(spark, folder).select(F.col("smiles").alias("key"), "mol_id", F.col("molecular_weight").alias("value"))
    first = lambda df: df.join(df.groupBy("key").agg(F.min("mol_id").alias("mol_id")), ["key", "mol_id"]).select("key", "value")
    tables = {"weights": first(mols)} if "weights" in wanted else {}
    if "vectors" in wanted:
        # Read four times below: written, so that the molecules are joined (and perhaps sent to the driver for it) once.
        vectors = materialize(mols.select("key", "mol_id").join(V.descr(spark, folder).withColumnRenamed("fp", "value"), "mol_id"))
        of_additive = vectors.groupBy(F.lit(KNOWN_ADDITIVE).alias("key")).agg(F.min("mol_id").alias("mol_id")).join(
            vectors.select("mol_id", "value"), "mol_id").select("key", "value")
        tables["vectors"] = first(vectors).unionByName(of_additive)
    return tables


SET_TABLES = {"expert": "weights", "descr": "vectors", "chen": "vectors"}


def feature_entries(spark, folder, names):
    """A lookup reads its samples twice, and each set looks up again: samples and tables are written, so that what is below runs once."""
    tables = molecule_tables(spark, folder, {SET_TABLES[n] for n in names if n in SET_TABLES})
    tables = {k: materialize(t) for k, t in tables.items()}
    featured = FT.with_features(materialize(V.lab(spark, folder)), names, tables)
    return rounded(FT.entries(featured, names, ["sample_id"], tables), "value")


@query
def features_expert_lingo(spark, folder):
    return feature_entries(spark, folder, ["expert", "lingo"])


@query
def features_descr_chen(spark, folder):
    return feature_entries(spark, folder, ["descr", "chen"])


IMPUTED = [S.TEMPERATURE, S.CONCENTRATION, S.TARGET]


@query
def impute_mean(spark, folder):
    return rounded(E.impute_mean(V.meas(spark, folder), IMPUTED).select("sample_id", *IMPUTED), *IMPUTED)


@query
def impute_knn(spark, folder):
    rows = materialize(neighbors.collapse_rows(clean.annotated(merged(spark, folder)), row_id="sample_id", target=S.TARGET))
    asked = neighbors.knn_features(V.lab(spark, folder), ["sample_id"]).where(F.col("conc").isNull())
    filled = neighbors.impute_concentration(rows, asked)
    return asked.join(filled, ["carbons", "temp", "additive"]).select("sample_id", F.col("_filled").alias("conc_imputed"))


# Learning and scoring


@query
def predict_constant(spark, folder):
    return models.predict_constant(lab_samples(spark, folder), DUMMY_VALUE).select("sample_id", "predicted_pcmc")


@query
def predict_mean(spark, folder):
    return rounded(lab_by_mean(spark, folder).select("sample_id", "predicted_pcmc"), "predicted_pcmc")


@query
def predict_knn(spark, folder):
    train = clean.annotated(merged(spark, folder))
    return rounded(neighbors.knn_predict(train, lab_samples(spark, folder), keep=["sample_id"]), "predicted_pcmc")


def fitted_learner(spark, folder, name, params=None):
    return models.fit(models.condition_features(clean.annotated(catalog.everything(spark, folder))), name, params=params)


@query
def predict_rf(spark, folder):
    return models.score(fitted_learner(spark, folder, "rf"), models.condition_features(lab_samples(spark, folder)), ["sample_id"])


@query
def predict_gbt(spark, folder):
    return models.score(fitted_learner(spark, folder, "gbt"), models.condition_features(lab_samples(spark, folder)), ["sample_id"])


def head_rows(samples, folder, scalers):
    """Samples with the gated vector of both roles: an additive without a vector is gated off."""
    spark = samples.sparkSession
    other = F.when(F.col(S.ADDITIVE).isNotNull(), F.col("mol_id") % 97)
    both = combine.attach_two_roles(samples.withColumn("additive_mol_id", other), V.descr(spark, folder), "mol_id", "additive_mol_id", "mol_id", "fp")
    return models.gated_features(both, scalers, "fp_all", "fp_additive", FP_WIDTH)


def fitted_head(spark, folder):
    train = clean.annotated(V.meas(spark, folder))
    scalers = materialize(M.fit_scalers(train))
    rows = materialize(head_rows(train, folder, scalers))
    return rows, robust.fit(rows, "features"), scalers


@query
def predict_embedding_head(spark, folder):
    _, head, scalers = fitted_head(spark, folder)
    return head_rows(lab_samples(spark, folder), folder, scalers).select("sample_id", head.predicted("features").alias("predicted_pcmc"))


@query
def embedding_head_optimum(spark, folder):
    """The mean gradient of the loss at the fitted head, entry by entry: zero, up to what the ridge holds back."""
    rows, head, _ = fitted_head(spark, folder)
    flat = robust.gradient(rows, "features", head) + np.append(robust.RIDGE * head.weights, 0.0)
    return spark.createDataFrame([(i, round(float(g), 6) + 0.0) for i, g in enumerate(flat)], "entry int, gradient double")


@query
def huber_loss(spark, folder):
    scored = lab_by_mean(spark, folder).withColumn("surfactant_class", X.subject_class(F.col(S.SUBJECT)))
    return scored.groupBy("surfactant_class").agg(
        N.r6(F.avg(N.huber(F.col(S.TARGET) - F.col("predicted_pcmc"), 0.5))).alias("huber"))


@query
def predict_missing(spark, folder):
    rows = materialize(catalog.everything(spark, folder))
    model = models.fit(models.condition_features(clean.annotated(rows)), "rf")
    return models.score(model, models.condition_features(clean.missing(rows)), S.CONDITIONS)


@query
def predict_missing_knn(spark, folder):
    rows = materialize(merged(spark, folder))
    scored = neighbors.knn_predict(clean.annotated(rows), clean.missing(rows), keep=S.CONDITIONS)
    return rounded(scored, "predicted_pcmc")


@query
def score_batch_udf(spark, folder):
    scorer = models.linear_scorer(LINEAR_WEIGHTS, LINEAR_INTERCEPT)
    return lab_samples(spark, folder).select(
        "sample_id", N.r6(scorer(
            X.count_char(F.col(S.SUBJECT)).cast("double"), F.col(S.TEMPERATURE),
            F.coalesce(S.CONCENTRATION, F.lit(0.0)))).alias("predicted_pcmc"))


@query
def external_validation_knn(spark, folder):
    train, pool = validation_pool(spark, folder)
    return rounded(evaluate.side_metrics(train, pool, "knn"), *METRICS)


@query
def external_validation_rf(spark, folder):
    train, pool = validation_pool(spark, folder)
    return evaluate.side_metrics(train, pool, "rf")


@query
def train_test_modes(spark, folder):
    """The same table split, two tables, and a model that was saved by a training alone and is loaded by a test alone."""
    everything = merged_annotated(spark, folder).select("sample_id", *S.CANONICAL)
    lab = materialize(lab_samples(spark, folder).select("sample_id", *S.CANONICAL))
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    evaluate.train_test("mean", everything, path=path)
    modes = {"split": evaluate.train_test("mean", everything, everything), "two": evaluate.train_test("mean", everything, lab),
             "saved": evaluate.train_test("mean", test=lab, path=path)}
    parts = [df.select(F.lit(name).alias("mode"), "side", "n", *METRICS) for name, df in modes.items()]
    return rounded(combine.union_sources(parts), *METRICS)


RF_SETS = ([], ["expert"], ["chen"])
RF_SMALL = {"numTrees": 5, "maxDepth": 8}


@query
def rf_feature_sets(spark, folder):
    """Errors of a small forest on the conditions alone and with named feature sets."""
    train, pool = validation_pool(spark, folder)
    tables = {k: materialize(t) for k, t in molecule_tables(spark, folder).items()}
    rows = [evaluate.experiment_row(train, pool, "rf", RF_SMALL, features=f, train_set="everything", test_set="lab", tables=tables) for f in RF_SETS]
    return rounded(combine.union_sources(rows), *CV_METRICS)


@query
def profile_knn(spark, folder):
    swept = profile.grid(lab_profiles(spark, folder), PROFILE_TEMPERATURES)
    train = clean.annotated(merged(spark, folder))
    return rounded(neighbors.knn_predict(train, swept, keep=[*S.CONDITIONS, "step"]), "predicted_pcmc")


@query
def sweep_with_observed(spark, folder):
    keys = [S.SUBJECT, S.ADDITIVE, S.CONCENTRATION]
    train = merged_annotated(spark, folder)
    swept = profile.grid(lab_profiles(spark, folder), SWEEP_TEMPERATURES)
    scored = neighbors.knn_predict(train, swept, keep=[*keys, "step"])
    summary = profile.sweep_summary(scored.withColumns(profile.band(F.col("predicted_pcmc"))), keys)
    points = combine.observed_points(
        lab_samples(spark, folder).select(S.SUBJECT, S.ADDITIVE).distinct(),
        train.select(S.SUBJECT, S.ADDITIVE, S.TARGET), [S.SUBJECT, S.ADDITIVE])
    seen = points.groupBy(S.SUBJECT, F.col(S.ADDITIVE).alias("_a")).agg(
        F.count(F.lit(1)).alias("n_observed"), F.avg("observed_pcmc").alias("observed_mean"))
    left, right = summary.alias("l"), seen.withColumnRenamed(S.SUBJECT, "_s").alias("r")
    out = left.join(right, (F.col(S.SUBJECT) == F.col("_s")) & F.col(S.ADDITIVE).eqNullSafe(F.col("_a")), "left")
    out = out.drop("_s", "_a").withColumn("n_observed", F.coalesce("n_observed", F.lit(0)))
    return rounded(out, "min_pcmc", "max_pcmc", "mean_pcmc", "observed_mean")


@query
def sweep_curve(spark, folder):
    """The rows behind a sweep's picture: the predicted curve of each profile with its band, and the measured points of its molecule and
    additive at their own temperatures."""
    keys = [S.SUBJECT, S.ADDITIVE, S.CONCENTRATION]
    train, profiles = merged_annotated(spark, folder), materialize(lab_profiles(spark, folder))
    scored = neighbors.knn_predict(train, profile.grid(profiles, SWEEP_TEMPERATURES), keep=[*keys, S.TEMPERATURE])
    curve = scored.withColumns(profile.band(F.col("predicted_pcmc"))).select(
        *keys, F.lit("curve").alias("kind"), S.TEMPERATURE, F.col("predicted_pcmc").alias("value"), "band_low", "band_high")
    points = combine.observed_points(profiles, train.select(S.SUBJECT, S.ADDITIVE, S.TEMPERATURE, S.TARGET), [S.SUBJECT, S.ADDITIVE])
    seen = points.select(*keys, F.lit("observed").alias("kind"), F.col("observed_temperature").alias(S.TEMPERATURE), F.col("observed_pcmc").alias("value"))
    return rounded(curve.unionByName(seen, allowMissingColumns=True), "value", "band_low", "band_high")


@query
def predictions_sink(spark, folder):
    """Predictions for the rows without a target, written by the sink and read back."""
    rows = materialize(catalog.everything(spark, folder))
    path = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    files.write_predictions(models.predict_mean(clean.annotated(rows), clean.missing(rows)), path)
    return rounded(spark.read.parquet(path), "predicted_pcmc")


@query
def ablation_table(spark, folder):
    rows = merged_annotated(spark, folder).select("sample_id", S.SUBJECT, S.TARGET)
    known = V.mol(spark, folder).join(V.descr(spark, folder), "mol_id", "left_semi").select(F.col("smiles").alias(S.SUBJECT)).distinct()
    # A feature set acts on an exact model only through the rows it keeps.
    sets = {"none": rows, "expert": E.expert_features(rows), "descr": rows.join(known, S.SUBJECT, "left_semi")}
    parts = []
    for name, kept in sets.items():
        folds = materialize(selection.assign_folds(kept.select("sample_id", S.TARGET), "sample_id"))
        mean = M.fold_summary(selection.cv_mean(folds), ["test_mae", "test_r2"])
        flat = models.predict_constant(folds, DUMMY_VALUE)
        constant = M.fold_summary(
            M.regression_metrics(flat, by=["fold"]).select(F.col("mae").alias("test_mae"), F.col("r2").alias("test_r2")),
            ["test_mae", "test_r2"])
        parts += [mean.select(F.lit(name).alias("features"), F.lit("mean").alias("model"), "*"),
                  constant.select(F.lit(name).alias("features"), F.lit("constant").alias("model"), "*")]
    return rounded(combine.union_sources(parts), "test_mae_mean", "test_mae_std", "test_r2_mean", "test_r2_std")


# Principal components


PCA_COLUMNS = [S.TEMPERATURE, S.CONCENTRATION, "carbons", *[f"fp_{i}" for i in range(FP_WIDTH)]]


def feature_rows(spark, folder):
    """Described rows with one feature array: the two conditions, the carbon count, the descriptors."""
    return described(spark, folder).select(
        "sample_id", *S.CANONICAL, F.concat(
            F.array(S.TEMPERATURE, S.CONCENTRATION, X.count_char(F.col(S.SUBJECT)).cast("double")), "fp").alias("features"))


@query
def standardize_features(spark, folder):
    out = pca.standardize(materialize(feature_rows(spark, folder).select("sample_id", "features")), "features")
    return out.select("sample_id", *[N.r6(F.get("features", F.lit(i))).alias(c) for i, c in enumerate(PCA_COLUMNS)])


PCA_KEEP = ["sample_id", S.TARGET, S.TEMPERATURE, S.CONCENTRATION]


def fitted_pca(spark, folder, **options):
    """Rows with a target, and the components fitted on them."""
    rows = materialize(spread(clean.annotated(feature_rows(spark, folder))))
    return rows, pca.fit(rows, "features", PCA_COLUMNS, **options)


def checked_pca(spark, folder, **options):
    rows, fitted_ = fitted_pca(spark, folder, **options)
    out = pca.checks(pca.scores(rows, "features", fitted_, ["sample_id"]), fitted_)
    return out.select("component", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "other", "variance_gap", "residual")])


@query
def pca_scores(spark, folder):
    rows, fitted_ = fitted_pca(spark, folder)
    return pca.scores(rows, "features", fitted_, PCA_KEEP)


@query
def pca_checks(spark, folder):
    return checked_pca(spark, folder)


@query
def pca_checks_excluded_unscaled(spark, folder):
    """The two conditions left out, positions centred only."""
    return checked_pca(spark, folder, exclude=[S.TEMPERATURE, S.CONCENTRATION], scale=False)


@query
def pca_total_variance(spark, folder):
    """The whole variance of the centred features, and how many take part, with and without the conditions."""
    rows = materialize(spread(clean.annotated(feature_rows(spark, folder))))
    out = []
    for name, exclude in (("all", []), ("descriptors", PCA_COLUMNS[:3])):
        fitted_ = pca.fit(rows, "features", PCA_COLUMNS, 2, exclude=exclude, scale=False)
        out.append((name, len(fitted_.names), round(fitted_.total, 5)))
    return spark.createDataFrame(out, "features string, n_features int, variance double")


@query
def pca_loadings(spark, folder):
    return pca.loadings(*fitted_pca(spark, folder))


@query
def pca_variance(spark, folder):
    return pca.variance(*fitted_pca(spark, folder))


@query
def top_loadings(spark, folder):
    return pca.top_loadings(pca.loadings(*fitted_pca(spark, folder)))


# Prediction log


def event_log(spark, folder):
    scored = V.table(spark, folder, "events").withColumn("p", F.col("value") / 100)
    return predlog.log_rows(scored, log_id="event_id", ts="ts", prediction="p", carry=["user_id"])


@query
def prediction_log(spark, folder):
    return predlog.formatted(event_log(spark, folder))


LOGGED_AT = "2024-01-01 12:00:00"


@query
def prediction_log_inputs(spark, folder):
    """Scored samples as log rows with their four inputs, appended in two parts and read as one log."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    scored = lab_by_mean(spark, folder).withColumn("at", F.lit(LOGGED_AT))
    rows = predlog.log_rows(scored, log_id="sample_id", ts="at", prediction="predicted_pcmc")
    first = F.col(S.ADDITIVE).isNull()
    for part in (first, ~first):
        predlog.append(rows.where(part), path)
    return predlog.formatted(predlog.read(spark, path))


@query
def merge_feedback(spark, folder):
    grade = F.col("event_id") % 5
    edits = V.table(spark, folder, "events").where(F.col("event_id") % 3 == 0).select(
        F.col("event_id").cast("string").alias("id"),
        F.when(grade == 0, "Good").when(grade == 1, "Overestimated").when(grade == 2, "Wrong")
        .when(grade == 3, "Bad").otherwise("Underestimated").alias("feedback"),
        (F.col("value") / 10).alias("actual_pcmc"))
    return rounded(predlog.formatted(predlog.merge_feedback(event_log(spark, folder), edits)), "actual_pcmc")


@query
def log_drift(spark, folder):
    return rounded(predlog.drift(V.predlog(spark, folder), ["input_key"]), "spread")
