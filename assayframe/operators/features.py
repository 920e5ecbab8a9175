"""Feature sets by name, as pipeline stages that are saved inside the model they feed.

A set adds vector columns to sample rows; an assembler puts the chosen sets end to end. Sets that look up a precomputed value of a
molecule carry their table: it is written beside the stage and comes back with it, so a loaded model scores bare sample rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import Column, DataFrame, functions as F

from assayframe import schemas as S
from assayframe.functions import encode as E, numeric as N, text as X
from assayframe.operators.skew import skew_join

LINGO_Q = 4
LINGO_BUCKETS = 256
CHEN_WIDTH = 19


class FeatureStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage made from column expressions only; its parameters are saved with it."""


class _TableWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        if self.instance.table is not None:
            self.instance.table.write.parquet(os.path.join(path, "table"))


class _TableReader(DefaultParamsReader):
    def load(self, path: str) -> KeyedStage:
        stage = super().load(path)
        if stage.getOrDefault(stage.hasTable):
            stage.table = self.sparkSession.read.parquet(os.path.join(path, "table"))
        return stage


class KeyedStage(Transformer, MLReadable, MLWritable):
    """A stage with a table, one row for each key; without one nothing is found."""

    hasTable = Param(Params._dummy(), "hasTable", "whether a table is saved with the stage", TypeConverters.toBoolean)

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table
        self._setDefault(hasTable=False)
        self._set(hasTable=table is not None)

    def write(self) -> _TableWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> _TableReader:
        return _TableReader(cls)

    def looked_up(self, dataset: DataFrame, key: Column, into: str, how: str) -> DataFrame:
        """``dataset`` with the value of its key. One key, or null, may hold most of the rows: they are dealt over many tasks."""
        if self.table is None:
            return dataset.withColumn(into, F.lit(None).cast("double"))
        keyed = dataset.withColumn("_key", key)
        right = self.table.select(F.col("key").alias("_key"), F.col("value").alias(into))
        if dataset.isStreaming:
            return keyed.join(right, "_key", how).drop("_key")
        return skew_join(keyed, right, ["_key"], how, salt_by=[c for c in S.CONDITIONS if c in dataset.columns]).drop("_key")


class Conditions(FeatureStage):
    """What was set in the measurement: temperature and concentration, with masks for what was absent."""

    names = ["temperature", "concentration", "concentration_mask", "additive_mask"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        conc = N.finite_or(F.col(S.CONCENTRATION), None)
        return dataset.withColumn("f_conditions", array_to_vector(F.array(
            F.coalesce(N.finite_or(F.col(S.TEMPERATURE), None), F.lit(S.DEFAULT_TEMPERATURE)), F.coalesce(conc, F.lit(0.0)),
            N.number_mask(conc), N.text_mask(F.col(S.ADDITIVE)))))


class Expert(KeyedStage):
    """Tail length and charge class from the identifier, molecular weight from the table (0 and no mask where it is not known)."""

    names = ["tail_c_number", *[f"type_{x}" for x in [*S.SUBJECT_CLASSES, "nan"]], "molecular_weight", "molecular_weight_mask"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        subject = F.col(S.SUBJECT)
        hot = E.one_hot_fixed(X.subject_class(subject), S.SUBJECT_CLASSES, "type")
        weight = N.finite_or(F.col("_weight"), None)
        return self.looked_up(dataset, subject, "_weight", "left").withColumn("f_expert", array_to_vector(F.array(
            F.coalesce(X.leading_run_length(subject).cast("double"), F.lit(0.0)), *[c.cast("double") for c in hot.values()],
            F.coalesce(weight, F.lit(0.0)), N.number_mask(weight)))).drop("_weight")


class Vectors(KeyedStage):
    """A precomputed vector of the subject, without which a row disappears, and of the additive where ``both`` roles are asked
    for: missing and infinite entries are 0, and a mask tells an additive without a vector apart."""

    first = Param(Params._dummy(), "first", "first entry", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "number of entries", TypeConverters.toInt)
    both = Param(Params._dummy(), "both", "whether the additive's vector is attached too", TypeConverters.toBoolean)
    name = Param(Params._dummy(), "name", "name of the set", TypeConverters.toString)

    def __init__(self, table: DataFrame | None = None, name: str = "descr", width: int = 64, first: int = 0, both: bool = True):
        super().__init__(table)
        self._setDefault(name="descr", width=64, first=0, both=True)
        self._set(name=name, width=width, first=first, both=both)

    @property
    def names(self) -> list[str]:
        name, at = self.getOrDefault(self.name), range(self.getOrDefault(self.first), self.getOrDefault(self.first) + self.getOrDefault(self.width))
        return [f"{name}_all_{i}" for i in at] + ([f"{name}_additive_{i}" for i in at] + [f"{name}_additive_mask"]) * self.getOrDefault(self.both)

    def _entries(self, column: str) -> Column:
        return F.transform(F.slice(column, self.getOrDefault(self.first) + 1, self.getOrDefault(self.width)),
                           lambda x: F.coalesce(N.finite_or(x, 0.0), F.lit(0.0)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, parts = self.looked_up(dataset, F.col(S.SUBJECT), "_all", "inner"), [self._entries("_all")]
        if self.getOrDefault(self.both):
            out = self.looked_up(out, F.col(S.ADDITIVE), "_additive", "left")
            empty = F.array_repeat(F.lit(0.0), self.getOrDefault(self.width))
            parts += [F.coalesce(self._entries("_additive"), empty), F.array(F.col("_additive").isNotNull().cast("double"))]
        return out.withColumn(f"f_{self.getOrDefault(self.name)}", array_to_vector(F.concat(*parts))).drop("_all", "_additive")


class Grams(FeatureStage):
    """The buckets of all substrings of four characters of the subject and the additive, as words to be counted."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        buckets = lambda c: F.coalesce(F.transform(X.qgrams(F.col(c), LINGO_Q), lambda g: X.gram_bucket(g, LINGO_BUCKETS).cast("string")),
                                       F.array().cast("array<string>"))
        return dataset.withColumns({"grams_all": buckets(S.SUBJECT), "grams_additive": buckets(S.ADDITIVE)})


@dataclass
class FeatureSet:
    """A set's stages, the vector columns they add, and the names of all entries."""

    stages: list[Transformer]
    columns: list[str]
    names: list[str]


def _conditions(tables: Mapping[str, DataFrame]) -> FeatureSet:
    return FeatureSet([Conditions()], ["f_conditions"], Conditions.names)


def _expert(tables: Mapping[str, DataFrame]) -> FeatureSet:
    return FeatureSet([Expert(tables.get("weights"))], ["f_expert"], Expert.names)


def _descr(tables: Mapping[str, DataFrame]) -> FeatureSet:
    stage = Vectors(_table(tables, "vectors"))
    return FeatureSet([stage], ["f_descr"], stage.names)


def _chen(tables: Mapping[str, DataFrame]) -> FeatureSet:
    stage = Vectors(_table(tables, "vectors"), "chen", CHEN_WIDTH, both=False)
    return FeatureSet([stage], ["f_chen"], stage.names)


def _lingo(tables: Mapping[str, DataFrame]) -> FeatureSet:
    words = [str(i) for i in range(LINGO_BUCKETS)]
    counters = [CountVectorizerModel.from_vocabulary(words, f"grams_{r}", f"f_lingo_{r}") for r in ("all", "additive")]
    return FeatureSet([Grams(), *counters], ["f_lingo_all", "f_lingo_additive"],
                      [f"lingo_{r}_{w}" for r in ("all", "additive") for w in words])


#: Tables of molecules (``key, value``): ``weights`` with a number, ``vectors`` with an array of numbers.
SETS: dict[str, Callable[[Mapping[str, DataFrame]], FeatureSet]] = {"expert": _expert, "chen": _chen, "descr": _descr, "lingo": _lingo}


def _table(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise ValueError(f"this feature set needs the table {name!r}")
    return tables[name]


def feature_sets(names: Sequence[str], tables: Mapping[str, DataFrame] | None = None) -> list[FeatureSet]:
    """The conditions and the named sets, in this order."""
    unknown = [n for n in names if n not in SETS]
    if unknown:
        raise ValueError(f"unknown feature set {unknown[0]!r}; known: {', '.join(sorted(SETS))}")
    return [_conditions(tables or {}), *[SETS[n](tables or {}) for n in names]]


def stages(sets: Sequence[FeatureSet], output: str = "features") -> list[Transformer]:
    columns = [c for s in sets for c in s.columns]
    return [*[x for s in sets for x in s.stages], VectorAssembler(inputCols=columns, outputCol=output)]


def with_features(df: DataFrame, names: Sequence[str], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``df`` with the vector column ``features``; rows for which a set has no required value disappear."""
    out = df
    for stage in stages(feature_sets(names, tables)):
        out = stage.transform(out)
    return out


def entries(featured: DataFrame, names: Sequence[str], keep: Sequence[str], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The entries that are not zero, in rows: ``keep``, ``feature``, ``value``."""
    labels = F.array(*[F.lit(n) for s in feature_sets(names, tables) for n in s.names])
    values = featured.select(*keep, F.posexplode(vector_to_array("features")).alias("place", "value")).where("value <> 0")
    return values.select(*keep, F.get(labels, F.col("place")).alias("feature"), "value")
