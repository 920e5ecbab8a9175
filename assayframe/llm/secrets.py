"""Secret scans with an incremental ledger of blobs.

Every version of a text is a blob, named by its content. A ledger keeps the (blob, rule version) pairs that
were scanned, and what was found in them. A run scans the pairs that are not in it, appends both under the run's own name, and
the report joins the findings of the current rule versions, of whatever run, back to all documents (paths) that hold the blob. The text
of a blob moves and is scanned once, however many documents repeat it. A run that is repeated writes its part of the ledger anew,
findings first: pairs without findings are scanned again, but findings are never lost.

The query takes the documents as a history of two pushes (by source) into an empty ledger: the second run goes over the whole table
and scans what the first has not.

Edge cases: a null text is the empty blob. Equal texts share one scan and get the same findings, repeated rows
included. An empty table gives empty findings and an empty report. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayframe.llm.common import text_of
from assayframe.session import shared_folder, store


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules. A run that is too short holds no run that is long enough, so the
#: minimum is part of the pattern where it can be.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds of this method.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("login", r"://[^\s/:@]++:[^\s/@]{3,}+@"),
)
RULES = BASE + MORE
FINDING = "blob string, rule string, start long, end long"
PAIR = "blob string, rule string"


class Ledger:
    """Scanned pairs and findings in two Parquet tables under a shared folder, one folder for each run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, schema: str) -> DataFrame:
        # An empty table of the same columns stands for a ledger without runs.
        empty = self.spark.createDataFrame([], f"{schema}, run string")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return empty
        return self.spark.read.schema(empty.schema).parquet(f"{self.folder}/{name}")

    def pairs(self) -> DataFrame:
        return self._table("pairs", PAIR)

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """What any run found by these rule versions, each place once, with the kind and its place among the rules."""
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.struct(F.lit(r.kind).alias("kind"), F.lit(i).alias("i")))])
        known = self._table("findings", FINDING).where(F.col("rule").isin([r.name for r in rules])).drop("run").distinct()
        return known.withColumn("_r", order[F.col("rule")]).select("*", "_r.kind", F.col("_r.i").alias("kind_order")).drop("_r")

    def append(self, run: str, findings: DataFrame, pairs: DataFrame) -> None:
        findings.write.mode("overwrite").parquet(f"{self.folder}/findings/run={run}")
        pairs.write.mode("overwrite").parquet(f"{self.folder}/pairs/run={run}")


def blob_of() -> Column:
    return F.sha2(text_of(), 256)


def unseen(docs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame) -> DataFrame:
    """Blobs with the rules still to be applied: ``blob, text, todo``. The ledger is compared by names only, and copies of a text
    become one blob in their own task before anything is shuffled."""
    names = F.array(*[F.lit(r.name) for r in rules])
    texts = docs.select(blob_of().alias("blob"), text_of().alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    done = ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("_done"))
    return texts.join(done, "blob", "left").select(
        "blob", "text", F.when(F.col("_done").isNull(), names).otherwise(F.array_except(names, "_done")).alias("todo")).where(
        F.size("todo") > 0)


def hits(blobs: DataFrame, rule: Rule) -> DataFrame:
    """The counted matches of one rule. Lengths of the pieces between matches add up to the places of the matches."""
    pattern, text = F.lit(rule.pattern), F.col("text")
    found = blobs.where(F.array_contains("todo", rule.name) & text.rlike(rule.pattern)).select("blob", F.posexplode(F.zip_with(
        F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                   lambda a, b: F.struct(F.length(a).alias("skip"), F.length(b).alias("size"))),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)),
        lambda a, b: F.struct(a["skip"].alias("skip"), a["size"].alias("size"), F.length(b).alias("held")))).alias("i", "m"))
    so_far = Window.partitionBy("blob").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.skip") + F.coalesce(F.col("m.size"), F.lit(0))).over(so_far)
    return found.select("blob", "m", end.alias("end")).where(F.col("m.held") >= rule.least).select(
        "blob", F.lit(rule.name).alias("rule"), (F.col("end") - F.col("m.size")).alias("start"), "end")


def scan(docs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scan what the pairs of ``ledger`` do not list: the findings, and the pairs scanned.

    Only blobs that match some rule are written down for the exact scan; places are summed by window on
    the matches of a blob, so nothing larger than one document meets in a task.
    """
    blobs = unseen(docs, rules, ledger)
    some = F.lit(False)
    for rule in rules:
        some = some | F.col("text").rlike(rule.pattern)
    marked = store(blobs.select("blob", "todo", F.when(some, F.col("text")).alias("text")))
    suspects, parts = marked.where("text IS NOT NULL"), None
    for rule in rules:
        part = hits(suspects, rule)
        parts = part if parts is None else parts.unionByName(part)
    return parts.select("blob", "rule", F.col("start").cast("long"), F.col("end").cast("long")), marked.select("blob", F.explode("todo").alias("rule"))


def run(docs: DataFrame, ledger: Ledger, name: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger has not seen, append to it, and report on all of ``docs``."""
    findings, pairs = scan(docs, rules, ledger.pairs())
    ledger.append(name, findings, pairs)
    return report(docs, ledger.findings(rules))


def summaries(findings: DataFrame) -> DataFrame:
    """One row per blob with findings: counts and spans of the base kinds, and all spans."""
    spans = F.sort_array(F.collect_list(F.struct(
        "start", "kind_order", "end", F.concat_ws(":", "kind", "start", "end").alias("span"))))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), ",")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    grouped = findings.groupBy("blob").agg(*[count(r.kind).alias(f"n_{r.kind}") for r in BASE], spans.alias("all"))
    return grouped.select(
        "blob", *[f"n_{r.kind}" for r in BASE],
        joined(F.filter("all", lambda x: x["kind_order"] < len(BASE))).alias("base"), joined(F.col("all")).alias("spans"))


def report(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings joined back to every document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    paths = docs.select("doc_id", blob_of().alias("blob"))
    return paths.join(summaries(findings), "blob", "left").select(
        "doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def find_secrets(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Two pushes into an empty ledger, the second one of all documents, and the report after it."""
    spark = docs.sparkSession
    ledger = Ledger(spark, folder or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    push = F.pmod(F.xxhash64("source"), F.lit(2)) == 0 if "source" in docs.columns else F.lit(False)
    findings, pairs = scan(docs.where(push), RULES, ledger.pairs())
    ledger.append("push-1", findings, pairs)
    return run(docs, ledger, "push-2")
