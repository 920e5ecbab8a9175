"""Schema constraints as a table of violation counts, as counts that a load reports by itself, or as an error."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, functions as F

from assayframe import schemas as S
from assayframe.operators.clean import incomplete


def rules(annotated: bool = False) -> dict[str, Column]:
    found = {
        "subject_not_null": F.col(S.SUBJECT).isNull(),
        "temperature_not_null": F.col(S.TEMPERATURE).isNull(),
        "concentration_with_additive": incomplete(F.col(S.ADDITIVE), F.col(S.CONCENTRATION)),
    }
    if annotated:
        found["target_not_null"] = F.col(S.TARGET).isNull()
    return found


def violations(df: DataFrame, *, annotated: bool = False) -> DataFrame:
    checks = rules(annotated)
    counts = df.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()])
    pairs = ", ".join(f"'{name}', {name}" for name in checks)
    return counts.selectExpr(f"stack({len(checks)}, {pairs}) AS (rule, n_violations)")


def enforce(df: DataFrame, *, annotated: bool = False) -> DataFrame:
    """The same rows; reading a row that breaks a rule fails the query with the rule's name."""
    out = df
    for name, bad in rules(annotated).items():
        out = out.where(F.when(bad, F.raise_error(F.lit(f"constraint broken: {name}")).cast("boolean")).otherwise(True))
    return out


def observed(df: DataFrame, *, annotated: bool = False) -> tuple[DataFrame, Observation]:
    """The same rows, and counts of rows and broken rules that are ready after the first action on them: no scan of their own."""
    seen = Observation(f"rules-{uuid.uuid4().hex}")
    counts = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(bad).alias(name) for name, bad in rules(annotated).items()]]
    return df.observe(seen, *counts), seen


def broken(seen: Observation) -> dict[str, int]:
    """The rules that rows of an observed load broke, after an action; :func:`check` makes an error of them."""
    return {name: n for name, n in seen.get.items() if name != "n_rows" and n}


def check(seen: Observation) -> None:
    if found := broken(seen):
        raise ValueError("constraints broken: " + ", ".join(f"{name} ({n} rows)" for name, n in sorted(found.items())))
