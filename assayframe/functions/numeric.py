"""Column functions over measured numbers: parsing, units, masks, scaling, losses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assayframe import schemas as S


def parse_number(c: Column, *, sentinel: str | None = S.MISSING_SENTINEL, decimal_comma: bool = False) -> Column:
    """Text to double; the sentinel and malformed text become null."""
    text = F.nullif(c, F.lit(sentinel)) if sentinel is not None else c
    if decimal_comma:
        text = F.replace(text, F.lit(","), F.lit("."))
    return text.try_cast("double")


def parse_number_strict(c: Column, *, sentinel: str | None = S.MISSING_SENTINEL, decimal_comma: bool = False) -> Column:
    """Text to double; malformed text is an error under ANSI mode."""
    text = F.nullif(c, F.lit(sentinel)) if sentinel is not None else c
    if decimal_comma:
        text = F.replace(text, F.lit(","), F.lit("."))
    return text.cast("double")


def finite_or(c: Column, fallback: float | None) -> Column:
    """``c`` where it is finite; infinities become ``fallback``, NaN becomes null."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(c), F.lit(None)).when(F.abs(c) == inf, F.lit(fallback)).otherwise(c).cast("double")


def neg_log10(c: Column) -> Column:
    return -F.log10(c)


def from_neg_log10(c: Column) -> Column:
    return F.pow(F.lit(10.0), -c)


def log_micro_to_neg_log(c: Column) -> Column:
    """log10 of a micromolar value to -log10 of the molar value."""
    return F.lit(6.0) - c


def scientific(c: Column) -> Column:
    return F.format_string("%.6e", c.cast("double"))


def text_mask(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.lit(1.0)).otherwise(F.lit(0.0))


def number_mask(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.lit(1.0))


def scaled(c: Column, mean: Column, std: Column) -> Column:
    """Standard score; a missing value maps to 0, the centre."""
    return F.coalesce((c - mean) / std, F.lit(0.0))


def safe_std(std: Column) -> Column:
    """A spread to divide by: 1 for a constant or an absent column."""
    return F.when(std > 0, std).otherwise(F.lit(1.0))


def huber(error: Column, delta: float = 0.5) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, error * error * 0.5).otherwise((size - 0.5 * delta) * delta)


def gated_vector(vector: Column, temperature: Column, other: Column, concentration: Column,
                 other_mask: Column, concentration_mask: Column) -> Column:
    """One array: main vector, temperature, gated second vector, gated concentration, both masks."""
    return F.concat(
        vector,
        F.array(temperature),
        F.transform(other, lambda x: x * other_mask),
        F.array(concentration * concentration_mask, other_mask, concentration_mask),
    )


def key_text(c: Column) -> Column:
    """A double as text inside a row key, another one for each value: six decimals, the same on every engine, where they say it
    all; otherwise the shortest text that names the value stands behind them."""
    six = c.try_cast("decimal(18,6)")
    rest = F.when(six.isNull() | (six.cast("double") != c), F.concat(F.lit("~"), c.cast("string"))).otherwise("")
    return F.when(c.isNotNull(), F.concat(F.coalesce(six.cast("string"), F.lit("")), rest))


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)
