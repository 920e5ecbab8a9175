"""Column functions over the text identifier of a subject. All of them stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from assayframe import schemas as S


def leading_run_length(c: Column, letter: str = "C") -> Column:
    """Length of the unbroken run of ``letter`` at the start, 0 when there is none."""
    return F.length(F.regexp_extract(c, f"^({letter}+)", 1))


def count_char(c: Column, letter: str = "C") -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))


def first_part(c: Column, separator: str = ".") -> Column:
    return F.substring_index(c, separator, 1)


def contains_any(c: Column, marks: Sequence[str]) -> Column:
    hit = F.lit(False)
    for mark in marks:
        hit = hit | c.contains(mark)
    return hit


def subject_class(c: Column) -> Column:
    """Charge class from marks in the lower-cased identifier; both charges beat either one."""
    low = F.lower(c)
    anion = contains_any(low, S.ANION_MARKS)
    cation = contains_any(low, S.CATION_MARKS)
    return (
        F.when(anion & cation, "zwitterionic")
        .when(anion, "anionic")
        .when(cation, "cationic")
        .otherwise("nonionic")
    )


def normalize_key(c: Column) -> Column:
    """Key text without surrounding blanks and trailing dots, for sources that add them."""
    return F.regexp_replace(F.trim(c), r"\.+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def qgrams(c: Column, q: int = 4) -> Column:
    """All overlapping substrings of ``q`` characters, line ends included; linear in the text length."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{q}}}))."), F.lit(1))


def overlapping_pieces(c: Column, overlap: int, size: int = 8192) -> Column:
    """The text in pieces of ``size`` characters, each followed by the next ``overlap`` ones, so that
    every substring of ``overlap + 1`` characters lies in exactly one piece by its start. A short text is its own piece."""
    cut = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"), F.lit(1))
    return F.when(F.length(c) <= size, F.array(c)).otherwise(cut)


def gram_bucket(gram: Column, buckets: int = 256) -> Column:
    """Bucket of a gram: the first 32 bits of its md5, modulo the bucket count."""
    return (F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")
