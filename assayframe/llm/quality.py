"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text go.

A line fails when no sentence ends in it or in the lines that carry it on, or it is mostly punctuation marks (punctuation), when most
of it is a row of separated items or it is short and starts with a menu word (navigation), or when most of it is sentences with a
stock phrase (boilerplate). The next line carries a line on when it starts with a small letter, or when its first word would not have
fitted on a line as long as the lines around (text wrapped at a width).

Edge cases: a null text has no words and fails the base rules, like an empty one. Lines without a word are neither
failed nor counted. Repeated rows are judged alike. An empty table gives an empty result. Every measure is
a function of one row, so the plan has no shuffle and no key that could run hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayframe.llm.common import let, text_of, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: A document that loses more than this share of its characters goes.
MAX_LOST_PERCENT = 50
#: Marks a line may have for each word.
MARKS_PER_WORD = 0.5
#: Share of a line that separated items or stock sentences must cover.
LEAST_COVER_PERCENT = 50

#: Fixed values.
SYMBOL = "[#*$%&|<>]"
MARK = r"[!#*$%&|<>{}\[\]~^_=+@\\]"
SENTENCE_END = r"""[.!?…。！？:;]["'”’»)\]]*(?:\s|$)"""
SENTENCE_BREAK = r"(?<=[.!?…。！？])\s+"
CARRIED_ON = r"""^\s*["'“‘«»(\[]*\s?\p{Ll}"""
FIRST_WORD = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
QUOTED = "«[^«»]*»|»[^«»]*«|‹[^‹›]*›|›[^‹›]*‹"
NAVIGATION = (
    r"(?:[|›»•·→][^|›»•·→]{0,40}){3,}"
    r"|(?i)^\s*(?:home|menu|next|previous|back to top|read more|click here|log ?in|sign (?:in|up)|skip to)\b(?:\W+\w+){0,5}\W*$")
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|(?:accept|use of|uses) cookies|cookie policy|privacy policy|terms of (?:use|service)"
    r"|lorem ipsum|(?:enable|requires) javascript|subscribe to our|(?:licensed|released) under (?:the|cc)\b"
    r"|this work is licensed)")


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text, every occurrence counted.

    Windows are sorted within the row; equal neighbours are repeats. Their places, sorted again, give the
    number of words covered.
    """
    def counted(w: Column) -> Column:
        last = F.size(w) - (width - 1)
        windows = F.transform(F.slice(w, 1, F.greatest(last, F.lit(0))), lambda x, i: F.struct(
            F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, width)]).alias("g"), i.alias("i")))
        return let(F.sort_array(windows), places)

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["g"] == x["g"], F.lit(False))
                         | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda v, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - v, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(words, counted)


def blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def carried(line: Column, following: Column, before: Column) -> Column:
    """Whether the next line carries a line on; null for a line that is not there."""
    wrapped = F.length(line) + 1 + F.length(F.regexp_extract(following, FIRST_WORD, 0)) > F.greatest(F.length(following), F.length(before))
    return F.coalesce(~blank(following) & (following.rlike(CARRIED_ON) | wrapped), F.lit(False))


def sentence_ends(lines: Column) -> Column:
    """For each line whether a sentence ends in it or in the lines that carry it on."""
    def flags(a: Column) -> Column:
        kinds = F.transform(a, lambda x, i: F.when(x.rlike(SENTENCE_END), "E").when(
            ~blank(x) & carried(x, F.get(a, i + 1), F.get(a, i - 1)), "C").otherwise("S"))
        runs = F.split(F.array_join(kinds, ""), "(?<=[ES])")
        return F.flatten(F.transform(runs, lambda k: F.array_repeat(k.endswith("E"), F.length(k))))

    return let(lines, flags)


def failing(line: Column, ended: Column) -> Column:
    """Whether a line fails the punctuation, navigation or boilerplate rule."""
    n_words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    marks = F.length(line) - F.length(F.regexp_replace(line, MARK, ""))
    unquoted = F.when(line.rlike("[«‹]"), F.regexp_replace(line, QUOTED, "")).otherwise(line)
    items = F.length(unquoted) - F.length(F.regexp_replace(unquoted, NAVIGATION, ""))
    stock = F.aggregate(F.filter(F.split(line, SENTENCE_BREAK), lambda x: x.rlike(BOILERPLATE)), F.lit(0), lambda n, x: n + F.length(x))
    most = lambda n: 100 * n >= LEAST_COVER_PERCENT * F.length(line)
    return (~ended | (marks > MARKS_PER_WORD * n_words)
            | F.when(line.rlike(NAVIGATION), most(items)).otherwise(False) | F.when(line.rlike(BOILERPLATE), most(stock)).otherwise(False))


def judged_lines(text: Column) -> Column:
    """Every line as a struct: ``line, worded`` (it has a word) and ``gone`` (it fails a rule)."""
    return let(F.split(text, "\n"), lambda lines: F.zip_with(lines, sentence_ends(lines), lambda x, ended: F.struct(
        x.alias("line"), (~blank(x)).alias("worded"), (~blank(x) & failing(x, ended)).alias("gone"))))


def total(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x["line"]))


def measures(text: Column) -> Column:
    """All that is measured of a text, as one struct: each text is split and judged once, whatever is read from it."""
    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)).cast("long").alias(
            "word_chars"), repeat_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(a: Column) -> Column:
        worded = F.filter(a, lambda x: x["worded"])
        return F.struct((F.size(worded) - F.size(F.array_distinct(F.transform(worded, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
                        total(F.filter(a, lambda x: x["gone"])).alias("lost"), total(worded).alias("all"),
                        F.array_join(F.transform(F.filter(a, lambda x: ~x["gone"]), lambda x: x["line"]), "\n").alias("clean_text"))

    def verdict(w: Column, lines: Column) -> Column:
        failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PERCENT * w["n_words"])
        symbols = F.when(text.rlike(SYMBOL), F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).otherwise(0).cast("long")
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"),
            lines["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
            (~failed & (100 * lines["lost"] <= MAX_LOST_PERCENT * lines["all"])).alias("kept"), lines["clean_text"].alias("clean_text"))

    return let(let(words_of(text), of_words), lambda w: let(let(judged_lines(text), of_lines), lambda lines: verdict(w, lines)))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its measures, whether it fails the base rules, and whether it is kept."""
    return docs.select("doc_id", F.inline(F.array(measures(text_of())))).select("doc_id", *MEASURES)


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents without their failing lines, in the columns of ``docs``.

    A document is judged in one expression that yields its clean row or none: a filter after it would be pushed below and
    judge the text again.
    """
    changed = {"text": lambda m: m["clean_text"], "n_chars": lambda m: F.length(m["clean_text"]).cast("long")}
    row = lambda m: F.struct(*[changed[c](m).alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.inline(let(measures(text_of()), lambda m: F.when(m["kept"], F.array(row(m))).otherwise(F.array()))))
