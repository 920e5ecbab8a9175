"""Line dedup by a deletion-neighbourhood join.

Two lines are near when one becomes the other by adding, dropping or replacing one word (edit distance 1 over words).
Each line emits its variants with one word deleted as hashed keys, with the place of the deletion, and itself:

- lines are named by their words, so lines that differ in white space only are equal,
- lines whose variants agree in key and place differ in that one word,
- a line that equals another line's variant lacks that one word,

so equal keys are exactly the near lines, and within a key only the least line of either kind matters: no pairs are
formed. The found pairs are verified word by word. A line goes if an earlier line (by ``doc_id``, then place) is equal or near.

Only lines that share their first or last half with another line (one half is untouched by one edit) emit variants. Each
character of a script written without blanks is a word. The queries compare every line that has a word (``LEAST_WORDS``)
and try near lines from ``LEAST_NEAR_WORDS`` on, as one word of fewer is most of what a line says; callers may ask for
longer lines only, by default ``MIN_WORDS`` and ``MIN_NEAR_WORDS``.

Edge cases: a null text has one empty line, which is left alone, like any line without a word. Repeated rows are later copies of the first. A very
long line costs its number of words: keys are running exclusive-ors, not one hash per variant text. A null ``doc_id`` comes
last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayframe.llm.common import SPACE, WORD, let, words_of
from assayframe.session import store

MIN_WORDS = 5
MIN_NEAR_WORDS = 10
#: What the queries ask for.
LEAST_WORDS = 1
LEAST_NEAR_WORDS = 5
#: Thai, Lao, Burmese, Khmer, kana and Han characters.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: Columns of a line's keys: first and last half, as it is and as the longer line of a pair.
HALVES = ["half_1", "half_2", "half_3", "half_4"]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def at_least(n: int) -> Column:
    """Whether a line has ``n`` words; the pattern stops at the last one it needs."""
    return F.col("line").rlike(rf"^{SPACE[:-1]}*+(?:{WORD[:-1]}++(?:{SPACE}+|$)){{{n}}}")


def apart(line: Column) -> Column:
    """The words of a line with one blank between them; each character of a script without blanks is a word."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | line.rlike(r"[^\x20-\u0DFF]")
    return F.when(odd, F.array_join(words_of(F.regexp_replace(line, f"([{UNSPACED}])", " $1 ")), " ")).otherwise(line)


def content(line: Column) -> Column:
    """A 128-bit name of a line, as it comes from :func:`apart`."""
    return F.unhex(F.md5(line))


def halves(line: Column) -> Column:
    """Keys of the first and last half of a line, as it is and as the longer line of a pair."""
    def keys(w: Column) -> Column:
        n = F.size(w)
        cut = lambda base: (F.xxhash64(F.lit(0), base, F.slice(w, 1, F.floor(base / 2).cast("int"))),
                            F.xxhash64(F.lit(1), base, F.slice(w, n - (base - F.floor(base / 2)).cast("int") + 1,
                                                                (base - F.floor(base / 2)).cast("int"))))
        return F.array(*cut(n), *cut(n - 1))

    return let(F.split(line, " "), keys)


def one_edit(a: Column, b: Column, place: Column) -> Column:
    """Whether word arrays differ by one word: replaced, or ``b`` has one more, at ``place`` (from 0)."""
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same)) == 1
    without = F.concat(F.slice(b, 1, place), F.slice(b, place + 2, F.greatest(F.size(b) - place - 1, F.lit(0))))
    return F.when(F.size(a) == F.size(b), replaced).otherwise(without == a)


def shared_halves(lines: DataFrame) -> DataFrame:
    """The ``id`` of each line of the distinct ``id, halves`` that has a half in common with another line."""
    keyed = lines.select("id", F.xxhash64("id").alias("name"), F.explode(F.array(*HALVES)).alias("half"))
    shared = keyed.groupBy("half").agg(F.min("name").alias("_a"), F.max("name").alias("_b")).where("_a < _b").select("half")
    return keyed.join(shared, "half", "left_semi").select("id").distinct()


def variants_of(able: DataFrame) -> DataFrame:
    """Hashed keys of the distinct ``id, words``: ``id, key, place``, one for each deleted word (its place, from 0) and one
    for the line itself (place -1)."""
    word = able.select("id", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))
    here = word.select("id", "n", "place", F.xxhash64("word", "place").alias("kept"), F.xxhash64("word", F.col("place") - 1).alias("moved"))
    in_line = Window.partitionBy("id").orderBy("place")
    whole = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hashed = here.select(
        "id", "n", "place", F.bit_xor("kept").over(in_line.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), "kept",
        F.bit_xor("moved").over(in_line.rowsBetween(Window.unboundedPreceding, 0)).alias("_moved"),
        F.bit_xor("moved").over(whole).alias("_all"))
    without = F.col("_upto").bitwiseXOR(F.col("kept")).bitwiseXOR(F.col("_moved")).bitwiseXOR(F.col("_all"))
    deleted = F.struct(F.xxhash64(without, F.col("n") - 1).alias("key"), F.col("place").alias("place"))
    itself = F.struct(F.xxhash64("_upto", "n").alias("key"), F.lit(-1).alias("place"))
    made = F.when(F.col("place") == F.col("n") - 1, F.array(deleted, itself)).otherwise(F.array(deleted))
    return hashed.select("id", F.explode(made).alias("made")).select("id", "made.key", "made.place")


def near(able: DataFrame) -> DataFrame:
    """From distinct ``id, words``, where ids are in the order of the lines' first places, each line with its earliest near
    line: ``id, near_id``, where there is an earlier one."""
    variants = store(variants_of(able))
    part = F.when(F.col("place") >= 0, F.col("id"))
    keys = variants.groupBy("key").agg(
        F.min("id").alias("_a"), F.max("id").alias("_b"), F.min(F.when(F.col("place") < 0, F.col("id"))).alias("whole"),
        F.min(part).alias("part"), F.min_by(F.col("place"), part).alias("part_place")).where("_a < _b").drop("_a", "_b")
    met = store(variants.join(keys, "key"))
    is_whole = F.col("place") < 0
    found = met.select(
        "id", F.when(is_whole, F.col("part")).otherwise(F.col("whole")).alias("near_id"),
        F.when(is_whole, F.col("part_place")).otherwise(F.col("place")).alias("place"))
    parts = met.where("place >= 0").select("key", "place", "id")
    least = parts.groupBy("key", "place").agg(F.min("id").alias("near_id"), F.max("id").alias("_b")).where("near_id < _b").drop("_b")
    alike = parts.join(least, ["key", "place"]).select("id", "near_id", "place")
    pairs = found.unionByName(alike).where("near_id < id").distinct()

    mine = able.select("id", F.col("words").alias("mine"))
    theirs = able.select(F.col("id").alias("near_id"), F.col("words").alias("theirs"))
    checked = pairs.join(mine, "id").join(theirs, "near_id").where(
        F.when(F.size("mine") <= F.size("theirs"), one_edit(F.col("mine"), F.col("theirs"), F.col("place")))
        .otherwise(one_edit(F.col("theirs"), F.col("mine"), F.col("place"))))
    return checked.groupBy("id").agg(F.min("near_id").alias("near_id"))


def repeats(rows: DataFrame, least: int, near_least: int) -> DataFrame:
    """The lines to remove from ``row, doc_id, text``: ``row, doc_id, line_no, keep_doc_id, keep_line_no, edits``; lines of
    ``least`` words may equal another, of ``near_least`` words be near it.

    Only names of lines are shuffled at first. Lines met once that share no half with another one are left
    alone from there on, and texts are fetched for the first places of the lines that may have a near one.
    """
    raw = rows.select("row", "doc_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line")).where(at_least(1))
    every = raw.withColumn("line", apart(F.col("line")))
    every = every.where(at_least(least)) if least > 1 else every
    half = F.when(at_least(near_least), halves(F.col("line")))
    places = store(every.select("row", "doc_id", "line_no", content(F.col("line")).alias("id"), half.alias("half")).select(
        "row", "doc_id", "line_no", "id", *[F.col("half")[i].alias(h) for i, h in enumerate(HALVES)]))
    distinct = store(places.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.min(h).alias(h) for h in HALVES]))
    able = store(shared_halves(distinct.where(F.col(HALVES[0]).isNotNull())).withColumn("able", F.lit(True)))
    some = distinct.select("id", "n").join(able, "id", "left").where("n > 1 OR able").select("id", "able")
    chosen = store(places.select("row", "doc_id", "line_no", "id").join(some, "id"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "line_no")
    firsts = store(chosen.groupBy("id").agg(F.min(place).alias("first"), F.max("able").alias("able")))

    wanted = firsts.where("able").select("first.row", "first.line_no", "first")
    texts = raw.where(F.length("line") >= near_least).select("row", "line_no", "line").join(wanted, ["row", "line_no"])
    ordered = store(texts.select("first", "line").orderBy("first").select(
        F.monotonically_increasing_id().alias("id"), "first", F.split(apart(F.col("line")), " ").alias("words")))
    found = near(ordered.select("id", "words"))
    first = ordered.select("id", "first")
    nearest = found.join(first, "id").join(first.select(F.col("id").alias("near_id"), F.col("first").alias("near_first")), "near_id").select(
        F.col("first.row").alias("_row"), F.col("first.line_no").alias("_line_no"), "near_first")
    kept = firsts.join(nearest, (F.col("first.row") == F.col("_row")) & (F.col("first.line_no") == F.col("_line_no")), "left").select(
        "id", "first", "near_first")
    is_near = F.col("near_first").isNotNull()
    kept_first = F.coalesce("near_first", "first")
    return chosen.join(kept, "id").where(is_near | (place != F.col("first"))).select(
        "row", "doc_id", "line_no", kept_first["doc_id"].alias("keep_doc_id"), kept_first["line_no"].alias("keep_line_no"),
        is_near.cast("int").alias("edits"))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with a row id, written down so that the id stays the same in every later scan."""
    return store(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))


def repeated_lines(docs: DataFrame, least: int = MIN_WORDS, near_least: int = MIN_NEAR_WORDS) -> DataFrame:
    """One row per line that goes: ``doc_id, line_no, keep_doc_id, keep_line_no, edits`` (0: equal, 1: near)."""
    rows = keyed(docs.select("doc_id", "text")).select("row", "doc.doc_id", F.coalesce("doc.text", F.lit("")).alias("text"))
    return repeats(rows, least, near_least).drop("row")


def without_repeats(docs: DataFrame, least: int = MIN_WORDS, near_least: int = MIN_NEAR_WORDS) -> DataFrame:
    """The documents without the lines that go, in the columns of ``docs``; one that loses all its lines with words goes."""
    rows = keyed(docs)
    gone = repeats(rows.select("row", "doc.doc_id", F.coalesce("doc.text", F.lit("")).alias("text")), least, near_least).groupBy(
        "row").agg(F.collect_set("line_no").alias("gone"))
    some = rows.join(gone, "row", "left")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.filter(
        lines_of(F.col("doc.text")), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    out = some.select("doc", "gone", text.alias("text")).where(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[F.when(F.col("gone").isNull(), F.col(f"doc.`{c}`")).otherwise(changed[c]).alias(c) if c in changed
                        else F.col(f"doc.`{c}`") for c in docs.columns])
