"""The filter audit against all 120 orders played on every document."""

import re
from collections import Counter
from itertools import permutations

from assayframe.llm import filter_audit
from tests.llm import plain

LABELS = [(0, 1, 1, "x"), (0, 0, None, "x"), (3, 1, 0, "x"), (5, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (12, 1, None, "x")]
LABEL_COLUMNS = "doc_id long, quality int, toxic int, part string"


def fails(rows):
    out = []
    for r in rows:
        text, w = r[1] or "", plain.words(r[1])
        earlier = r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == text for o in rows)
        out.append({f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search(r"[#$%&*|]", text)), earlier)) if bad})
    return out


def audit(rows, labels):
    good, toxic = {x[0] for x in labels if x[1] == 1} - {None}, {x[0] for x in labels if x[2] == 1} - {None}
    failed, out = fails(rows), []
    for part in {r[3] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[3] or "") == part]
        table, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                table.append((part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in mine) - len(gone),
                              sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
        out += [(*row[:-1], shapley[row[-1]]) for row in table]
    return Counter(out)


def got(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return Counter(tuple(r) for r in df.collect())


def test_hard_rows(spark):
    rows = plain.hard_rows() + [(50 + i, "Same text.", "en", "b", 1, 1, None, None, None) for i in range(7)]
    docs, labels = spark.createDataFrame(rows, plain.COLUMNS).repartition(3), spark.createDataFrame(LABELS, LABEL_COLUMNS)
    assert got(filter_audit.filter_audit(docs, labels)) == audit(rows, LABELS)


def test_the_table(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    assert got(filter_audit.query(spark, folder)) == audit(rows, [tuple(r) for r in labels.collect()])


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], plain.COLUMNS), spark.createDataFrame(LABELS, LABEL_COLUMNS)
    assert filter_audit.filter_audit(none, labels).collect() == []
    rows = plain.hard_rows()[:4]
    docs = spark.createDataFrame(rows, plain.COLUMNS)
    assert got(filter_audit.filter_audit(docs, spark.createDataFrame([], LABEL_COLUMNS))) == audit(rows, [])


def test_intervals_cover_every_order_once():
    """For each mask and order the intervals remove it at exactly one step, the right one."""
    found = Counter()
    for mask, step, rank, sign in filter_audit.intervals():
        found[mask, step, rank] += sign
    for mask in range(1, 32):
        steps = {s: 0 for s in range(1, 6)}
        for rank, order in enumerate(filter_audit.ORDERS):
            for s in steps:
                steps[s] += found[mask, s, rank]
            first = next(i for i, f in enumerate(order, 1) if mask >> "ABCDE".index(f) & 1)
            assert steps == {s: int(s == first) for s in steps}


def test_one_part_with_most_rows_and_copies_is_counted_before_the_shuffle(spark):
    """The counts of a part meet after a partial sum in each task, and copies of a text per part before they meet."""
    rows = [(i, "Copy of one text.", "en", "hot", 1, None, None, None, None) for i in range(500)]
    docs, labels = spark.createDataFrame(rows, plain.COLUMNS).repartition(4), spark.createDataFrame(LABELS, LABEL_COLUMNS)
    assert got(filter_audit.filter_audit(docs, labels)) == audit(rows, LABELS)
