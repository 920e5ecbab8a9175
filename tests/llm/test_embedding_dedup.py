"""Embedding near-dedup against all pairs."""

from collections import Counter

import numpy as np
import pytest

from assayframe.llm import embedding_dedup as dedup

COLUMNS = "vec_id long, embedding array<float>, label int, node long, component string, row string"


def plain(rows, least=0.98):
    n, links = len(rows), [set() for _ in rows]
    ok = [r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    x = [np.array(r[1], np.float64) if o else None for r, o in zip(rows, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= least:
                    links[i].add(j), links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        name = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), name, rows[i][0] == name))
    return Counter(out)


def hard_rows(n=40, length=32, seed=1):
    rng = np.random.default_rng(seed)
    rows, at = [], 0

    def put(x, label=1):
        nonlocal at
        rows.append((at, None if x is None else [None if v is None else float(v) for v in x], label, 7, "c", "r"))
        at += 1

    for i in range(n):
        base = rng.standard_normal(length)
        for _ in range(rng.integers(1, 5)):
            put((base + rng.standard_normal(length) * rng.choice([0.05, 0.1, 0.14, 0.2])).astype(np.float32), int(i % 3))
    base = rng.standard_normal(length)
    for _ in range(120):  # near copies, more than a small window holds
        put((base + 0.1 * rng.standard_normal(length)).astype(np.float32))
    for _ in range(30):
        put(np.ones(length))
    chain = np.eye(length)
    for step in np.linspace(0, 1.5, 40):
        put((np.cos(step) * chain[0] + np.sin(step) * chain[1]).astype(np.float32), 2)
    for odd in (None, [], [0.0] * length, [None] * length, [float("nan")] * length, [float("inf")] + [1.0] * (length - 1), [1.0, None], [1.0], [2.0], [1.0, 1.0],
                [1e30] * length, [1e-30] * length):
        put(odd)
        put(odd)
    put(np.ones(length), None)
    put(np.ones(length), None)
    rows += rows[:2] + [(None, rows[0][1], rows[0][2], None, None, None), (None, [1.0, -1.0, 3.0], 5, None, None, None)]
    return rows


def got(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def wanted():
    return plain(hard_rows())


def test_hard_rows(spark, wanted):
    assert got(dedup.near_vectors(spark.createDataFrame(hard_rows(), COLUMNS).repartition(3))) == wanted


def test_small_windows_and_blocks(spark, wanted):
    """Windows far smaller than the large class, blocks that part it, many task borders."""
    made = dedup.near_vectors(spark.createDataFrame(hard_rows(), COLUMNS), window=8, block=16)
    assert got(made) == wanted


def test_the_table(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert got(dedup.near_vectors(table)) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(3, None, None, None, None, None)], [(3, [1.0], 1, None, None, None)]])
def test_small_tables(spark, rows):
    assert got(dedup.near_vectors(spark.createDataFrame(rows, COLUMNS))) == plain(rows)


def test_recall_of_the_passes_alone(spark):
    """Pairs at just the least cosine in a label of 8,000 vectors: the passes unite nearly all of them."""
    rng, length, n = np.random.default_rng(9), 64, 4000
    a = rng.standard_normal((n, length))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, length))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9801 * a + np.sqrt(1 - 0.9801 ** 2) * b
    rows = [(i, x.tolist(), 1) for i, x in enumerate(np.concatenate([a, near]))]
    made = dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=64)
    found = sum(r["component_id"] == r["vec_id"] - n for r in made.where(f"vec_id >= {n}").collect())
    assert found >= 0.998 * n


def test_passes_grow_slowly_with_the_table():
    assert [dedup.passes_for(n) for n in (0, 100, 5_000, 10 ** 6, 10 ** 9)] == sorted(dedup.passes_for(n) for n in (0, 100, 5_000, 10 ** 6, 10 ** 9))
    assert dedup.passes_for(10 ** 9) < 60
