"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives

LAST = math.inf


def brute(rows, positives=5, count=5, least=80, most=100, scale=256.0):
    """Rows (id, vector, label) whose id is divisible by 3 are anchors."""
    held = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            held.append((vec_id, [math.floor(scale * x) for x in vector], label))
    out = []
    order = lambda s: (-s[0], LAST if s[1] is None else s[1])
    for at, (anchor, mine, label) in enumerate(held):
        if anchor is None or anchor % 3:
            continue
        scores = [(sum(a * b for a, b in zip(mine, v)), i, other) for n, (i, v, other) in enumerate(held) if n != at and len(v) == len(mine)]
        for p in sorted((s for s in scores if s[2] == label), key=order)[:positives]:
            fit = [s for s in scores if s[2] != label and least * p[0] <= 100 * s[0] <= most * p[0]]
            out += [(anchor, p[1], rank, s[1], p[0], s[0]) for rank, s in enumerate(sorted(fit, key=order)[:count], 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def vectors(seed, n=400, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]
    same = [0.5] * dim
    rows += [(1000 + i, same, i % 2) for i in range(150)]
    odd = [(2001, None, 1), (2004, [], 1), (2007, [], 2), (2010, [1.0] * 3, 1), (2013, [0.9] * 3, 2), (2016, [0.9] * 3, 1), (2019, same, None), (2022, [math.nan] * dim, 1), (2025, [None, *same[1:]], 1), (2028, [math.inf, *same[1:]], 1), (None, same, 1), (None, same, 0), (2031, [0.0] * dim, 3), (-3, [-1.0] * dim, 3)]
    return rows + odd + [rows[0], rows[3], rows[401], odd[4]]


@pytest.mark.parametrize("chunk_bytes", [16 << 20, 1])
def test_negatives_equal_brute_force(spark, chunk_bytes):
    rows = vectors(1)
    random.Random(2).shuffle(rows)
    table = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], "vec_id bigint, embedding array<double>, label int, piece int, rid string, score double").repartition(3)
    found = negatives.mine_hard_negatives(table, F.col("id") % 3 == 0, chunk_bytes=chunk_bytes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 1000
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)


def test_other_windows_labels_and_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-4, 5)) * 10**6 for _ in range(3)], rng.choice("xyz")) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string").repartition(2)
    found = negatives.mine_hard_negatives(table, F.col("id") % 3 == 0, positives=3, negatives=2, least=50, most=90)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, 3, 2, 50, 90))
    huge = [(i, [1e300 * (1 + i % 2), 1.0], "xy"[i % 2]) for i in range(8)]
    held = negatives.mine_hard_negatives(spark.createDataFrame(huge, "vec_id int, embedding array<double>, label string"), F.col("id") % 3 == 0).collect()
    assert held and {r["negative_score"] for r in held} == {(1 << 63) - 1}


def test_empty_tables(spark):
    table = spark.createDataFrame([(3, [1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert negatives.mine_hard_negatives(table, F.col("id") % 3 == 0).count() == 0
    assert negatives.mine_hard_negatives(table.limit(0), F.col("id") % 3 == 0).count() == 0
    assert negatives.mine_hard_negatives(spark.createDataFrame([(3, None, 1)], table.schema), F.col("id") % 3 == 0).count() == 0


def test_trees_prune_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (20, 8))
    rows = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(0, 2, (3000, 8)))
    asked = np.floor(rows[:40] + rng.normal(0, 2, (40, 8)))
    scores = (rows @ asked.T).astype(np.int64).T
    top = scores.max(axis=1)
    low, high = np.stack([top // 2, top // 4], axis=1), np.stack([top * 9 // 10, top // 3], axis=1)
    search = negatives.Search(asked, np.full(40, -5), np.zeros(40, int), low, high, 3, False)
    seen = []
    leaf = search.leaf
    monkeypatch.setattr(search, "leaf", lambda active, *rest: (seen.append(len(active) * len(rest[0])), leaf(active, *rest)))
    for at in range(0, 3000, 1000):
        part = slice(at, at + 1000)
        search.visit(rows[part], np.arange(3000)[part] // 2, np.arange(3000)[part], 1)
    for a in range(40):
        for s in range(2):
            fit = sorted((-x, i // 2) for i, x in enumerate(scores[a]) if low[a, s] <= x <= high[a, s])[:3]
            got = [(-x, i) for x, i, r in zip(search.score[a, s], search.ids[a, s], search.found[a, s]) if r >= 0]
            assert got == fit
    assert 0 < sum(seen) < 3000 * 40 * 0.4
