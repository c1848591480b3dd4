from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import rows
from vacantia.llm import pivot_search as ps

SCHEMA = "vec_id long, embedding array<double>, cell string, part string, v string, label int"


def vectors(spark, given):
    return spark.createDataFrame([(i, v, "x", "y", "z", 0) for i, v in given], SCHEMA)


def brute(given, every, k=5):
    """All scores in whole numbers, one by one."""
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in given if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, v) for i, v in usable if sum((abs(x) + 1) ** 2 for x in v) < 2**62]
    queries = {}
    for i, v in usable:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, own in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(own))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def clustered(n, width, seed, spread=0.15):
    random_ = np.random.default_rng(seed)
    centres = random_.normal(size=(9, width))
    return (centres[random_.integers(0, 9, n)] + random_.normal(size=(n, width)) * spread).tolist()


def searched(spark, given, every, k=5):
    return sorted(rows(ps.search(vectors(spark, given), F.col("vec_id") % every == 0, k)))


@pytest.mark.parametrize("part_bytes", [ps.PART_BYTES, 20_000])
def test_equals_all_scores(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(ps, "PART_BYTES", part_bytes)
    given = list(enumerate(clustered(1500, 12, 1)))
    assert searched(spark, given, 50) == brute(given, 50)


def test_long_vectors_of_different_lengths_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(ps, "PART_BYTES", 5_000)
    random_ = random.Random(5)
    given = [(i, [random_.gauss(0, 10.0 ** (i % 4)) for _ in range(8)]) for i in range(400)]
    given += [(i, [random_.gauss(0, 1) for _ in range(i % 3)]) for i in range(400, 500)]
    assert searched(spark, given, 10, 7) == brute(given, 10, 7)


def test_repeated_vectors_tie_by_id(spark):
    given = [(i, [0.5, -0.25, 1.0] if i % 3 else [float(i % 7), 0.5, -1.0]) for i in range(2000)]
    assert searched(spark, given, 100) == brute(given, 100)


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    given = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]),
             (8, [inf, 1.0]), (100, []), (9, []), (10, [1.0]), (None, [5.0, 5.0]), (11, [1e300, 1.0]), (12, [-1e7, 3e6]), (-50, [-1e7, 0.001]), (150, [0.999, -0.001])]
    assert searched(spark, given, 50) == brute(given, 50)
    assert searched(spark, [], 50) == []
    assert searched(spark, [(0, [1.0])], 50) == []
    assert searched(spark, [(0, None), (1, [nan])], 50) == []
    assert searched(spark, [(1, [1.0]), (2, [2.0])], 50) == []


def test_scores_beyond_exact_doubles(spark):
    random_ = random.Random(9)
    given = [(i, [random_.uniform(-3e6, 3e6) for _ in range(3)]) for i in range(300)]
    assert searched(spark, given, 30) == brute(given, 30)


def test_bounds_hold_and_eliminate():
    points = np.floor(256 * np.array(clustered(3000, 12, 2, 0.05))).astype(np.int32)
    pivots = ps.spread_pivots(points[:500].astype(float))
    table = ps.distances(points, pivots).astype(np.float32)
    ids = np.arange(3000)
    for q in range(0, 3000, 100):
        true = points.astype(np.int64) @ points[q].astype(np.int64)
        assert (ps.upper_bounds(table[q], table) >= true).all()
        found, scores, looked = ps.eliminate(q, points[q], table[q], -math.inf, ids, points, table, 5)
        order = sorted((i for i in range(3000) if i != q), key=lambda i: (-true[i], i))[:5]
        assert found.tolist() == order and scores.tolist() == [true[i] for i in order] and looked < 3000


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(ps, "SAMPLE_ROWS", 50)
    given = list(enumerate(clustered(2000, 4, 3)))
    held = ps.integer_vectors(vectors(spark, given))
    assert 40 <= len(ps.sampled(held, 2000, 4)) <= 50
    assert searched(spark, given, 100) == brute(given, 100)
