from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import rows
from vacantia.llm import kmeans_tree as k

SCHEMA = "vec_id long, embedding array<float>, leaf string, v string"


def vectors(spark, given):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in given], SCHEMA)


def clustered(n, width=16, seed=1):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(12, width))
    points = centres[random.integers(0, 12, n)] + random.normal(size=(n, width)) * 0.6
    return points.astype(np.float32).astype(np.float64)


def true_top(given, query, n=20):
    points = np.array([v for _, v in given], np.float64)
    own = dict(given)[query]
    scored = sorted((-float((p * np.array(own)).sum()), i) for (i, _), p in zip(given, points, strict=True) if i != query)
    return [(i, -s) for s, i in scored[:n]]


def test_recall_scores_and_order(spark):
    given = [(i, [float(x) for x in v]) for i, v in enumerate(clustered(6000))]
    out = k.search(vectors(spark, given), F.col("vec_id") % 20 == 0).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 6000, 20)) and all(len(x) == 20 for x in found.values())
    hits = 0
    for query, result in list(found.items())[:60]:
        best = true_top(given, query)
        hits += len({i for i, _ in best} & {i for i, _ in result})
        assert result == sorted(result, key=lambda x: (-x[1], x[0])) and query not in {i for i, _ in result}
        exact = dict(given)[query]
        assert all(abs(s - float((np.array(dict(given)[i]) * exact).sum())) < 1e-12 for i, s in result[:3])
    assert hits / (60 * 20) >= 0.9


def test_many_equal_vectors_tie_by_id(spark):
    given = [(i, [1.0, 2.0, 3.0] if i % 2 == 0 else [float(i % 7), 0.5, -1.0]) for i in range(3000)]
    out = [r for r in k.search(vectors(spark, given), F.col("vec_id") == 40, 20).orderBy("rank").collect()]
    assert [r["vec_id"] for r in out] == [i for i in range(0, 44, 2) if i != 40][:20] and {r["score"] for r in out} == {14.0}


def test_small_and_odd_inputs(spark):
    nan, inf = math.nan, math.inf
    given = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, []), (10, [1.0]), (None, [5.0, 5.0])]
    out = k.search(vectors(spark, given), F.col("vec_id") % 20 == 0)
    assert sorted(rows(out)) == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0)]
    assert rows(k.search(vectors(spark, []), F.col("vec_id") % 20 == 0)) == []
    assert rows(k.search(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0)) == []


def test_best_bin_first_visits_near_leaves_first():
    points = clustered(3000, seed=4)
    tree = k.Tree.fit(points)
    order = tree.leaf_order(points[5], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and order.index(int(tree.assign(points[5:6])[0])) < tree.leaves // 10 + 1
