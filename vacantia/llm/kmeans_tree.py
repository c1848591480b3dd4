"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries). The tree is fitted on a
bounded sample (``SAMPLE_BYTES``); every vector is then put into a leaf and the leaves are written as packed blocks of bounded
size. A query walks the tree with a priority queue of nodes by distance to their centres, so it meets the leaves in
the order of promise. How many it visits is calibrated: a bounded set of queries is searched by brute force over all rows, and the visits
are widened until those queries find the wanted share of their true neighbours.

Equal vectors have equal scores, so of a group of equal vectors only the ``k + 1`` with the smallest ids can be in a result; the others
are left out of the blocks, which keeps a leaf of copies small and loses nothing. Scores are computed in double precision on
the original vectors, each by the same sum, so equal vectors tie exactly.

Defined results: vectors that are null, zero, hold null or non-finite components or are not of the commonest length take no part, nor
do rows without vec_id; rows with one vec_id are one vector, the smallest; with too few candidates all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia.llm.common import cut_lineage

SAMPLE_BYTES = 16 << 20
SAMPLE_ROWS = 65_536
BRANCHES = 16
#: Sampled rows of a leaf at least, and rows a leaf is meant to have: leaves of fewer rows cost more in queries sent to them than they save.
LEAF_SAMPLE = 48
LEAF_ROWS = 1500
#: Rows of a block, and queries compared with a block at once.
BLOCK_ROWS = 1024
QUERY_ROWS = 256
#: Queries whose best rows a task holds before it passes them on.
HELD_QUERIES = 50_000
CALIBRATION_QUERIES = 200
RECALL = 0.96


class Tree:
    """Centres of all nodes, the children of each node, and the number of each leaf (-1 for inner nodes)."""

    def __init__(self, width: int):
        self.centres, self.children, self.leaf = np.zeros((1, width)), [np.zeros(0, np.int64)], [-1]

    @classmethod
    def fit(cls, points: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_SAMPLE, seed: int = 7) -> Tree:
        tree, random, open_nodes, leaves = cls(points.shape[1]), np.random.default_rng(seed), [(0, points)], 0
        centres = [points.mean(axis=0) if len(points) else np.zeros(points.shape[1])]
        while open_nodes:
            node, own = open_nodes.pop()
            parts = _k_means(own, min(branches, -(-len(own) // leaf_rows)), random) if len(own) > leaf_rows else []
            if len(parts) < 2:
                tree.leaf[node] = leaves
                leaves += 1
                continue
            tree.children[node] = np.arange(len(centres), len(centres) + len(parts))
            for part in parts:
                open_nodes.append((len(centres), part))
                centres.append(part.mean(axis=0))
                tree.children.append(np.zeros(0, np.int64))
                tree.leaf.append(-1)
        tree.centres = np.array(centres)
        return tree

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, always going down to the nearest child."""
        at, out = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        moving = np.arange(len(points))
        while len(moving):
            left = []
            for node in np.unique(at[moving]):
                own = moving[at[moving] == node]
                if self.leaf[node] >= 0:
                    out[own] = self.leaf[node]
                else:
                    at[own] = self.children[node][_distances(points[own], self.centres[self.children[node]]).argmin(axis=1)]
                    left.append(own)
            moving = np.concatenate(left) if left else np.zeros(0, np.int64)
        return out

    def leaf_order(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves of a best-bin-first walk."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                continue
            children = self.children[node]
            far = ((self.centres[children] - query) ** 2).sum(axis=1)
            for d, child in zip(far.tolist(), children.tolist(), strict=True):
                heapq.heappush(queue, (d, child))
        return found


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1) - 2 * points @ centres.T


def _k_means(points: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> list[np.ndarray]:
    centres = points[random.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = _distances(points, centres).argmin(axis=1)
        centres = np.array([points[near == c].mean(axis=0) for c in np.unique(near)])
    near = _distances(points, centres).argmin(axis=1)
    return [points[near == c] for c in np.unique(near)]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    value = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("bigint"), value.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _squares(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def lifted(points: np.ndarray, norm2: float) -> np.ndarray:
    return np.hstack([points, np.sqrt(np.maximum(0, norm2 - (points**2).sum(axis=1)))[:, None]])


def matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def best(ids: np.ndarray, points: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` best rows but its own: (position of the query, ids, scores), best first, ties to the smaller id.
    The matrix product only preselects, with a margin for rounding; scores are then summed row by row."""
    rough = queries @ points.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    for i in range(len(queries)):
        own = rough[i]
        if len(own) > k:
            edge = np.partition(own, len(own) - k)[len(own) - k]
            near = np.flatnonzero(own >= edge - 1e-9 * (1 + abs(edge)))
        else:
            near = np.arange(len(own))
        near = near[ids[near] != query_ids[i]]
        exact = (points[near] * queries[i]).sum(axis=1)
        order = np.lexsort((ids[near], -exact))[:k]
        yield i, ids[near[order]], exact[order]


_FOUND = "query_id bigint, vec_id bigint, score double"


def _found_batch(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(ids) for _, ids, _ in found]
    columns = [np.repeat(np.array([q for q, _, _ in found], np.int64), sizes)]
    columns += [np.concatenate([f[j] for f in found]) if found else np.zeros(0) for j in (1, 2)]
    types = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["query_id", "vec_id", "score"])


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact result for a bounded list of queries over all rows."""
    held = rows.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, points = held.value
        for batch in batches:
            if len(batch):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield _found_batch([(int(query_ids[i]), a, b) for i, a, b in best(ids, matrix(batch.column(1)), points, query_ids, k)])

    return top(rows.mapInArrow(scan, _FOUND), k)


def calibrated_visits(tree: Tree, norm2: float, rows: DataFrame, k: int, wanted: float, is_query: Column) -> int:
    """The fewest leaves with which the calibration queries find the wanted share of their true neighbours."""
    chosen = rows.where(is_query).orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(CALIBRATION_QUERIES).collect()
    queries = [(r["vec_id"], r["v"]) for r in chosen]
    if not queries:
        return 1
    true = brute_force(rows, queries, k).join(rows, "vec_id").select("query_id", "v").collect()
    if not true:
        return 1
    leaves = tree.assign(lifted(np.array([r["v"] for r in true], np.float64), norm2))
    places = {}
    for query_id, v in queries:
        order = tree.leaf_order(np.array([*v, 0.0]), tree.leaves)
        places[query_id] = {leaf: i + 1 for i, leaf in enumerate(order)}
    needed = np.sort([places[r["query_id"]][int(leaf)] for r, leaf in zip(true, leaves, strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))))])


def _blocks(rows: DataFrame, tree, norm2: float, k: int) -> DataFrame:
    """Packed leaves: (leaf, ids, points), at most about BLOCK_ROWS vectors each."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(1)) if len(batch) else np.zeros((0, tree.value.centres.shape[1] - 1))
            leaves = tree.value.assign(lifted(points, norm2))
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), batch.column(0), batch.column(1)], ["leaf", "vec_id", "v"])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        points = np.array(group["v"].tolist(), np.float64)
        return pd.DataFrame([(int(group["leaf"].iloc[0]), group["vec_id"].to_numpy(np.int64).tobytes(), points.tobytes())], columns=["leaf", "ids", "points"])

    equal = Window.partitionBy(F.xxhash64("v"), F.hash("v")).orderBy("vec_id")
    kept = rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1).drop("copy")
    placed = cut_lineage(kept.mapInArrow(place, "leaf bigint, vec_id bigint, v array<double>"))
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    dealt = placed.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    return cut_lineage(dealt.select("leaf", "block", "vec_id", "v").groupBy("leaf", "block").applyInPandas(pack, "leaf bigint, ids binary, points binary"))


def search(embeddings: DataFrame, is_query: Column, k: int = 20, wanted: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``is_query`` (over vec_id) holds."""
    rows = usable(embeddings)
    spark = rows.sparkSession
    known = rows.agg(F.max(_squares("v")).alias("norm2"), F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    if known["norm2"] is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    norm2, width = known["norm2"], known["width"]
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    sample = rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(bound).select("v").collect()
    leaf_rows = max(LEAF_SAMPLE, LEAF_ROWS * len(sample) // known["n"])
    tree = Tree.fit(lifted(np.array([r["v"] for r in sample], np.float64), norm2), leaf_rows=leaf_rows)
    visits = calibrated_visits(tree, norm2, rows, k, wanted, is_query)
    held = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            points = matrix(batch.column(1)) if len(batch) else np.zeros((0, width))
            by_leaf: dict[int, list[int]] = {}
            for i, point in enumerate(points):
                for leaf in held.value.leaf_order(np.append(point, 0.0), visits):
                    by_leaf.setdefault(leaf, []).append(i)
            parts = [(leaf, own[a : a + QUERY_ROWS]) for leaf, own in by_leaf.items() for a in range(0, len(own), QUERY_ROWS)]
            for a in range(0, len(parts), 64):
                columns = [
                    pa.array([leaf for leaf, _ in parts[a : a + 64]], pa.int64()),
                    pa.array([ids[own].tobytes() for _, own in parts[a : a + 64]], pa.binary()),
                    pa.array([points[own].tobytes() for _, own in parts[a : a + 64]], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["leaf", "query_ids", "queries"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # the best of each query over the blocks of the task
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                points = np.frombuffer(row["points"]).reshape(len(ids), width)
                queries = np.frombuffer(row["queries"]).reshape(len(query_ids), width)
                for i, own, scores in best(ids, points, queries, query_ids, k):
                    query = int(query_ids[i])
                    if query in held:
                        own, scores = (np.concatenate(x) for x in zip(held[query], (own, scores), strict=True))
                        order = np.lexsort((own, -scores))[:k]
                        own, scores = own[order], scores[order]
                    held[query] = own, scores
                if len(held) >= HELD_QUERIES:
                    yield _found_batch([(q, *x) for q, x in held.items()])
                    held = {}
        yield _found_batch([(q, *x) for q, x in held.items()])

    asked = rows.where(is_query).mapInArrow(route, "leaf bigint, query_ids binary, queries binary")
    met = _blocks(rows, held, norm2, k).join(asked, "leaf")
    return top(met.select("ids", "points", "query_ids", "queries").mapInArrow(compare, _FOUND), k)
