"""Exact top-k by integer inner product with a pivot table.

Every component x becomes floor(256 x); scores are inner products of these integers. A bounded sample gives widely spaced pivots, the
origin first, and the table holds each vector's distances to all of them. For a query q and a vector x the triangle inequality bounds
their distance from below by max over pivots p of |d(q, p) - d(x, p)|, so with <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2 their score from above. A query
evaluates the candidates of a block in the order of that bound and stops when no bound left reaches its k-th score. Ties are kept up to that
point, so the result is exact.

On Spark: vectors lie in the cell of their nearest pivot, a cell in parts of about PART_BYTES dealt by id, a part in one packed block.
First each query looks into one part of its own cell; the k-th score there is a floor for the rest. Then it travels only to cells whose summary (the
least and greatest distance to each pivot) allows its floor. Driver and broadcasts hold the pivots (at most PIVOTS, PIVOT_BYTES) and one
summary for each cell, whatever the input. Where bounds eliminate nothing, every query meets every part, as in a block-wise comparison of
the stated queries with all rows.

Results for odd input: vectors that are null, or hold null or non-finite components, take no part, nor do those whose integer
components have a squared length of 2^62 or more (scores would not fit a long); rows without vec_id neither. A query has vectors of its own length as
candidates; an empty vector scores 0 with empty ones. Zero vectors take part. Repeated rows of one vec_id are candidates each;
a query is never a candidate of its own vec_id, and of several vectors of one queried vec_id the least is the query. Ties go to the smaller
vec_id. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia.llm.common import cut_lineage

FACTOR = 256
PIVOTS = 32
PIVOT_BYTES = 1 << 20
SAMPLE_ROWS = 2048
SAMPLE_BYTES = 8 << 20
PART_BYTES = 8 << 20
#: Rows that a query evaluates at most before it looks at the next bound.
STEP_ROWS = 1024
#: Queries that travel together.
QUERY_ROWS = 256
#: Queries whose best rows a task keeps over its blocks.
HELD_QUERIES = 50_000
LARGEST = float(2**62)
#: Share by which a bound is widened against rounding of the table's 32-bit distances.
SLACK = 1e-6
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part, one row for each row."""
    value = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.lit(float(FACTOR)) * x)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), value.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    short = F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x) + 1) * (F.abs(x) + 1)) < LARGEST
    return rows.where(F.when(finite, short).otherwise(False)).select("vec_id", F.transform("v", lambda x: F.floor(x).cast("int")).alias("v"))


def sampled(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """At most SAMPLE_ROWS vectors and SAMPLE_BYTES, filled up with zeros to one width. A hash threshold thins the rows before the sort."""
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, width))))
    mixed = F.xxhash64(F.lit(11), "vec_id", "v")
    # about four times the bound pass the threshold
    thinned = rows if n <= 4 * bound else rows.where(F.pmod(mixed, F.lit(1 << 40)) < int((1 << 40) * 4 * bound / n))
    found = thinned.orderBy(mixed, "vec_id").limit(bound).select("v").collect()
    points = np.zeros((len(found), width))
    for i, row in enumerate(found):
        points[i, : len(row["v"])] = row["v"]
    return points


def spread_pivots(points: np.ndarray) -> np.ndarray:
    """The origin, then always the sampled vector farthest from the pivots chosen so far."""
    width = points.shape[1]
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * max(1, width)), len(points)))
    chosen, far = [np.zeros(width)], np.full(len(points), np.inf)
    if len(points):
        centre = points.mean(axis=0)
        chosen.append(points[((points - centre) ** 2).sum(axis=1).argmin()])
        far = ((points - chosen[1]) ** 2).sum(axis=1)
    while len(chosen) <= most and len(points) and far.max() > 0:
        chosen.append(points[far.argmax()])
        far = np.minimum(far, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots; a pivot is cut or filled up with zeros to the points' width, so it is a point of their space."""
    width = points.shape[1]
    own = np.zeros((len(pivots), width))
    own[:, : min(width, pivots.shape[1])] = pivots[:, :width]
    points = points.astype(np.float64)
    squares = (points**2).sum(axis=1)[:, None] + (own**2).sum(axis=1) - 2 * points @ own.T
    return np.sqrt(np.maximum(squares, 0))


def upper_bounds(query: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Greatest possible score of each row of the pivot table with the query, whose distances to the pivots are given alike. The first
    pivot is the origin, so its column holds the lengths."""
    apart = np.abs(table - query).max(axis=1)
    apart = np.maximum(0, apart - SLACK * (query[0] + table[:, 0].max(initial=0)))
    length = table[:, 0].astype(np.float64)
    both = query[0] ** 2 + length**2
    return 0.5 * (both - apart**2) + SLACK * both + 1


def _cells(vectors: pa.Array, pivots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, integer points, pivot table) of the batch's vectors, one width at a time."""
    sizes = np.asarray(vectors.value_lengths(), np.int64) if len(vectors) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    flat = np.asarray(vectors.flatten(), np.int32)
    for width in np.unique(sizes):
        own = np.flatnonzero(sizes == width)
        points = flat[(ends[own] - width)[:, None] + np.arange(width)]
        yield own, points, distances(points, pivots).astype(np.float32)


def _joined(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, width, cell, point, distances): the precomputed table, packed as 32-bit integers and floats, written out."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for own, points, table in _cells(_joined(batch.column(1)), held.value):
                cell = table[:, 1:].argmin(axis=1) if table.shape[1] > 1 else np.zeros(len(own), np.int64)
                for a in range(0, len(own), max(1, (4 << 20) // (4 * (points.shape[1] + table.shape[1])))):
                    part = slice(a, a + max(1, (4 << 20) // (4 * (points.shape[1] + table.shape[1]))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[own[part]], pa.int64()), pa.array(np.full(len(own[part]), points.shape[1]), pa.int32()), pa.array(cell[part], pa.int32()),
                            pa.array([p.tobytes() for p in points[part]], pa.binary()), pa.array([t.tobytes() for t in table[part]], pa.binary()),
                        ],
                        ["vec_id", "width", "cell", "point", "distances"],
                    )

    return cut_lineage(rows.mapInArrow(place, "vec_id bigint, width int, cell int, point binary, distances binary"))


def cell_summaries(table: DataFrame, width: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each cell its number of parts and the least and greatest distance to each pivot; combined inside the tasks first."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        size: dict[int, int] = {}
        for batch in batches:
            cells = np.asarray(batch.column(0))
            if not len(cells):
                continue
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(len(cells), width)
            nbytes = np.asarray(batch.column(2))
            for cell in np.unique(cells).tolist():
                own = cells == cell
                low[cell] = np.minimum(low.get(cell, np.inf), rows[own].min(axis=0))
                high[cell] = np.maximum(high.get(cell, -np.inf), rows[own].max(axis=0))
                size[cell] = size.get(cell, 0) + int(nbytes[own].sum())
        order = sorted(low)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(order, pa.int32()), pa.array([size[c] for c in order], pa.int64()),
                pa.array([low[c].astype(float).tolist() for c in order], pa.list_(pa.float64())), pa.array([high[c].astype(float).tolist() for c in order], pa.list_(pa.float64())),
            ],
            ["cell", "bytes", "low", "high"],
        )

    short = table.select("cell", "distances", (F.length("point") + F.length("distances") + 8).cast("bigint").alias("bytes"))
    each = short.mapInArrow(summarise, "cell int, bytes bigint, low array<double>, high array<double>")
    whole = each.groupBy("cell").agg(
        F.sum("bytes").alias("bytes"), *[F.min(F.col("low")[i]).alias(f"low{i}") for i in range(width)], *[F.max(F.col("high")[i]).alias(f"high{i}") for i in range(width)]
    )
    return {
        r["cell"]: (-(-r["bytes"] // PART_BYTES), np.array([r[f"low{i}"] for i in range(width)]), np.array([r[f"high{i}"] for i in range(width)]))
        for r in whole.collect()
    }


def _blocks(table: DataFrame, parts: Column) -> DataFrame:
    """(width, cell, part, ids, points, distances): one packed row for each part of a cell."""
    import pandas as pd

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        packed = (group["vec_id"].to_numpy(np.int64).tobytes(), b"".join(group["point"]), b"".join(group["distances"]))
        return pd.DataFrame([(*group[["width", "cell", "part"]].iloc[0].tolist(), *packed)], columns=["width", "cell", "part", "ids", "points", "distances"])

    dealt = table.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "vec_id"), parts).cast("int"))
    return cut_lineage(dealt.groupBy("width", "cell", "part").applyInPandas(pack, "width int, cell int, part int, ids binary, points binary, distances binary"))


def _allowed(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Greatest possible score of each query (its distances to the pivots) with anything inside the cell."""
    apart = np.maximum(np.maximum(low - query, query - high), 0).max(axis=1)
    apart = np.maximum(0, apart - SLACK * (query[:, 0] + high[0]))
    both = query[:, 0] ** 2 + high[0] ** 2
    return np.minimum(0.5 * (both - apart**2), query[:, 0] * high[0]) + SLACK * both + 1


def _product(points: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    """Exact scores: doubles hold every partial sum while the product of the lengths is below 2^52, 64-bit integers otherwise."""
    if small:
        return (points.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return (points.astype(np.int64) * query.astype(np.int64)).sum(axis=1)


def eliminate(query_id: int, query: np.ndarray, own: np.ndarray, floor: float, ids: np.ndarray, points: np.ndarray, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of the block's best ``k`` rows that reach ``floor``, and how many rows were evaluated. Rows come in the order of
    their bounds, in growing steps, until the next bound is below the k-th score."""
    bounds = upper_bounds(own, table)
    open_ = np.flatnonzero((bounds >= floor) & (ids != query_id))
    order = open_[np.argsort(-bounds[open_], kind="stable")]
    small = float(own[0]) * float(table[:, 0].max(initial=0)) < 2**52
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, step = 0, 4 * k
    while done < len(order) and not (len(best) == k and best[-1] > bounds[order[done]]):
        take = order[done : done + step]
        scores = _product(points[take], query, small)
        if len(best) == k:
            near = scores >= best[-1]
            scores, met = scores[near], take[near]
        else:
            met = take
        best_ids, best = np.append(best_ids, ids[met]), np.append(best, scores)
        kept = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[kept], best[kept]
        done, step = done + len(take), min(2 * step, STEP_ROWS)
    return best_ids, best, done


def _asked(queries: DataFrame, pivots, cells: dict[int, tuple[int, np.ndarray, np.ndarray]], home: bool) -> DataFrame:
    """(width, cell, part, query_ids, floors, queries): packed queries on their way to the parts they have to see; with ``home`` to one part
    of the nearest cell."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, floors = np.asarray(batch.column(0)), np.asarray(batch.column(2), np.float64)
            for own, points, table in _cells(_joined(batch.column(1)), pivots.value):
                exact = table.astype(np.float64)
                near = table[:, 1:].argmin(axis=1) if table.shape[1] > 1 else np.zeros(len(own), np.int64)
                for cell, (parts, low, high) in cells.items():
                    going = near == cell if home else _allowed(exact, low, high) >= floors[own]
                    places = np.flatnonzero(going)
                    step = max(1, min(QUERY_ROWS, (1 << 20) // (4 * max(1, points.shape[1]))))
                    for a in range(0, len(places), step):
                        some = places[a : a + step]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([points.shape[1]], pa.int32()), pa.array([cell], pa.int32()), pa.array([int(ids[own[some[0]]]) % parts if home else -1], pa.int32()), pa.array([parts], pa.int32()),
                                pa.array([ids[own[some]].tobytes()], pa.binary()), pa.array([floors[own[some]].tobytes()], pa.binary()), pa.array([points[some].tobytes()], pa.binary()),
                            ],
                            ["width", "cell", "only", "parts", "query_ids", "floors", "queries"],
                        )

    rows = queries.mapInArrow(route, "width int, cell int, only int, parts int, query_ids binary, floors binary, queries binary")
    targets = F.when(F.col("only") >= 0, F.array("only")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return rows.withColumn("part", F.explode(targets)).drop("only", "parts")


def _visit(blocks: DataFrame, asked: DataFrame, pivots, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best rows of every part a query visits, combined over the parts of a task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def found() -> pa.RecordBatch:
            sizes = [len(x) for x, _ in held.values()]
            columns = [np.repeat(np.array(list(held), np.int64), sizes)]
            columns += [np.concatenate([np.zeros(0, np.int64), *[x[j] for x in held.values()]]) for j in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(len(batch)):
                width, ids, points, table, query_ids, floors, queries = (batch.column(j)[i].as_py() for j in range(7))
                ids, query_ids, floors = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64), np.frombuffer(floors)
                points, table = np.frombuffer(points, np.int32).reshape(len(ids), width), np.frombuffer(table, np.float32).reshape(len(ids), -1)
                queries = np.frombuffer(queries, np.int32).reshape(len(query_ids), width)
                for query_id, query, own, floor in zip(query_ids.tolist(), queries, distances(queries, pivots.value).astype(np.float32), floors.tolist(), strict=True):
                    known = held.get(query_id)
                    if known is not None and len(known[1]) == k:
                        floor = max(floor, float(known[1][-1]))
                    best_ids, best, _ = eliminate(query_id, query, own, floor, ids, points, table, k)
                    if known is not None:
                        best_ids, best = np.append(known[0], best_ids), np.append(known[1], best)
                        kept = np.lexsort((best_ids, -best))[:k]
                        best_ids, best = best_ids[kept], best[kept]
                    held[query_id] = best_ids, best
                if len(held) >= HELD_QUERIES:
                    yield found()
                    held = {}
        yield found()

    met = blocks.join(asked, ["width", "cell", "part"])
    return met.select("width", "ids", "points", "distances", "query_ids", "floors", "queries").mapInArrow(compare, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the exact ``k`` best candidates of each row for which ``is_query`` (over vec_id) holds."""
    rows = cut_lineage(integer_vectors(embeddings))
    spark = rows.sparkSession
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not known["n"]:
        return spark.createDataFrame([], RESULT)
    chosen = spread_pivots(sampled(rows, known["n"], known["width"]))
    pivots = spark.sparkContext.broadcast(chosen)
    table = pivot_table(rows, chosen)
    cells = cell_summaries(table, len(chosen))
    parts = F.element_at(F.create_map(*[F.lit(x) for cell, own in cells.items() for x in (cell, own[0])]), F.col("cell"))
    blocks = _blocks(table, parts)
    queries = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    nothing = queries.withColumn("floor", F.lit(float("-inf")))
    near = _visit(blocks, _asked(nothing, pivots, cells, home=True), pivots, k)
    kth = _ranked(near, k).groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("n"))
    floors = queries.join(kth.where(F.col("n") == k).drop("n"), "query_id", "left")
    asked = _asked(floors.select("query_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("floor")), pivots, cells, home=False)
    return _ranked(_visit(blocks, asked, pivots, k), k)
