"""Joins and row comparisons that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vacantia.session import cut_lineage

HOT_KEYS = 1000
HOT_ROWS = 100_000
SMALL_ROWS = 100_000


def hot_keys(rows: DataFrame, key: str, limit: int = HOT_KEYS, at_least: int = HOT_ROWS) -> DataFrame:
    """The most frequent keys, at most ``limit`` of them: the counts are combined before the shuffle
    and the list has a fixed size bound, so it may be broadcast whatever the input size."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col(key).isNotNull() & (F.col("_n") >= at_least))
    return counts.orderBy(F.desc("_n"), F.asc(key)).limit(limit).select(key)


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, *, row_count: int | None = None, limit: int = HOT_KEYS,
    at_least: int = HOT_ROWS,
) -> DataFrame:
    """Left join of rows with a lookup that has each key once.

    Rows of the hottest keys and rows without a key skip the shuffle: the first meet a broadcast of at
    most ``limit`` lookup rows, the second get nulls. All other rows take an ordinary equi-join in which
    no key holds more than the remaining share. Every row comes out exactly once. With a known
    ``row_count`` below ``at_least`` no key can be hot and the plain join is used. Rows are read several
    times, so pass them materialized; the lookup is materialized here.
    """
    if row_count is not None and row_count < at_least:
        return rows.join(lookup, key, "left")
    lookup = cut_lineage(lookup)
    values = [c for c in lookup.columns if c != key]
    hot = hot_keys(rows, key, limit, at_least)
    hot_lookup = lookup.join(F.broadcast(hot), key, "left_semi").withColumn("_hot", F.lit(True))
    flagged = rows.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), key, "left")
    is_hot = F.coalesce("_is_hot", F.lit(False))
    columns = [*rows.columns, *values]
    by_broadcast = flagged.filter(is_hot).join(F.broadcast(hot_lookup), key, "left").select(*columns)
    by_shuffle = flagged.filter(~is_hot & F.col(key).isNotNull()).join(lookup, key, "left").select(*columns)
    types = {f.name: f.dataType for f in lookup.schema.fields}
    without = rows.filter(F.col(key).isNull()).select(
        *rows.columns, *[F.lit(None).cast(types[v]).alias(v) for v in values]
    )
    return by_broadcast.unionByName(by_shuffle).unionByName(without)


def checked_join(rows: DataFrame, lookup: DataFrame, key: str, small: int = SMALL_ROWS) -> DataFrame:
    """Left join with a lookup that has each key once: broadcast when a count shows it is small, else
    ``lookup_join``."""
    if lookup.count() <= small:
        return rows.join(F.broadcast(lookup), key, "left")
    return lookup_join(cut_lineage(rows), lookup, key)


def checked_semi_join(rows: DataFrame, keys: DataFrame, key: str, small: int = SMALL_ROWS) -> DataFrame:
    """Rows whose key is among distinct ``keys``, however many rows one key has."""
    marked = checked_join(rows, keys.withColumn("_found", F.lit(True)), key, small)
    return marked.filter(F.col("_found").isNotNull()).select(*rows.columns)


def in_ranges(rows: DataFrame, order: str, target_rows: int, name: str = "_chunk") -> DataFrame:
    """Add the number of the order-value range that a row lies in; each range holds about ``target_rows`` rows however the values are spread.

    The ends come from a quantile sketch, so values that bunch up get narrow ranges. Rows of equal order stay together. Only the sizes of the
    ranges depend on the sketch; what is computed from them does not.
    """
    from pyspark.ml.feature import Bucketizer  # only here: Python workers that import this module need not carry it

    n = rows.count()
    k = -(-n // max(1, target_rows))
    if k <= 1:
        return rows.withColumn(name, F.lit(0))
    probabilities = [i / k for i in range(1, k)]
    ends = sorted(set(rows.withColumn("_order", F.col(order).cast("double")).approxQuantile("_order", probabilities, 1 / (5 * k))))
    if not ends:
        return rows.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *ends, float("inf")], inputCol="_order", outputCol=name, handleInvalid="keep")
    placed = cut.transform(rows.withColumn("_order", F.col(order).cast("double"))).drop("_order")
    return placed.withColumn(name, F.col(name).cast("int"))


def previous_value(
    rows: DataFrame, group: str, order: str, value: Column, name: str, target_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the value of the preceding row of the group, like ``lag``, without sorting a group in one task.

    Each group is cut into ranges of the order column. Inside a range a window gives the predecessor; the
    first row of a range takes the last value of the range before it, from a table of one row per range.
    """
    cut = in_ranges(rows.withColumn("_value", value), order, target_rows)
    inside = W.partitionBy(group, "_chunk").orderBy(order)
    marked = cut.withColumns({"_prev": F.lag("_value").over(inside), "_first": F.row_number().over(inside) == 1})
    lasts = cut.groupBy(group, "_chunk").agg(F.max_by("_value", order).alias("_last"))
    before = lasts.withColumn("_before", F.lag("_last").over(W.partitionBy(group).orderBy("_chunk")))
    joined = marked.join(before.select(group, "_chunk", "_before"), [group, "_chunk"], "left")
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev"))).drop(
        "_chunk", "_value", "_prev", "_first", "_before"
    )


def running_max(
    rows: DataFrame, group: str, order: str, value: Column, name: str, target_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the highest value up to each row of its group, cut into order ranges like ``previous_value``."""
    cut = in_ranges(rows.withColumn("_value", value), order, target_rows)
    so_far = W.partitionBy(group, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    inside = cut.withColumn("_inside", F.max("_value").over(so_far))
    tops = cut.groupBy(group, "_chunk").agg(F.max("_value").alias("_top"))
    earlier = W.partitionBy(group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    before = tops.select(group, "_chunk", F.max("_top").over(earlier).alias("_before"))
    joined = inside.join(before, [group, "_chunk"], "left")
    return joined.withColumn(name, F.greatest("_inside", "_before")).drop("_chunk", "_value", "_inside", "_before")
