"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled by a hash of their id. A copy of a document has a virtual time: the tokens its source has
served up to the middle of the copy, divided by the source's target. All copies are range-sorted by virtual time
and served until the total budget is used, so a source's share at any moment follows its target. A source may be passed three times at most.

Targets: the whole corpus size is shared by weight; a share above three times the source's size is cut to that, and
the excess is shared again by weight until none is above. In the order of size to weight this is a prefix of cut
sources and one common level for the rest, which two running sums find.

Running totals over documents are made without sorting a source in one task: range partitions are summed, the sums are
accumulated, and each partition continues from its sum. Only tables of a row for each source or each partition meet in one task.

Defined results: null text has size 0; the null source is a source, last in order; documents of size 0 are never taken; equal rows
may differ in copies by one; an empty table or one without words gives target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia.llm.common import cut_lineage, free_name, partitions

WEIGHTS = (5, 2, 1)
PASSES = 3
NO_ID = -(1 << 63)
_BLANK = r"[\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    """Number of runs of non-blank characters: each run with the blanks around it becomes one letter."""
    letters = F.regexp_replace(text, rf"{_BLANK}*[^\x20\x09-\x0D]+{_BLANK}*", "x")
    return F.coalesce(F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("bigint")


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of a digest of the id: the shuffled order is the same in every run and on every machine."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, rank, source_size, target) of each source, from (source, size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("bigint")
    rows = rows.withColumns({"weight": weight, "cap": passes * F.col("source_size")})
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "place": F.row_number().over(filling),
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    fits = F.col("cap") * F.col("weights") >= F.col("weight") * F.col("left")
    first = F.min(F.when(fits, F.struct("place", "left", "weights"))).over(every)
    share = (F.col("weight") * F.col("first.left")).cast("double") / F.col("first.weights").cast("double")
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap").cast("double")).otherwise(share)
    return rows.withColumn("first", first).select("source", "rank", "source_size", target.alias("target"))


def running_total(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` up to each row, within ``group`` in the given order, without one task per group."""
    part, inside, earlier = "part_", "inside_", "earlier_"
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *group, *order)
    ranged = cut_lineage(ranged.withColumn(part, F.spark_partition_id()))
    so_far = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(part, *group).agg(F.sum(value).alias("sum_"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(part, *group, F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias(earlier))
    rows = ranged.withColumn(inside, F.sum(value).over(so_far)).join(sums, [part, *group])
    return rows.withColumn(name, F.col(inside) + F.col(earlier)).drop(part, inside, earlier)


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, carry: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies), and the column ``carry``, for each row of documents; taken words are size times copies."""
    kept = [carry] if carry else []
    sized = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), *kept)
    sized = cut_lineage(sized)
    named = cut_lineage(targets(sized, weights, passes))
    rows = sized.join(named, sized["source"].eqNullSafe(named["source"])).drop("source")
    rows = rows.withColumns({"key": shuffle_key(F.col("doc_id")), "id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))})
    rows = cut_lineage(running_total(rows, ["rank"], ["key", "id", "size"], "size", "served"))

    def middle(turn: Column) -> Column:
        return (turn * F.col("source_size") + F.col("served") - F.col("size") / 2) / F.col("target")

    copies = rows.where("size > 0 and target > 0").select("rank", "key", "id", "size", F.explode(F.array(*map(F.lit, range(passes)))).alias("turn"), "source_size", "served", "target")
    place = ["time", "rank", "key", "id", "size", "turn"]
    timed = copies.select(middle(F.col("turn")).alias("time"), *place[1:])
    budget = sized.agg(F.sum("size")).first()[0] or 0
    queue = running_total(timed, [], place, "size", "total")
    last = queue.where(F.col("total") - F.col("size") / 2 <= budget).agg(F.max(F.struct(*place)).alias("last")).first()["last"]
    if last is None:
        served = F.lit(0)
    else:
        until = F.struct(*(F.lit(last[c]).alias(c) for c in place))
        served = sum(
            F.when(F.struct(middle(F.lit(t)).alias("time"), *place[1:-1], F.lit(t).alias("turn")) <= until, 1).otherwise(0) for t in range(passes)
        )
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), served).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("copies"), *kept)


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, a row for each copy."""
    row, copy = free_name(documents, "row_"), free_name(documents, "copy_")
    numbered = cut_lineage(documents.withColumn(row, F.monotonically_increasing_id()))
    counts = mix(numbered, carry=row, **options).where("copies > 0").select(row, F.col("copies").alias(copy))
    return numbered.join(counts, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*documents.columns)
