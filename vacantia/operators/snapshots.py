"""Durable tables: Parquet folders in hash buckets, made visible by the commit log of their root folder.

Every attempt writes to a folder of its own, so writers never touch each other's files and a job that dies leaves files nobody reads. A commit
makes the new buckets of one or several tables, and appended rows, visible at once. Of two writers that read the same version, the second
one's buckets go on top of the first one's if they are others; if they are the same, it gets WriteConflict and computes its change again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vacantia.operators.commits import Change, CommitLog, State, TableState, WriteConflict

BUCKETS = 32
ATTEMPTS = 20


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def table_state(spark: SparkSession, root: str) -> State:
    return CommitLog(spark, root).state()


def latest_version(spark: SparkSession, root: str, name: str) -> int:
    """Newest visible version, 0 when there is none."""
    return table_state(spark, root).table(name).version


def latest_batch(spark: SparkSession, root: str, stream: str) -> int:
    """Newest micro-batch of the stream that is visible, -1 when there is none. Versions belong to a table and grow with any
    writer; batch numbers belong to the stream."""
    return table_state(spark, root).marks.get(stream, -1)


def touched_buckets(ids: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets that hold any of the ids: at most ``buckets`` numbers."""
    return sorted(r[0] for r in ids.select(bucket_of(key, buckets)).distinct().collect())


def staged(
    df: DataFrame, root: str, name: str, version: int, key: str | None = None, buckets: int = BUCKETS, touched: Sequence[int] | None = None,
    sort_by: str | None = None, files_per_bucket: int = 1, read: Sequence[int] = (), same_keys: bool = False, split_by: str | None = None,
) -> Change:
    """Write the files of a change that is to become ``version`` and was computed from the one before; a commit makes them visible.

    With a ``key`` rows go to hash buckets; ``touched`` names the buckets that ``df`` holds in full, and the other buckets keep their older
    files. ``sort_by`` clusters rows inside files for scan pruning. A bucket has ``files_per_bucket`` files, dealt by ``split_by``, by default the key.
    """
    path = f"{root.rstrip('/')}/{name}/v={version}-{uuid.uuid4().hex}"
    schema = json.loads(T.StructType([f for f in df.schema.fields if f.name != "bucket" or key is None]).json())
    if key is None:
        df.write.parquet(path)
        return Change(name, version, {0: path}, None, 1, schema, True)
    placed = df.drop("bucket").withColumn("bucket", bucket_of(key, buckets))
    if touched is not None:
        placed = placed.filter(F.col("bucket").isin(*touched)) if touched else placed.limit(0)
    split = placed.repartition(F.col("bucket"), F.pmod(F.xxhash64(F.lit(1), F.col(split_by or key)), F.lit(files_per_bucket)))
    clustered = split.sortWithinPartitions("bucket", *([sort_by] if sort_by else []))
    clustered.write.partitionBy("bucket").parquet(path)
    held = range(buckets) if touched is None else touched
    return Change(name, version, dict.fromkeys(held, path), key, buckets, schema, touched is None, read, same_keys)


def write_snapshot(
    df: DataFrame, root: str, name: str, version: int, key: str | None = None, buckets: int = BUCKETS,
    touched: Sequence[int] | None = None, sort_by: str | None = None, files_per_bucket: int = 1, stream: str | None = None,
    batch: int | None = None, same_keys: bool = False,
) -> int:
    """Write a version computed from the one before and make it visible; gives the number it got, which is higher when others came
    first and changed other buckets. ``stream`` and ``batch`` name the micro-batch that the version holds. Raises WriteConflict."""
    log = CommitLog(df.sparkSession, root)
    base = log.state()
    change = staged(df, root, name, version, key, buckets, touched, sort_by, files_per_bucket, same_keys=same_keys)
    return log.commit(base, [change], stream=stream, batch=batch).table(name).version


def read_parts(spark: SparkSession, table: TableState, only: Sequence[int] | None = None) -> DataFrame:
    """Rows of the buckets asked for, or of all; the scan skips the other bucket folders. An empty frame when there are none."""
    schema = T.StructType.fromJson(table.schema)
    by_path: dict[str, list[int]] = {}
    for bucket, (_, path) in table.parts.items():
        if only is None or table.key is None or bucket in only:
            by_path.setdefault(path, []).append(bucket)
    if not by_path:
        return spark.createDataFrame([], schema)
    if table.key is None:
        return spark.read.schema(schema).parquet(*by_path)
    placed = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    parts = [spark.read.schema(placed).parquet(path).filter(F.col("bucket").isin(*held)).drop("bucket") for path, held in sorted(by_path.items())]
    return reduce(DataFrame.unionByName, parts)


def read_snapshot(spark: SparkSession, root: str, name: str, only: Sequence[int] | None = None) -> DataFrame | None:
    """Newest version of every bucket, or of the buckets asked for; None when there is no such table."""
    table = table_state(spark, root).table(name)
    return read_parts(spark, table, only) if table.version else None


def staged_rows(df: DataFrame, root: str, name: str, writer: str, version: int) -> str:
    """Write rows that a commit may append; gives their folder. Writer and version become columns."""
    path = f"{root.rstrip('/')}/{name}/writer={writer}/version={version}/attempt={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def append_rows(df: DataFrame, root: str, name: str, version: int, writer: str = "run") -> None:
    """Append-only facts. Versions of a writer grow; a version that is visible already is not appended again."""
    log = CommitLog(df.sparkSession, root)
    base, stream = log.state(), f"{name}/{writer}"
    if base.marks.get(stream, -1) < version:
        log.commit(base, [], {name: [staged_rows(df, root, name, writer, version)]}, stream, version)


def read_rows(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """All visible appended rows with their ``writer`` and ``version``; None when there are none."""
    paths = CommitLog(spark, root).appended(name)
    return spark.read.option("basePath", f"{root.rstrip('/')}/{name}").parquet(*paths).drop("attempt") if paths else None


def retried(work: Callable[[State], State | None], spark: SparkSession, root: str) -> State | None:
    """Run ``work``, which computes from a state and commits, again from the newest state while other writers get in its way."""
    for attempt in range(ATTEMPTS):
        try:
            return work(table_state(spark, root))
        except WriteConflict:
            if attempt == ATTEMPTS - 1:
                raise
    return None


def staged_change(
    spark: SparkSession, root: str, table: TableState, name: str, key: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame],
    schema: T.StructType, sort_by: str | None = None, same_keys: bool = False,
) -> Change:
    """Write ``change`` of the buckets that hold the ids; it may add rows of those ids. A table without buckets is written whole and gets
    them."""
    fresh = not table.version or table.key is None
    buckets = BUCKETS if fresh else table.buckets
    touched = None if fresh else touched_buckets(ids, key, buckets)
    part = read_parts(spark, table, touched) if table.version else spark.createDataFrame([], schema)
    return staged(change(part), root, name, table.version + 1, key, buckets, touched, sort_by, same_keys=same_keys and not fresh)


def change_table(
    spark: SparkSession, root: str, name: str, key: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame], schema: T.StructType,
    stream: str | None = None, batch: int | None = None, sort_by: str | None = None, same_keys: bool = False,
) -> State | None:
    """Apply ``change`` to the buckets that hold the ids, on top of whatever other writers do meanwhile; with a stream once for each of its
    micro-batches."""
    def work(state: State) -> State | None:
        if stream is not None and state.marks.get(stream, -1) >= batch:
            return None
        done = staged_change(spark, root, state.table(name), name, key, ids, change, schema, sort_by, same_keys)
        return CommitLog(spark, root).commit(state, [done], stream=stream, batch=batch)

    return retried(work, spark, root)
