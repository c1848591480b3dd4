"""The index of match keys: for every key of a queue row, in buckets by key, the row's id and all its keys.

A batch looks up its own keys, then the further keys of the rows it found, until nothing new turns up; what it found are exactly the queue
rows of its entities, however long the chains. Only the buckets of those keys are read, and only the buckets of keys that rows lose or
gain are rewritten. The index is committed together with the queue. A writer that changes which rows or keys the queue has without
the index leaves it behind; ``current_index`` sees that from the versions of the queue's buckets and builds it anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacantia.functions.keys import entity_keys
from vacantia.operators.commits import Change, CommitLog, State, TableState
from vacantia.operators.skew import checked_semi_join
from vacantia.operators.snapshots import BUCKETS, read_parts, staged, touched_buckets
from vacantia.session import cut_lineage

INDEX = "queue_keys"
QUEUE = "job_queue"
KEYS = ("key_fingerprint", "key_posting", "key_link")
KEY_COLUMNS = ["canonical_fingerprint", "company_key", "title_key", "location_key", "post_date_key", "company", "title", "url"]
SCHEMA = "key string, id string, keys array<string>"


def row_keys(rows: DataFrame) -> DataFrame:
    """(id, keys): the digests of the keys that each row has."""
    return entity_keys(rows).select("id", F.array_compact(F.array(*KEYS)).alias("keys"))


def index_rows(rows: DataFrame) -> DataFrame:
    """(key, id, keys): one row for each key of each row."""
    return row_keys(rows).select(F.explode(F.array_distinct("keys")).alias("key"), "id", "keys")


def is_current(state: State) -> bool:
    """The index has seen every change of rows or keys in the queue."""
    queue, index = state.table(QUEUE), state.table(INDEX)
    return bool(index.version) and all(queue.key_version(b) <= index.followed for b in queue.parts)


def current_index(spark: SparkSession, root: str, state: State, buckets: int = BUCKETS) -> State:
    """The state with an index that is up to date; one scan of the queue's key columns if it was not."""
    if is_current(state):
        return state
    rows = index_rows(read_parts(spark, state.table(QUEUE)).select("id", *KEY_COLUMNS)) if state.table(QUEUE).version else spark.createDataFrame([], SCHEMA)
    built = staged(rows, root, INDEX, state.table(INDEX).version + 1, "key", state.table(INDEX).buckets if state.table(INDEX).version else buckets, split_by="id")
    return CommitLog(spark, root).commit(state, [replace(built, follows=QUEUE, followed=state.table(QUEUE).version)])


def reachable(spark: SparkSession, index: TableState, keys: DataFrame) -> tuple[DataFrame, list[int]]:
    """((id, keys) of every queue row connected to the keys, buckets that were read). Each round follows the keys it has not
    followed yet and writes what it found."""
    frontier = cut_lineage(keys.filter(F.col("key").isNotNull()).select("key").distinct())
    followed, found, read = frontier, None, set()
    while True:
        wanted = touched_buckets(frontier, "key", index.buckets)
        read.update(wanted)
        met = checked_semi_join(read_parts(spark, index, wanted), frontier, "key").select("id", "keys").distinct()
        if found is not None:
            met = met.join(found.select("id"), "id", "left_anti")
        met = cut_lineage(met)
        found = met if found is None else found.unionByName(met)
        further = met.select(F.explode("keys").alias("key")).distinct().join(followed, "key", "left_anti")
        frontier = cut_lineage(further)
        if not frontier.limit(1).count():
            return found, sorted(read)
        followed = followed.unionByName(frontier)


def index_change(
    spark: SparkSession, root: str, index: TableState, queue_version: int, lost: DataFrame, gained: DataFrame, read: Sequence[int] = ()
) -> Change:
    """The index after rows (id, keys) lost all their keys and rows (id, keys) gained theirs; a row may be in both."""
    lost, gained = cut_lineage(lost), cut_lineage(gained)
    keys = lost.unionByName(gained).select(F.explode("keys").alias("key")).distinct()
    touched = touched_buckets(keys, "key", index.buckets)
    kept = read_parts(spark, index, touched).join(lost.select("id").distinct(), "id", "left_anti")
    added = gained.select(F.explode(F.array_distinct("keys")).alias("key"), "id", "keys")
    rows = kept.select("key", "id", "keys").unionByName(added)
    done = staged(rows, root, INDEX, index.version + 1, "key", index.buckets, touched, split_by="id", read=read)
    return replace(done, follows=QUEUE, followed=queue_version)
