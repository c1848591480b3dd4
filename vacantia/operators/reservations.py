"""Budget of outside calls shared by overlapping runs: a run reserves its calls in a table before it makes them.

A reservation is one row (run_key, day, calls, by_day). What a day has used is the usage recorded for it and what runs have reserved and not
settled yet. A reservation depends on all buckets of the table: when another run reserved meanwhile, it is computed again. The commit
that records a run's usage takes its reservation out, so nothing counts twice; a run that dies keeps it and gets the same one on its replay.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import StructType

from vacantia.operators.commits import Change, CommitLog, State
from vacantia.operators.metrics import day_bounds, usage_in_window
from vacantia.operators.snapshots import read_parts, read_rows, retried, staged, staged_change, touched_buckets

TABLE = "llm_reservations"
SCHEMA = "run_key string, day date, calls bigint, by_day boolean"
BUCKETS = 8


@dataclass(frozen=True)
class Reservation:
    """Calls a run may make; ``by_day`` when it is the day's cap that limits it."""

    run_key: str
    calls: int
    by_day: bool


def used_today(spark: SparkSession, root: str, state: State, as_of: datetime) -> int:
    """Recorded and reserved calls of the day of ``as_of``."""
    start, end = day_bounds(as_of)
    usage = read_rows(spark, root, "llm_usage")
    recorded = usage_in_window(usage, "calls", start, end).first()["used"] if usage is not None else 0
    table = state.table(TABLE)
    if not table.version:
        return recorded
    waiting = read_parts(spark, table).filter(F.col("day") == F.lit(start.date())).agg(F.coalesce(F.sum("calls"), F.lit(0))).first()[0]
    return recorded + waiting


def reserve_calls(spark: SparkSession, root: str, run_key: str, as_of: datetime, wanted: int, daily_cap: int, run_cap: int) -> Reservation:
    """Reserve up to ``wanted`` calls; the day's cap is looked at first, then the run's. A run that has a reservation gets that one."""
    given: list[Reservation] = []

    def work(state: State) -> State | None:
        given.clear()
        table = state.table(TABLE)
        if table.version:
            own = read_parts(spark, table).filter(F.col("run_key") == run_key).first()
            if own is not None:
                given.append(Reservation(run_key, own["calls"], own["by_day"]))
                return None
        day_left = max(0, daily_cap - used_today(spark, root, state, as_of))
        given.append(Reservation(run_key, min(wanted, day_left, run_cap), day_left <= run_cap))
        start, _ = day_bounds(as_of)
        row = spark.createDataFrame([(run_key, start.date(), given[0].calls, given[0].by_day)], SCHEMA)
        if not table.version:
            change = staged(row, root, TABLE, 1, "run_key", BUCKETS)
        else:
            touched = touched_buckets(row, "run_key", table.buckets)
            rows = read_parts(spark, table, touched).unionByName(row)
            change = staged(rows, root, TABLE, table.version + 1, "run_key", table.buckets, touched, read=list(table.parts))
        return CommitLog(spark, root).commit(state, [change])

    retried(work, spark, root)
    return given[0]


def settled(spark: SparkSession, root: str, state: State, reservation: Reservation) -> Change:
    """The table without the reservation, for the commit that records the run's usage."""
    own = spark.createDataFrame([(reservation.run_key,)], "run_key string")
    schema = StructType.fromDDL(SCHEMA)
    return staged_change(spark, root, state.table(TABLE), TABLE, "run_key", own, lambda df: df.filter(F.col("run_key") != reservation.run_key), schema)
