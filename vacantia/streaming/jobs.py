"""The recurring jobs as Structured Streaming queries over landed files."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from vacantia.config import GateOptions, KeywordRules, Profile
from vacantia.functions.dates import instant
from vacantia.operators.commits import CommitLog, State
from vacantia.operators.filters import freshness_class, freshness_filter
from vacantia.operators.fit_review import (
    apply_llm_results, batch_outcome, complete_batches, reconcile_results, result_events, settle_items, upsert_fit_cache,
)
from vacantia.operators.metrics import freshness_stats
from vacantia.operators.snapshots import BUCKETS, bucket_of, read_parts, retried, staged, staged_change, staged_rows, touched_buckets
from vacantia.plans.table_run import RunSettings, number_rows, run_on_tables
from vacantia.schemas import TABLES, empty_table, evolve_schema
from vacantia.session import cut_lineage


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def result_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value) stream of result files, one JSON answer per line. Positions order lines as they were written, however tasks read them: by
    the file's time, its path and the split's start in the file; a task reads the lines of a split in order."""
    lines = spark.readStream.format("text").load(path)
    meta = F.col("_metadata")
    position = F.struct(F.unix_micros(meta["file_modification_time"]).alias("time"), meta["file_path"].alias("path"), meta["file_block_start"].alias("start"))
    return lines.select(position.alias("position"), "value")


def stream_ingest(
    postings: DataFrame, root: str, checkpoint: str, rules: KeywordRules, profile: Profile, options: GateOptions,
    as_of: datetime | None = None, interval: str | None = None, name: str = "ingest", **settings,
) -> StreamingQuery:
    """Every micro-batch is one ingest run (``run_on_tables``) into the tables below ``root``, visible by one commit with its run row; more
    ``settings`` are those of ``RunSettings``. The clock is read for each micro-batch. A replayed micro-batch is skipped when it is visible and run again when it
    is not. Without ``interval`` the stream processes what is there and stops."""
    told = RunSettings(rules, profile, options, **settings)

    def run(batch: DataFrame, batch_id: int) -> None:
        run_on_tables(batch.sparkSession, root, batch, told, as_of or datetime.now().astimezone(), name, batch_id)

    writer = postings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stream_dedup(
    postings: DataFrame, event_time: str, key: str = "canonical_fingerprint", delay: str = "30 days", salts: int = 16
) -> DataFrame:
    """First posting of each key while the key is within the watermark; state stays bounded by the delay.

    A first pass drops repeats per key and salt, so a key with very many postings is spread over tasks and
    leaves at most ``salts`` rows for the pass per key.
    """
    timed = postings.withWatermark(event_time, delay)
    salted = timed.withColumn("_salt", F.pmod(F.xxhash64(event_time), F.lit(salts)))
    return salted.dropDuplicatesWithinWatermark([key, "_salt"]).drop("_salt").dropDuplicatesWithinWatermark([key])


def late_rows(postings: DataFrame, hours: int, allow_unknown: bool, as_of: datetime) -> DataFrame:
    """Postings with their freshness class; the late ones are counted, the kept ones go on."""
    return postings.withColumn("freshness", freshness_class(hours, allow_unknown, as_of))


def stream_fresh(
    postings: DataFrame, root: str, checkpoint: str, hours: int, allow_unknown: bool = False, as_of: datetime | None = None, name: str = "fresh",
) -> StreamingQuery:
    """Fresh postings go to the rows of ``fresh_postings``, the dropped ones are counted by source in ``freshness_counts``, both by one commit for each
    micro-batch. Age is measured against the clock at the start of the micro-batch, not against other postings."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, as_of or datetime.now().astimezone()
        log = CommitLog(spark, root)
        state = log.state()
        if state.marks.get(name, -1) >= batch_id:
            return
        rows = {
            "fresh_postings": freshness_filter(batch, hours, allow_unknown, now),
            "freshness_counts": freshness_stats(batch, hours, allow_unknown, now).withColumn("as_of", instant(now)),
        }
        log.commit(state, [], {t: [staged_rows(df, root, t, name, batch_id)] for t, df in rows.items()}, name, batch_id)

    return postings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(usage: DataFrame, amount: str, event_time: str = "created_at", delay: str = "1 day") -> DataFrame:
    """(day, used) per calendar day."""
    daily = usage.withWatermark(event_time, delay).groupBy(F.window(event_time, "1 day")).agg(F.sum(amount).alias("used"))
    return daily.select(F.col("window.start").alias("day"), "used")


MONTHS = "month date, used bigint, days bigint, last_day date"


def stream_usage(
    usage: DataFrame, amount: str, root: str, checkpoint: str, event_time: str = "created_at", delay: str = "1 day", name: str = "usage",
) -> StreamingQuery:
    """Calendar-day and calendar-month sums. A day is summed by the stream's state and leaves it once, when the watermark has passed its end; events
    that come later still are dropped. Closed days are appended to ``usage_days`` (day, used) and added to their month in
    ``usage_months`` (month, used, days, last_day), by one commit. State holds open days only; months live in the table."""
    daily = usage_windows(usage, amount, event_time, delay)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = cut_lineage(batch.select(F.to_date("day").alias("day"), F.coalesce(F.col("used").cast("bigint"), F.lit(0)).alias("used")))
        if not days.limit(1).count():
            return
        months = days.groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("used").alias("used"), F.count("*").alias("days"), F.max("day").alias("last_day"))

        def add(part: DataFrame) -> DataFrame:
            both = part.unionByName(months)
            return both.groupBy("month").agg(F.sum("used").alias("used"), F.sum("days").alias("days"), F.max("last_day").alias("last_day"))

        def work(state: State) -> State | None:
            if state.marks.get(name, -1) >= batch_id:
                return None
            change = staged_change(spark, root, state.table("usage_months"), "usage_months", "month", months, add, T.StructType.fromDDL(MONTHS))
            rows = {"usage_days": [staged_rows(days, root, "usage_days", name, batch_id)]}
            return CommitLog(spark, root).commit(state, [change], rows, name, batch_id)

        retried(work, spark, root)

    writer = daily.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def seen_state(postings: DataFrame, key: str, event_time: str) -> DataFrame:
    """First and last time and number of sightings of each key."""
    return postings.groupBy(key).agg(
        F.min(event_time).alias("first_seen_at"), F.max(event_time).alias("last_seen_at"), F.count("*").alias("n_seen")
    )


def stream_seen(
    postings: DataFrame, root: str, checkpoint: str, key: str, event_time: str, name: str = "seen", keep: timedelta | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """``seen_state`` kept up to date in a table: a micro-batch is reduced to its keys first, and only the buckets of those keys are read and rewritten.
    The rows of its keys as they are now are appended to ``seen_changes``; nothing else is emitted.

    The state is the table, so the number of keys has no bound in memory and a lost checkpoint loses nothing that is visible.
    With ``keep`` a key not seen for that long before its bucket's newest sighting expires when the bucket is rewritten; it starts anew if it comes back.
    A null key is a key like any other."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = cut_lineage(seen_state(batch, key, event_time))

        def merged(part: DataFrame) -> DataFrame:
            both = part.unionByName(own).groupBy(key).agg(
                F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("n_seen").alias("n_seen")
            )
            if keep is None:
                return both
            newest = both.groupBy(bucket_of(key, buckets).alias("_bucket")).agg(F.max("last_seen_at").alias("_newest"))  # a row for each bucket
            live = both.withColumn("_bucket", bucket_of(key, buckets)).join(F.broadcast(newest), "_bucket")
            return live.filter(F.col("last_seen_at") >= F.col("_newest") - F.lit(keep)).select(*both.columns)

        def work(state: State) -> State | None:
            if state.marks.get(name, -1) >= batch_id:
                return None
            table = state.table("seen_state")
            count = table.buckets if table.version else buckets
            touched = touched_buckets(own, key, count) if table.version else None
            rows = cut_lineage(merged(read_parts(spark, table, touched) if table.version else own.limit(0)))
            change = staged(rows, root, "seen_state", table.version + 1, key, count, touched)
            hits = own.select(F.col(key).alias("_key"))
            changed = rows.join(hits, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
            return CommitLog(spark, root).commit(state, [change], {"seen_changes": [staged_rows(changed, root, "seen_changes", name, batch_id)]}, name, batch_id)

        retried(work, spark, root)

    return postings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_llm_results(
    results: DataFrame, root: str, checkpoint: str, threshold: int, as_of: datetime | None = None, name: str = "results"
) -> StreamingQuery:
    """Apply result lines (position, value) to the tables below ``root``: the answers go to the cache, items and batches are settled, usage and events are
    appended, and the postings in ``job_queue`` get their verdict, each table in its touched buckets and all by one commit. A replayed
    micro-batch is skipped when it is visible; when another writer changed the same buckets, it is applied to their new rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = as_of or datetime.now().astimezone()
        placed = batch.withColumn("place", F.monotonically_increasing_id())  # ascends within a split
        lines = number_rows(placed, "position", "place").drop("position", "place")  # of two answers for a posting the later line wins

        def work(state: State) -> State | None:
            if state.marks.get(name, -1) >= batch_id:
                return None
            items = read_parts(spark, state.table("llm_batch_items")) if state.table("llm_batch_items").version else empty_table(spark, "llm_batch_items")
            matched = cut_lineage(reconcile_results(lines, items))
            answers = matched.filter(F.col("answer").isNotNull()).select("seq", "cache_key", "answer.*")
            changes = (
                ("llm_fit_cache", "cache_key", answers, lambda df: upsert_fit_cache(df, answers, now)),
                ("llm_batch_items", "custom_id", matched, lambda df: settle_items(df, matched, now)),
                ("llm_batches", "batch_id", matched, lambda df: complete_batches(df, matched, now)),
                ("job_queue", "id", matched.select(F.col("job_id").alias("id")), lambda df: apply_llm_results(df, matched, threshold, now)[0]),
            )
            done = [
                staged_change(spark, root, state.table(t), t, key, ids, change, TABLES[t], same_keys=t == "job_queue") for t, key, ids, change in changes
            ]
            rows = {
                "llm_usage": evolve_schema(batch_outcome(matched).withColumn("created_at", instant(now)), TABLES["llm_usage"]),
                "job_events": result_events(matched, threshold, now),
            }
            appended = {t: [staged_rows(df, root, t, name, batch_id)] for t, df in rows.items()}
            return CommitLog(spark, root).commit(state, done, appended, name, batch_id)

        retried(work, spark, root)

    return results.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
