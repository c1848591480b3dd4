"""Queries of the streaming jobs; each runs its stream to the end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacantia.functions import keys
from vacantia.operators.snapshots import read_rows, read_snapshot, write_snapshot
from vacantia.plans import bindings as b
from vacantia.plans.catalog_entities import COMPONENTS, EVALUATED, RUN, UPSERTED, new_batch, old_queue, queue_columns
from vacantia.plans.catalog_fit import APPLIED, results_and_items
from vacantia.plans.table_run import RunSettings, run_on_tables
from vacantia.plans.sql_text import BASE, GATED, TB, ts_text
from vacantia.schemas import TABLES, evolve_schema
from vacantia.session import work_dir
from vacantia.streaming import jobs


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream; its zoneless times are UTC. A stream reads folders or patterns."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    df = jobs.file_stream(spark, f"{sf_dir}/{name}*.parquet", schema)
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def _posting_stream(spark, sf_dir) -> DataFrame:
    return b.postings(spark, sf_dir, _stream(spark, sf_dir, "documents"))


def _append_to_files(df: DataFrame, root: str) -> DataFrame:
    """Run an append stream to the end into Parquet files and read them."""
    query = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out")


def _complete_to_files(df: DataFrame, root: str) -> DataFrame:
    """Run an aggregation to the end; every micro-batch replaces the result files."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out")

    query = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/out")


def stream_ingest(spark, sf_dir):
    root = work_dir(spark, "ingest")
    jobs.stream_ingest(_posting_stream(spark, sf_dir), f"{root}/tables", f"{root}/cp", b.RULES, b.PROFILE, b.OPTIONS, b.AS_OF).awaitTermination()
    queue = read_snapshot(spark, f"{root}/tables", "job_queue")
    return queue.select("id", "company", "title", "location", "post_date", "url", "score", "tier", "status", "canonical_fingerprint", "fit_score", "quality_bucket", "last_run_id")


def stream_dedup(spark, sf_dir):
    rows = keys.fingerprint(keys.normalize_posting(_posting_stream(spark, sf_dir))).withColumn("seen_at", b.minutes_after("2001-01-01 00:00:00", "seq"))
    out = _append_to_files(jobs.stream_dedup(rows.select("canonical_fingerprint", "seen_at"), "seen_at"), work_dir(spark, "dedup"))
    return out.select("canonical_fingerprint")


def late_rows(spark, sf_dir):
    rows = jobs.late_rows(_posting_stream(spark, sf_dir), b.FRESH_HOURS, False, b.AS_OF).select("seq", "source", "freshness")
    return _append_to_files(rows, work_dir(spark, "late"))


def usage_windows(spark, sf_dir):
    usage = _stream(spark, sf_dir, "events").select(F.col("value").cast("bigint").alias("calls"), F.col("ts").alias("created_at"))
    out = _complete_to_files(jobs.usage_windows(usage, "calls"), work_dir(spark, "usage"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "used")


def seen_state(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("seen_at"))
    out = _complete_to_files(jobs.seen_state(rows, "key", "seen_at"), work_dir(spark, "seen"))
    return out.select("key", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen_at", "last_seen_at")], "n_seen")


def late_rows_kept(spark, sf_dir):
    root = work_dir(spark, "fresh")
    jobs.stream_fresh(_posting_stream(spark, sf_dir), f"{root}/tables", f"{root}/cp", b.FRESH_HOURS, False, b.AS_OF).awaitTermination()
    return read_rows(spark, f"{root}/tables", "fresh_postings").select("seq", "source", "post_date")


def late_rows_counts(spark, sf_dir):
    root = work_dir(spark, "fresh")
    jobs.stream_fresh(_posting_stream(spark, sf_dir), f"{root}/tables", f"{root}/cp", b.FRESH_HOURS, False, b.AS_OF).awaitTermination()
    counts = read_rows(spark, f"{root}/tables", "freshness_counts").groupBy("source")
    return counts.agg(*[F.sum(c).alias(c) for c in ("raw_fetched", "kept_fresh", "dropped_old", "dropped_unknown_date")])


def _usage_tables(spark, sf_dir) -> str:
    root = work_dir(spark, "usage")
    usage = _stream(spark, sf_dir, "events").select(F.col("value").cast("bigint").alias("calls"), F.col("ts").alias("created_at"))
    jobs.stream_usage(usage, "calls", f"{root}/tables", f"{root}/cp").awaitTermination()
    return f"{root}/tables"


def usage_days(spark, sf_dir):
    """Days the watermark has passed; the last ones are still open."""
    return read_rows(spark, _usage_tables(spark, sf_dir), "usage_days").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "used")


def usage_months(spark, sf_dir):
    months = read_snapshot(spark, _usage_tables(spark, sf_dir), "usage_months")
    return months.select(F.date_format("month", "yyyy-MM").alias("month"), "used", "days", F.date_format("last_day", "yyyy-MM-dd").alias("last_day"))


def seen_table(spark, sf_dir):
    """The table after two streams took the halves of the events, one after the other."""
    root = work_dir(spark, "seen")
    rows = _stream(spark, sf_dir, "events")
    for part in (0, 1):
        half = rows.filter(F.col("event_id") % 2 == part).select(F.col("user_id").alias("key"), F.col("ts").alias("seen_at"))
        jobs.stream_seen(half, f"{root}/tables", f"{root}/cp{part}", "key", "seen_at", f"seen{part}").awaitTermination()
    found = read_snapshot(spark, f"{root}/tables", "seen_state")
    return found.select("key", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen_at", "last_seen_at")], "n_seen")


def indexed_upsert(spark, sf_dir):
    """The odd half of the postings into the even half's tables, matched through the key index."""
    root = work_dir(spark, "indexed")
    write_snapshot(old_queue(spark, sf_dir), root, "job_queue", RUN - 1, key="id")
    run_on_tables(spark, root, new_batch(spark, sf_dir), RunSettings(b.RULES, b.PROFILE, b.OPTIONS), b.AS_OF, "run", 0)
    return queue_columns(read_snapshot(spark, root, "job_queue"))


def stream_llm_results(spark, sf_dir):
    root = work_dir(spark, "results")
    lines, items = results_and_items(spark, sf_dir)
    write_snapshot(b.queue(spark, sf_dir), f"{root}/tables", "job_queue", 1, key="id")
    write_snapshot(evolve_schema(items, TABLES["llm_batch_items"]), f"{root}/tables", "llm_batch_items", 1, key="custom_id")
    conversation = F.floor(F.col("seq") / 1000)  # all lines of a posting lie in one file, in their order
    lines.repartitionByRange(conversation).sortWithinPartitions("seq").select("value").write.text(f"{root}/landed")
    jobs.stream_llm_results(jobs.result_lines(spark, f"{root}/landed"), f"{root}/tables", f"{root}/cp", 65, b.AS_OF).awaitTermination()
    queue = read_snapshot(spark, f"{root}/tables", "job_queue")
    return queue.select("id", "status", "fit_source", "llm_review_state")


CLOSED = """with days as (select date_trunc('day', ts) as day, cast(sum(cast(trunc(value) as bigint)) as bigint) as used from events group by 1),
  closed as (select * from days where day + interval 1 day <= (select max(ts) from events) - interval 1 day)"""

CASES = {
    "stream_ingest": (stream_ingest, f"""with recursive {GATED}, {COMPONENTS}, {EVALUATED},
        w as (select component, max(seq) as seq from keyed join comp on fp = canonical_fingerprint group by component)
        select sha1(component || ':1') as id, company, title, location, post_date, url, score, tier, admission_status as status, canonical_fingerprint, fit_score, quality_bucket, 1 as last_run_id
        from evaluated join w using (seq)"""),
    "stream_dedup": (stream_dedup, f"with {BASE} select distinct canonical_fingerprint from keyed"),
    "late_rows": (late_rows, f"with {TB} select seq, source, case when post_date is null then 'unknown' when post_date >= '1999-08-03' then 'kept' else 'old' end as freshness from tb"),
    "late_rows_kept": (late_rows_kept, f"with {TB} select seq, source, post_date from tb where post_date >= '1999-08-03'"),
    "late_rows_counts": (late_rows_counts, f"""with {TB} select source, count(*) as raw_fetched, count(*) filter (post_date >= '1999-08-03') as kept_fresh,
        count(*) filter (post_date < '1999-08-03') as dropped_old, count(*) filter (post_date is null) as dropped_unknown_date from tb group by source"""),
    "usage_days": (usage_days, f"{CLOSED} select strftime(day, '%Y-%m-%d') as day, used from closed"),
    "usage_months": (usage_months, f"""{CLOSED} select strftime(day, '%Y-%m') as month, cast(sum(used) as bigint) as used, count(*) as days,
        strftime(max(day), '%Y-%m-%d') as last_day from closed group by 1"""),
    "seen_table": (seen_table, f"select user_id as key, {ts_text('min(ts)')} as first_seen_at, {ts_text('max(ts)')} as last_seen_at, count(*) as n_seen from events group by user_id"),
    "indexed_upsert": (indexed_upsert, UPSERTED),
    "usage_windows": (usage_windows, "select strftime(ts, '%Y-%m-%d') as day, cast(sum(cast(trunc(value) as bigint)) as bigint) as used from events group by 1"),
    "seen_state": (seen_state, f"select user_id as key, {ts_text('min(ts)')} as first_seen_at, {ts_text('max(ts)')} as last_seen_at, count(*) as n_seen from events group by user_id"),
    "stream_llm_results": (stream_llm_results, f"""with {APPLIED} select id, case when not hit or status in ('approved','applied','skipped') then status when ok then 'inbox' else 'filtered' end as status,
        case when hit then 'llm' else fit_source end as fit_source, case when hit then 'completed' else llm_review_state end as llm_review_state from j"""),
}
