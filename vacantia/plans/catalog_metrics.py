"""Queries of run counters, warnings, budgets and progress."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from vacantia.functions.links import resolve_best_link
from vacantia.operators import metrics as mt
from vacantia.plans import bindings as b
from vacantia.plans.catalog_entities import UPSERT_ODD, new_batch, outcome_of_batch
from vacantia.plans.catalog_text import linked_pages
from vacantia.plans.sql_text import ts_text

MONTH_OF = datetime(2024, 1, 3, 7, 30, tzinfo=timezone.utc)


def url_quality_stats(spark, sf_dir):
    best = linked_pages(spark, sf_dir).select(resolve_best_link("apply_links", "related_links", "share_link").alias("b"))
    rows = best.select("b.url", "b.resolution")
    return mt.url_quality_stats(rows, F.col("resolution"))


def search_stats(spark, sf_dir):
    """A query per user and event type; it failed when any of its events is an error."""
    e = b.table(spark, sf_dir, "events")
    per_query = e.groupBy(F.col("user_id"), F.floor(F.col("event_id") / 10).alias("q")).agg(
        F.count_if(F.col("value") > 60).alias("n_results"), F.max(F.col("event_type") == "error").alias("failed")
    )
    return mt.search_stats(per_query)


def run_totals(spark, sf_dir):
    outcome = outcome_of_batch(spark, sf_dir)
    return mt.run_totals(new_batch(spark, sf_dir), outcome)


def run_totals_by_source(spark, sf_dir):
    """Outcome kinds from the upsert; every event adds a fetched row under its type and errors count as failed."""
    e = b.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 60, "deduped").when(F.col("value") > 55, "skipped").otherwise("inserted")
    outcome = e.select(F.col("event_type").alias("source"), kind.alias("result"), ((kind == "deduped") & (F.col("event_id") % 3 == 0)).alias("resurfaced"))
    totals = mt.run_totals_by_source(e.select(F.col("event_type").alias("source")), outcome)
    return totals.withColumn("source", F.coalesce("source", F.lit("(all)")))


EVENT_OUTCOME = """ev as (select event_type as source, event_id, case when event_type = 'error' then 'failed' when value > 60 then 'deduped' when value > 55 then 'skipped' else 'inserted' end as result from events)"""
_COUNTS = """count(*) as fetched, count(*) filter (result = 'inserted') as inserted, count(*) filter (result = 'deduped') as deduped, count(*) filter (result = 'failed') as failed,
   count(*) filter (result = 'deduped' and event_id % 3 = 0) as resurfaced"""


def quality_stats(spark, sf_dir):
    return mt.quality_stats(outcome_of_batch(spark, sf_dir))


def llm_stats(spark, sf_dir):
    return mt.llm_stats(outcome_of_batch(spark, sf_dir))


def run_status(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("run_id"), F.floor(F.col("event_id") / 500).alias("part")).agg(
        F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("value") > 60).alias("inserted"), F.count_if(F.col("value") > 70).alias("deduped")
    )
    return runs.select("run_id", "part", "n_errors", mt.run_status("n_errors", "inserted", "deduped").alias("status"))


def _source_meta(spark, sf_dir) -> DataFrame:
    """One source report per customer."""
    c = b.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("seq"), F.when(k % 4 == 0, "serpapi").otherwise(F.lower("c_mktsegment")).alias("source"), F.when(k % 6 == 0, "timeout").alias("error"),
        F.when(k % 3 == 0, 5).otherwise(0).alias("n_jobs"), F.when(k % 10 == 0, "no_targets_configured").alias("warning"),
        F.when(k % 8 == 0, "no_queries").alias("budget_reason"), (k % 5).alias("search_attempted"), (k % 2).alias("search_succeeded"),
        F.when(k % 7 == 0, 0).otherwise(k % 9).alias("raw_fetched"), F.when(k % 11 != 0, k % 4).alias("targets"),
    )


def run_warnings(spark, sf_dir):
    return mt.run_warnings(_source_meta(spark, sf_dir))


WARNINGS_SQL = """with m as (select c_custkey as seq, case when c_custkey % 4 = 0 then 'serpapi' else lower(c_mktsegment) end as source, c_custkey as k from customer)
  select seq, source, 0 as position, source || ': no_targets_configured' as warning from m where k % 10 = 0
  union all select seq, source, 1, source || ': no_queries' from m where k % 8 = 0
  union all select seq, source, 2, source || ': all_queries_returned_empty' from m where source = 'serpapi' and k % 5 > 0 and k % 2 = 0
  union all select seq, source, 3, source || ': all_filtered_by_freshness' from m where k % 7 <> 0 and k % 9 > 0 and k % 3 <> 0
  union all select seq, source, 4, source || ': no_jobs_returned_from_targets' from m where k % 6 <> 0 and k % 3 <> 0 and k % 11 <> 0 and k % 4 > 0 and (k % 7 = 0 or k % 9 = 0)"""


def _usage(spark, sf_dir) -> DataFrame:
    e = b.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("value").cast("bigint").alias("calls"), F.col("value").cast("bigint").alias("queries_used"), F.col("ts").alias("created_at"))


def usage_in_window(spark, sf_dir):
    usage = _usage(spark, sf_dir)
    parts = {
        "month": mt.usage_in_window(usage, "queries_used", *mt.month_bounds(MONTH_OF)), "day": mt.usage_in_window(usage, "calls", *mt.day_bounds(MONTH_OF)),
        "run": mt.usage_in_window(usage, "calls", run_id=7), "empty": mt.usage_in_window(usage, "calls", run_id=-1),
    }
    rows = [df.select(F.lit(name).alias("part"), "used") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def search_budget(spark, sf_dir):
    return mt.search_budget(_usage(spark, sf_dir), MONTH_OF, 5_000_000, 0, 720)


def error_text(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").filter("event_type = 'error'")
    run = F.floor(F.col("event_id") / 100)
    rows = e.select(run.alias("run_id"), F.col("event_id").alias("seq"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("source"), F.col("props").alias("message"))
    return mt.error_text(rows, "run_id")


def _records(spark, sf_dir) -> DataFrame:
    """Progress records: a run per user, its counters from the events."""
    e = b.table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("run_id"), k.alias("seq"),
        F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "signup", "idle").otherwise("running").alias("status"),
        F.lit(8).alias("total_sources"), (k % 10).cast("int").alias("completed_sources"), F.when(k % 3 == 0, 0).otherwise(100).alias("total_jobs"),
        F.when(k % 4 == 0, 0).otherwise((k % 120).cast("int")).alias("processed_jobs"), (k % 90).alias("fetched"), (k % 11).alias("inserted"), (k % 7).alias("deduped"),
        (k % 2).alias("failed"), (k % 3).alias("skipped"), (k % 20).alias("eligible"), (k % 19).alias("attempted"), (k % 9).alias("completed"), (k % 5).alias("llm_skipped"),
    )


RECORDS = """rec as (select user_id as run_id, event_id as seq, event_id as k,
    case event_type when 'purchase' then 'success' when 'signup' then 'idle' else 'running' end as status, 8 as total_sources, event_id % 10 as completed_sources,
    case when event_id % 3 = 0 then 0 else 100 end as total_jobs, case when event_id % 4 = 0 then 0 else event_id % 120 end as processed_jobs, event_id % 90 as fetched,
    event_id % 11 + event_id % 7 + event_id % 2 + event_id % 3 as done, event_id % 20 as eligible, event_id % 19 as attempted, event_id % 9 + event_id % 5 as resolved from events),
  rec2 as (select *, case when total_jobs > 0 then total_jobs else fetched end as tj, case when processed_jobs > 0 then processed_jobs else done end as pj,
    case when fetched > 0 then least(fetched, done) else done end as pd, greatest(0, eligible - resolved) as uns from rec),
  rec3 as (select *, case when tj > 0 then least(tj, pj) else pj end as pr, greatest(0, pd - uns) as settled from rec2),
  core as (select *, case when status = 'idle' then 'idle' when status <> 'running' then 'done' when completed_sources < 8 then 'fetching' else 'processing' end as phase,
    case when status = 'idle' then 0 when status <> 'running' then 100 when completed_sources < 8 then cast(floor(completed_sources / 8 * 25 + 0.5) as int)
      when tj > 0 then 25 + cast(floor(pr / tj * 75 + 0.5) as int) else 100 end as p,
    case when fetched > 0 then least(100, cast(floor(settled / fetched * 100 + 0.5) as int)) else 0 end as share from rec3),
  prog as (select *, case when status = 'running' then max(case when status = 'running' then p end) over w else p end as percent,
    case when status = 'running' then max(case when status = 'running' then share end) over w when status = 'success' and fetched > 0 and uns = 0 then 100 else share end as review_percent
   from core window w as (partition by run_id order by seq rows unbounded preceding))"""


def run_progress(spark, sf_dir):
    return mt.run_progress(_records(spark, sf_dir)).select("run_id", "seq", "phase", "percent")


def llm_progress(spark, sf_dir):
    return mt.llm_progress(_records(spark, sf_dir)).select("run_id", "seq", "in_flight", "percent")


def run_detail(spark, sf_dir):
    """Stored summaries, one run per order; every seventh is unreadable."""
    o = b.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    summary = F.to_json(
        F.struct(
            F.lit("core").alias("label"), F.struct((k % 50).alias("fetched"), (k % 20).alias("inserted"), (k % 5).alias("deduped")).alias("totals"),
            F.struct(F.lit(4).alias("totalSources"), F.lit(4).alias("completedSources")).alias("core"), F.struct((k % 6).alias("llmUsed")).alias("quality"),
        )
    )
    runs = o.select(
        k.alias("id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"), F.lit("manual").alias("trigger_type"),
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("success").alias("status"), F.when(k % 7 == 0, "{broken").otherwise(summary).alias("summary_json"),
        F.lit(None).cast("string").alias("error_text"),
    )
    out = mt.run_detail(runs)
    return out.select("run_id", "status", "label", "fetched", "inserted", "completed", "phase", "core_percent", "llm_percent", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


DETAIL_SQL = f"""with r as (select o_orderkey as run_id, o_orderdate, case when o_orderstatus = 'P' then 'running' else 'success' end as status, o_orderkey % 7 = 0 as broken,
    case when o_orderkey % 7 = 0 then 0 else o_orderkey % 50 end as fetched, case when o_orderkey % 7 = 0 then 0 else o_orderkey % 20 end as inserted,
    case when o_orderkey % 7 = 0 then 0 else o_orderkey % 5 end as deduped, case when o_orderkey % 7 = 0 then 0 else o_orderkey % 6 end as completed from orders),
  s as (select *, inserted + deduped as done, case when fetched > 0 then least(fetched, inserted + deduped) else inserted + deduped end as pd from r)
  select run_id, status, case when broken then 'unknown' else 'core' end as label, fetched, inserted, completed,
   case when status = 'running' then case when broken then 'running' else 'processing' end when broken then 'idle' else 'done' end as phase,
   case when status = 'running' then case when broken then 0 when fetched > 0 then 25 + cast(floor(pd / fetched * 75 + 0.5) as int) else 100 end when broken then 0 else 100 end as core_percent,
   case when status = 'success' and fetched > 0 then 100 when fetched > 0 then least(100, cast(floor(pd / fetched * 100 + 0.5) as int)) else 0 end as llm_percent,
   {ts_text('o_orderdate')} as started_at from s"""

CASES = {
    "url_quality_stats": (url_quality_stats, """select count(*) filter (page_id % 5 = 0) as direct, count(*) filter (page_id % 5 in (1, 2, 3)) as decoded,
        count(*) filter (page_id % 5 = 4) as missing from pages"""),
    "search_stats": (search_stats, """with q as (select user_id, event_id // 10, count(*) filter (value > 60) as n, bool_or(event_type = 'error') as failed from events group by all)
        select count(*) as attempted, count(*) filter (not failed and n > 0) as succeeded, count(*) filter (failed) as failed, count(*) filter (not failed and n = 0) as empty from q"""),
    "run_totals": (run_totals, f"""{UPSERT_ODD} select count(*) as fetched, count(*) filter (result = 'inserted') as inserted, count(*) filter (result = 'deduped') as deduped,
        0 as failed, 0 as skipped, count(*) filter (resurfaced) as resurfaced from outcomes"""),
    "run_totals_by_source": (run_totals_by_source, f"""with {EVENT_OUTCOME} select source, {_COUNTS}, 0 as skipped from ev group by source
        union all select '(all)', {_COUNTS}, count(*) filter (result = 'skipped') from ev"""),
    "quality_stats": (quality_stats, f"""{UPSERT_ODD} select count(*) filter (admitted) as admitted_to_inbox, count(*) filter (admitted and result = 'inserted') as new_admitted_to_inbox,
        count(*) filter (not admitted) as filtered_out, 0 as llm_used, count(*) filter (array_to_string(reason_codes, '|') like '%hard_exclusion:%') as hard_exclusions,
        count(*) filter (list_contains(reason_codes, 'location:mismatch')) as location_mismatches, count(*) filter (list_contains(reason_codes, 'must_skill:none')) as no_must_skill,
        count(*) filter (needs_review) as borderline_sent from outcomes"""),
    "llm_stats": (llm_stats, f"""{UPSERT_ODD} select count(*) filter (needs_review) as eligible, count(*) filter (needs_review) as attempted, 0 as completed,
        count(*) filter (needs_review) as skipped, 0 as batch_queued from outcomes"""),
    "run_status": (run_status, """with r as (select user_id as run_id, event_id // 500 as part, count(*) filter (event_type = 'error') as n_errors, count(*) filter (value > 60) as inserted from events group by all)
        select run_id, part, n_errors, case when n_errors = 0 then 'success' when inserted > 0 then 'partial' else 'failed' end as status from r"""),
    "run_warnings": (run_warnings, WARNINGS_SQL),
    "usage_in_window": (usage_in_window, """with u as (select user_id, cast(trunc(value) as bigint) as v, ts from events)
        select 'month' as part, cast(coalesce(sum(v), 0) as bigint) as used from u where ts >= '2024-01-01' and ts < '2024-02-01'
        union all select 'day', cast(coalesce(sum(v), 0) as bigint) from u where ts >= '2024-01-03' and ts < '2024-01-04'
        union all select 'run', cast(coalesce(sum(v), 0) as bigint) from u where user_id = 7 union all select 'empty', 0"""),
    "search_budget": (search_budget, """with u as (select cast(coalesce(sum(cast(trunc(value) as bigint)), 0) as bigint) as used from events where ts >= '2024-01-01' and ts < '2024-02-01'),
        s as (select used, cast(ceil(date_diff('second', timestamp '2024-01-03 07:30:00', timestamp '2024-02-01') / 43200.0) as bigint) as slots from u)
        select 5000000 as monthly_cap, 10 as reserve, used as used_this_month, slots as remaining_run_slots, greatest(0, 5000000 - used - 10) // slots as per_run_limit,
        greatest(0, 5000000 - used) as remaining_budget from s"""),
    "error_text": (error_text, """select event_id // 100 as run_id, count(*) as n_errors, string_agg('s' || (user_id % 4) || ': ' || props, ' | ' order by event_id) as error_text
        from events where event_type = 'error' group by 1"""),
    "run_progress": (run_progress, f"with {RECORDS} select run_id, seq, phase, percent from prog"),
    "llm_progress": (llm_progress, f"with {RECORDS} select run_id, seq, greatest(0, attempted - resolved) as in_flight, review_percent as percent from prog"),
    "run_detail": (run_detail, DETAIL_SQL),
}
