"""Queries of the review list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.operators import filters as flt, review as rv
from vacantia.plans import bindings as b
from vacantia.plans.sql_text import EVENT_ROWS, QUEUED, ts_text
from vacantia.session import cut_lineage

QUEUE_AS_OF = "2001-08-02"
FILTERS = rv.ReviewFilters(q="ring", min_score=-50)


def _where(predicate) -> object:
    def run(spark, sf_dir) -> DataFrame:
        return b.queue(spark, sf_dir).filter(predicate()).select("id", "status", "tier", "source", "score")

    return run


def _sql(where: str) -> str:
    return f"with {QUEUED} select id, status, tier, source, score from queue where {where}"


def with_sync_errors(spark, sf_dir):
    return rv.with_sync_errors(b.queue(spark, sf_dir), b.event_rows(spark, sf_dir)).select("id", "company", "title")


def review_rows(spark, sf_dir):
    f = rv.ReviewFilters(status="inbox", q="r%g", min_score=-100, seen_within_days=30, bigtech=True)
    return rv.review_rows(b.queue(spark, sf_dir), f, b.AS_OF, b.event_rows(spark, sf_dir)).select("id", "title", "score")


def stage_counts(spark, sf_dir):
    return rv.stage_counts(b.queue(spark, sf_dir), FILTERS, b.AS_OF)


def list_total(spark, sf_dir):
    return rv.list_total(rv.review_rows(b.queue(spark, sf_dir), FILTERS, b.AS_OF))


def sort_postings(spark, sf_dir):
    """Every row with its place under each order."""
    q = cut_lineage(b.queue(spark, sf_dir).select("id", "post_date", "score", "company"))  # the texts are scored once for all orders
    ordered = [
        rv.ranked_postings(q, mode).withColumn("mode", F.lit(mode or "default")) for mode in ("newest", "oldest", "score", "company", None)
    ]
    out = ordered[0]
    for df in ordered[1:]:
        out = out.unionByName(df)
    return out


ORDERS = {
    "newest": "post_date desc nulls last, score desc, id", "oldest": "post_date asc nulls first, score desc, id",
    "score": "score desc, post_date desc nulls last, id", "company": "company, score desc, id",
    "default": "post_date desc nulls last, score desc, id",
}
SORT_SQL = f"with {QUEUED} " + " union all ".join(
    f"select id, post_date, score, company, '{m}' as mode, row_number() over (order by {o}) as place from queue" for m, o in ORDERS.items()
)


def page_of(spark, sf_dir):
    """Page 2 of the default list; one bounded page is what a reviewer asks for."""
    rows = rv.review_rows(b.queue(spark, sf_dir), rv.ReviewFilters(), b.AS_OF)
    return rv.page_of(rows, 2, 50, "score").select("id", "company", "title", "score", "post_date")


def _runs(spark, sf_dir) -> DataFrame:
    o = b.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))


def recent_runs(spark, sf_dir):
    return rv.recent_runs(_runs(spark, sf_dir), 20).withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


def filter_active_batches(spark, sf_dir):
    return _runs(spark, sf_dir).filter(flt.filter_active_batches(("O", "P"))).select("id", "status")


def active_batches(spark, sf_dir):
    return rv.active_batches(_runs(spark, sf_dir), statuses=("O", "P")).select("id", "status")


def requeue_candidates(spark, sf_dir):
    return rv.requeue_candidates(b.queue(spark, sf_dir)).select("id", "company", "title")


def job_source_history(spark, sf_dir):
    ids = b.queue(spark, sf_dir).filter("status = 'applied'").select("id")
    rows = rv.job_source_history(b.lineage_rows(spark, sf_dir), ids)
    return rows.select("job_id", "source", "source_job_key", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"))


def latest_events_per_job(spark, sf_dir):
    return rv.latest_events_per_job(b.event_rows(spark, sf_dir), 20).select("job_id", "id", "event_type")


def provenance(spark, sf_dir):
    q = b.queue(spark, sf_dir)
    rows = rv.provenance(q.filter("status = 'inbox'").select("id"), q, b.lineage_rows(spark, sf_dir), b.event_rows(spark, sf_dir))
    key: Column = F.coalesce(
        F.get_json_object("detail", "$.source_job_key"), F.get_json_object("detail", "$.event_id"), F.get_json_object("detail", "$.title")
    )
    return rows.select("id", "part", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), key.alias("key"))


PROVENANCE_SQL = f"""with {QUEUED}, {EVENT_ROWS}, found as (select id, title, last_seen_at from queue where status = 'inbox')
  select id, 'job' as part, {ts_text('last_seen_at')} as at, title as key from found
  union all select job_id, 'source', {ts_text('ts')}, 'k' || event_id from (select *, 'j' || lpad(cast(user_id as varchar), 12, '0') as job_id from events) where job_id in (select id from found)
  union all select job_id, 'event', {ts_text('created_at')}, cast(id as varchar) from (
    select *, row_number() over (partition by job_id order by created_at desc, id desc) as n from event_rows where job_id in (select id from found)) where n <= 100"""

CASES = {
    "filter_tier": (_where(lambda: flt.filter_tier("A")), _sql("tier = 'A'")),
    "filter_status_default": (_where(lambda: flt.filter_status_default()), _sql("status <> 'filtered'")),
    "filter_status": (_where(lambda: flt.filter_status_default("approved")), _sql("status = 'approved'")),
    "filter_llm_pending": (_where(lambda: flt.filter_llm_pending(True)), _sql("llm_review_state = 'pending'")),
    "filter_llm_not_pending": (
        _where(lambda: flt.filter_status_default("inbox") & flt.filter_llm_pending(False, "inbox")),
        _sql("status = 'inbox' and coalesce(llm_review_state, 'none') <> 'pending'"),
    ),
    "filter_source": (_where(lambda: flt.filter_source("fr")), _sql("source = 'fr'")),
    "filter_bigtech": (_where(lambda: flt.filter_bigtech()), _sql("is_bigtech")),
    "filter_text": (_where(lambda: flt.filter_text("R_d")), _sql("title ilike '%R_d%' or company ilike '%R_d%'")),
    "filter_min_score": (_where(lambda: flt.filter_min_score(25)), _sql("score >= 25")),
    "filter_seen_within": (
        _where(lambda: flt.filter_seen_within(20, b.AS_OF)), _sql(f"last_seen_at >= timestamp '{QUEUE_AS_OF}' - interval 20 day")
    ),
    "filter_inbox": (_where(flt.filter_inbox), _sql("status = 'inbox'")),
    "filter_review_failed": (_where(flt.filter_review_failed), _sql("llm_review_state = 'failed'")),
    "filter_active_batches": (filter_active_batches, "select o_orderkey as id, o_orderstatus as status from orders where o_orderstatus in ('O', 'P')"),
    "with_sync_errors": (with_sync_errors, f"""with {QUEUED}, {EVENT_ROWS} select id, company, title from queue
        where id in (select distinct job_id from event_rows where event_type = 'sync_failed')"""),
    "review_rows": (review_rows, f"""with {QUEUED} select id, title, score from queue where status = 'inbox' and coalesce(llm_review_state, 'none') <> 'pending'
        and (title ilike '%r%g%' or company ilike '%r%g%') and score >= -100 and last_seen_at >= timestamp '{QUEUE_AS_OF}' - interval 30 day and is_bigtech"""),
    "stage_counts": (stage_counts, f"""with {QUEUED}, f as (select * from queue where (title ilike '%ring%' or company ilike '%ring%') and score >= -50)
        select 'inbox' as stage, count(*) as total from f where status = 'inbox' and coalesce(llm_review_state, 'none') <> 'pending'
        union all select 'pending_llm', count(*) from f where status = 'inbox' and llm_review_state = 'pending'
        union all select 'approved', count(*) from f where status = 'approved' union all select 'applied', count(*) from f where status = 'applied'
        union all select 'archive', count(*) from f where status = 'skipped' union all select 'filtered', count(*) from f where status = 'filtered'"""),
    "list_total": (list_total, f"""with {QUEUED} select count(*) as total from queue where (title ilike '%ring%' or company ilike '%ring%')
        and score >= -50 and status <> 'filtered'"""),
    "sort_postings": (sort_postings, SORT_SQL),
    "page_of": (page_of, f"""with {QUEUED} select id, company, title, score, post_date from queue where status <> 'filtered'
        order by score desc, post_date desc nulls last, id limit 50 offset 50"""),
    "recent_runs": (recent_runs, f"select o_orderkey as id, o_orderstatus as status, {ts_text('o_orderdate')} as started_at from orders order by 1 desc limit 20"),
    "active_batches": (active_batches, "select o_orderkey as id, o_orderstatus as status from orders where o_orderstatus in ('O','P')"),
    "requeue_candidates": (requeue_candidates, f"with {QUEUED} select id, company, title from queue where llm_review_state = 'failed' "),
    "job_source_history": (job_source_history, f"""with {QUEUED} select job_id, event_type as source, 'k' || event_id as source_job_key, {ts_text('ts')} as ingested_at
        from (select *, 'j' || lpad(cast(user_id as varchar), 12, '0') as job_id from events) where job_id in (select id from queue where status = 'applied')"""),
    "latest_events_per_job": (latest_events_per_job, f"""with {EVENT_ROWS} select job_id, id, event_type from (
        select *, row_number() over (partition by job_id order by created_at desc, id desc) as n from event_rows) where n <= 20"""),
    "provenance": (provenance, PROVENANCE_SQL),
}
