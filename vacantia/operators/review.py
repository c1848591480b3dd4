"""Review list: predicates combined, stage counts, order, pages, provenance."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vacantia import fixed_values as fv
from vacantia.operators import filters as flt
from vacantia.operators.skew import checked_semi_join
from vacantia.session import cut_lineage

LIST_COLUMNS = (
    "id", "company", "title", "location", "post_date", "source", "url", "score", "tier", "status", "hits", "years_req",
    "is_bigtech", "first_seen_at", "last_seen_at", "dedup_reason", "canonical_fingerprint", "fit_score", "fit_label",
    "fit_source", "fit_reason_codes", "quality_bucket", "rejected_by_quality", "llm_confidence", "llm_missing_must_have",
    "llm_review_state", "llm_pending_batch_id", "llm_pending_custom_id", "llm_review_updated_at", "llm_review_error",
)
PROVENANCE_COLUMNS = (
    "id", "company", "title", "source", "url", "first_seen_at", "last_seen_at", "dedup_reason", "canonical_fingerprint",
    "fit_score", "fit_label", "fit_source", "fit_reason_codes", "quality_bucket", "rejected_by_quality", "llm_confidence",
    "llm_missing_must_have", "llm_review_state", "llm_pending_batch_id", "llm_pending_custom_id", "llm_review_updated_at",
    "llm_review_error",
)


@dataclass(frozen=True)
class ReviewFilters:
    tier: str | None = None
    status: str | None = None
    include_filtered: bool = False
    llm_pending: bool = False
    source: str | None = None
    bigtech: bool = False
    q: str | None = None
    min_score: float | None = None
    has_errors: bool = False
    seen_within_days: float | None = None


def review_predicate(f: ReviewFilters, as_of: datetime) -> Column:
    """All row predicates as one column, so the scan can take what it can push down."""
    return (
        flt.filter_tier(f.tier) & flt.filter_status_default(f.status, f.include_filtered)
        & flt.filter_llm_pending(f.llm_pending, f.status) & flt.filter_source(f.source) & flt.filter_bigtech(f.bigtech)
        & flt.filter_text(f.q) & flt.filter_min_score(f.min_score) & flt.filter_seen_within(f.seen_within_days, as_of)
    )


def with_sync_errors(queue: DataFrame, events: DataFrame) -> DataFrame:
    """Postings that have a failed sync event."""
    failed = events.filter(F.col("event_type") == "sync_failed").select(F.col("job_id").alias("id")).distinct()
    return queue.join(failed, "id", "left_semi")


def review_rows(queue: DataFrame, f: ReviewFilters, as_of: datetime, events: DataFrame | None = None) -> DataFrame:
    rows = queue.filter(review_predicate(f, as_of))
    return with_sync_errors(rows, events) if f.has_errors and events is not None else rows


def list_projection(queue: DataFrame, kind: str = "list") -> DataFrame:
    return queue.select(*(LIST_COLUMNS if kind == "list" else PROVENANCE_COLUMNS))


def list_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def sort_columns(mode: str | None) -> list[tuple[str, bool]]:
    """(column, descending) of an order; a null is the lowest value."""
    orders = {
        "newest": [("post_date", True), ("score", True)],
        "oldest": [("post_date", False), ("score", True)],
        "score": [("score", True), ("post_date", True)],
        "company": [("company", False), ("score", True)],
    }
    return orders.get(mode or "newest", orders["newest"]) + [("id", False)]


def sort_order(mode: str | None) -> list[Column]:
    return [F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c, descending in sort_columns(mode)]


def sort_postings(rows: DataFrame, mode: str | None = None) -> DataFrame:
    return rows.orderBy(*sort_order(mode))


def ranked_postings(rows: DataFrame, mode: str | None = None) -> DataFrame:
    """Add ``place``, the position from 1 of every row in the order, from range partitions and their sizes."""
    order = sort_order(mode)
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("place", inside).join(starts, "_part").withColumn("place", F.col("place") + F.col("_start")).drop("_part", "_start")


def page_after(rows: DataFrame, last: dict | None, size: int | None = None, mode: str | None = None) -> DataFrame:
    """The page that follows the row ``last`` (its order columns and id), or the first page: a filter and a top-k, however deep the page."""
    if last is not None:
        rows = rows.filter(_comes_after(last, mode))
    return sort_postings(rows, mode).limit(page_bounds(1, size)[1])


def _comes_after(last: dict, mode: str | None) -> Column:
    """The order as a condition, one column after the other."""
    after, equal = F.lit(False), F.lit(True)
    for name, descending in sort_columns(mode):
        own, value = F.col(name), last[name]
        if value is None:
            beyond = F.lit(False) if descending else own.isNotNull()
        else:
            beyond = F.coalesce(own < value, F.lit(True)) if descending else F.coalesce(own > value, F.lit(False))
        after = after | (equal & beyond)
        equal = equal & own.eqNullSafe(F.lit(value))
    return after


def page_bounds(page: int | None, size: int | None) -> tuple[int, int]:
    """(offset, size): page from 1, size 1 to 200, default 50."""
    page = max(page or 1, 1)
    size = min(max(size or fv.REVIEW_PAGE_SIZE, 1), fv.REVIEW_PAGE_MAX)
    return (page - 1) * size, size


def page_of(rows: DataFrame, page: int | None = 1, size: int | None = None, mode: str | None = None) -> DataFrame:
    """One page of the sorted list; planned as a top-k, never as a full sort."""
    offset, size = page_bounds(page, size)
    return sort_postings(rows, mode).offset(offset).limit(size)


def stage_counts(queue: DataFrame, f: ReviewFilters, as_of: datetime, events: DataFrame | None = None) -> DataFrame:
    """(stage, total) of the six review stages under one filter set, in one pass over the table."""
    base = replace(f, status=None, include_filtered=True, llm_pending=False)
    rows = review_rows(queue, base, as_of, events)
    tests = {
        stage: (F.col("status") == status) & flt.filter_llm_pending(stage == "pending_llm", status)
        for stage, status in fv.STAGE_STATUS
    }
    counted = rows.agg(*[F.count_if(test).alias(stage) for stage, test in tests.items()])
    pairs = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("total")) for s in tests])
    return counted.select(F.inline(pairs))


def job_source_history(sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Lineage rows of the asked postings, newest first within each."""
    asked = checked_semi_join(sources, ids.select(F.col("id").alias("job_id")).distinct(), "job_id")
    return asked.orderBy("job_id", F.desc("ingested_at"), F.desc("source_job_key"))


def latest_events_per_job(events: DataFrame, n: int = fv.EVENTS_PER_POSTING) -> DataFrame:
    """Newest ``n`` events of each posting, by time, then id. Spark keeps only the best ``n`` of a posting in each task
    before the shuffle, so a posting with very many events does not reach one task whole."""
    newest = W.partitionBy("job_id").orderBy(F.desc("created_at"), F.desc("id"))
    return events.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def provenance(ids: DataFrame, queue: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """Rows (id, part, at, detail): the posting, its lineage rows and its newest events.

    The parts stay rows instead of lists, so a posting seen in very many runs never becomes one value.
    An unknown id gives no row.
    """
    job = list_projection(queue.join(ids.select("id").distinct(), "id", "left_semi"), "provenance")
    found = job.select(F.col("id").alias("job_id"))
    lineage = checked_semi_join(sources, found, "job_id")
    newest = latest_events_per_job(checked_semi_join(events, found, "job_id"))

    def part(df: DataFrame, name: str, key: str, at: str) -> DataFrame:
        fields = F.struct(*[F.col(c) for c in df.columns if c not in (key, at)])
        detail = F.to_json(fields, {"ignoreNullFields": "false"})
        return df.select(F.col(key).alias("id"), F.lit(name).alias("part"), F.col(at).alias("at"), detail.alias("detail"))

    return (
        part(job, "job", "id", "last_seen_at")
        .unionByName(part(lineage, "source", "job_id", "ingested_at"))
        .unionByName(part(event_payload_view(newest), "event", "job_id", "created_at"))
    )


def event_payload_view(events: DataFrame) -> DataFrame:
    """Events with the payload as canonical JSON, null when it does not parse."""
    payload = F.try_parse_json(F.nullif(F.col("payload_json"), F.lit("")))
    return events.select(
        "job_id", F.col("id").alias("event_id"), "event_type", "message", "run_id", "created_at",
        F.to_json(payload).alias("payload_json"),
    )


def recent_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(min(max(limit or fv.RUN_LIST_SIZE, 1), fv.RUN_LIST_MAX))


def requeue_candidates(queue: DataFrame, limit: int | None = None) -> DataFrame:
    """Every failed review, or the ``limit`` newest."""
    failed = queue.filter(flt.filter_review_failed())
    return failed if limit is None else failed.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def active_batches(batches: DataFrame, limit: int | None = None, statuses=fv.ACTIVE_BATCH_STATUSES) -> DataFrame:
    """Every unfinished batch, or the ``limit`` newest."""
    active = batches.filter(flt.filter_active_batches(statuses))
    return active if limit is None else active.orderBy(F.desc("id")).limit(limit)
