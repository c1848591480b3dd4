"""One ingest run over the tables of a folder: everything it changes becomes visible by one commit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacantia.config import GateOptions, KeywordRules, Profile
from vacantia.operators.commits import Change, CommitLog, State
from vacantia.operators.filters import freshness_class
from vacantia.operators.fit_review import Classifier, review_answers, submit_batch, unknown_answers, upsert_fit_cache
from vacantia.operators.key_index import INDEX, KEY_COLUMNS, QUEUE, current_index, index_change, reachable, row_keys
from vacantia.operators.metrics import freshness_stats
from vacantia.operators.reservations import Reservation, reserve_calls, settled
from vacantia.operators.runs import finalize_run, run_summary, start_run
from vacantia.operators.skew import checked_semi_join
from vacantia.operators.snapshots import BUCKETS, read_parts, read_rows, retried, staged, staged_change, staged_rows, table_state, touched_buckets
from vacantia.operators.state import append_events, append_lineage, gate_postings, next_queue, outcome_detail, place_batch, settle_postings
from vacantia.plans.ingest import FRESHNESS_EXEMPT, fetch_sources
from vacantia.schemas import TABLES, empty_table, evolve_schema
from vacantia.session import cut_lineage, work_dir

CACHE, ITEMS, BATCHES = "llm_fit_cache", "llm_batch_items", "llm_batches"


@dataclass(frozen=True)
class RunSettings:
    """What a run needs besides its postings. ``fresh_hours`` of None keeps postings of any age, as do the sources in ``fresh_exempt``."""

    rules: KeywordRules
    profile: Profile
    options: GateOptions
    trigger: str = "schedule"
    label: str = "core"
    requested: tuple[str, ...] = ()
    fresh_hours: int | None = None
    allow_unknown_date: bool = False
    fresh_exempt: tuple[str, ...] = ()
    classifier: Classifier | None = None
    buckets: int = BUCKETS


def number_rows(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``seq``, unique and ascending in the order of the columns; equal rows get numbers in any order. Written out, so the numbers stay."""
    ranged = rows.orderBy(*order) if order else rows
    return cut_lineage(ranged.withColumn("seq", F.monotonically_increasing_id()))


def run_on_tables(
    spark: SparkSession, root: str, postings: DataFrame, settings: RunSettings, as_of: datetime, writer: str, batch: int, order: Sequence[str] = (),
) -> State | None:
    """Take postings into the tables below ``root`` as micro-batch ``batch`` of ``writer``: stale ones are dropped and counted, the others scored,
    gated, reviewed within the budget, matched through the key index and written, with lineage, events, answers, usage and the run row.

    Nothing is visible before the commit, so a run that dies anywhere is simply run again; one that is visible already is skipped (None).
    Postings without ``seq`` are numbered in the given order. A run reads and rewrites only the buckets that its keys fall into. When another writer
    changed those, matching is repeated on the new state; scores and review answers stay.
    """
    if table_state(spark, root).marks.get(writer, -1) >= batch:
        return None
    numbered = cut_lineage(postings) if "seq" in postings.columns else number_rows(postings, *order)
    counts = None
    if settings.fresh_hours is not None:
        hours, unknown = settings.fresh_hours, settings.allow_unknown_date
        exempt = F.coalesce(F.col("source").isin(*settings.fresh_exempt), F.lit(False))
        counts = cut_lineage(freshness_stats(numbered.filter(~exempt), hours, unknown, as_of))
        numbered = numbered.filter(exempt | (freshness_class(hours, unknown, as_of) == "kept"))
    gated = cut_lineage(gate_postings(numbered, settings.rules, settings.profile, settings.options, as_of))
    answers, new_cache, reservation = _reviewed(spark, root, gated, settings, as_of, f"{writer}/{batch}")
    scored = settle_postings(gated, settings.options, answers)
    if answers is not None:  # without answers it is a projection of what is stored already
        scored = cut_lineage(scored)
    new_keys = cut_lineage(row_keys(scored.withColumn("id", F.col("seq").cast("string"))))
    batch_keys = new_keys.select(F.explode("keys").alias("key"))
    n_calls = new_cache.count() if new_cache is not None else 0

    def work(state: State) -> State | None:
        if state.marks.get(writer, -1) >= batch:
            return None
        log = CommitLog(spark, root)
        state = current_index(spark, root, state, settings.buckets)
        queue, index = state.table(QUEUE), state.table(INDEX)
        run_id = queue.version + 1
        found, read_keys = reachable(spark, index, batch_keys)
        fresh = not queue.version or queue.key is None
        near = touched_buckets(found, "id", queue.buckets) if not fresh else None
        candidates = read_parts(spark, queue, near) if queue.version else empty_table(spark, QUEUE)
        known = checked_semi_join(candidates.select("id", *KEY_COLUMNS, "first_seen_at", "status", "created_at"), found.select("id").distinct(), "id")
        outcome = place_batch(known, scored, run_id)
        touched = None if fresh else touched_buckets(outcome, "job_id", queue.buckets)
        part = read_parts(spark, queue, touched) if queue.version else empty_table(spark, QUEUE)
        following = next_queue(part, scored, outcome, run_id, as_of)
        winners = cut_lineage(outcome.filter("is_winner").select("seq", F.col("job_id").alias("id")))
        gained = winners.join(new_keys.select(F.col("id").cast("bigint").alias("seq"), "keys"), "seq").select("id", "keys")
        lost = found.join(winners.select("id"), "id", "left_semi")
        buckets = settings.buckets if fresh else queue.buckets
        changes = [
            staged(following, root, QUEUE, run_id, "id", buckets, touched, "status", read=near or ()),
            index_change(spark, root, index, queue.version, lost, gained, read_keys),
        ]
        detail = cut_lineage(outcome_detail(scored, outcome))
        rows = {"job_sources": append_lineage(detail, run_id, as_of), "job_events": append_events(detail, run_id, as_of)}
        summary = run_summary(run_id, settings.trigger, settings.label, settings.requested, as_of, as_of, numbered.select("source"), detail)
        rows["ingestion_runs"] = finalize_run(start_run(spark, run_id, settings.trigger, as_of), summary, as_of)
        if counts is not None:
            rows["freshness_counts"] = counts.withColumn("run_id", F.lit(run_id).cast("bigint"))
        if n_calls:
            usage = spark.createDataFrame([(run_id, n_calls, 0, 0, as_of)], TABLES["llm_usage"])
            rows["llm_usage"] = usage
            answered = new_cache.withColumn("seq", F.lit(0))
            changes.append(staged_change(spark, root, state.table(CACHE), CACHE, "cache_key", answered, lambda df: upsert_fit_cache(df, answered, as_of), TABLES[CACHE]))
        if reservation is not None:
            changes.append(settled(spark, root, state, reservation))
        appended = {name: [staged_rows(df, root, name, writer, batch)] for name, df in rows.items()}
        return log.commit(state, changes, appended, writer, batch)

    return retried(work, spark, root)


def _reviewed(
    spark: SparkSession, root: str, gated: DataFrame, settings: RunSettings, as_of: datetime, run_key: str
) -> tuple[DataFrame | None, DataFrame | None, Reservation | None]:
    """(answers, new cache rows, reservation): the borderline rows' answers from the cache and, within what the day and the run still allow, from
    the classifier. Calls are reserved before they are made, so overlapping runs together stay below the day's cap."""
    options = settings.options
    if not options.review_enabled and not options.batch_mode:
        return None, None, None
    state = table_state(spark, root)
    cache = read_parts(spark, state.table(CACHE)) if state.table(CACHE).version else empty_table(spark, CACHE)
    if options.batch_mode:
        answers, _ = review_answers(gated, cache, settings.profile, options, 0, 0)
        return cut_lineage(answers), None, None
    wanted = unknown_answers(gated, cache, settings.profile)
    reservation = reserve_calls(spark, root, run_key, as_of, wanted, options.daily_cap, options.run_cap)
    allowed = (reservation.calls, wanted + 1) if reservation.by_day else (wanted + 1, reservation.calls)
    answers, new_cache = review_answers(gated, cache, settings.profile, options, options.daily_cap - allowed[0], options.run_cap - allowed[1], settings.classifier)
    return cut_lineage(answers), cut_lineage(new_cache), reservation


def run_payloads(
    spark: SparkSession, root: str, payloads: DataFrame, names: Sequence[str], settings: RunSettings, as_of: datetime, writer: str, batch: int,
    transform: Callable[[DataFrame], DataFrame] | None = None, hand_over: Callable[[str], str] | None = None,
) -> State | None:
    """A whole run from landed payloads to the run row: the named sources' postings in task order, through ``transform``, into the tables; in batch
    review the waiting postings are handed over afterwards. A replay that finds the run visible only hands over what still waits."""
    postings = fetch_sources(payloads, names, as_of, None, settings.allow_unknown_date, transform)
    order = [c for c in ("source_rank", "target", "batch_seq", "page", "row", "block", "node") if c in postings.columns]
    exempt = tuple(dict.fromkeys((*settings.fresh_exempt, *FRESHNESS_EXEMPT)))
    told = replace(settings, requested=settings.requested or tuple(names), fresh_exempt=exempt)
    done = run_on_tables(spark, root, postings, told, as_of, writer, batch, order)
    if settings.options.batch_mode:
        run = read_rows(spark, root, "ingestion_runs").filter((F.col("writer") == writer) & (F.col("version") == batch)).first()
        done = flush_review_batch(spark, root, run["id"], told, as_of, hand_over) or done
    return done


def flush_review_batch(
    spark: SparkSession, root: str, run_id: int, settings: RunSettings, as_of: datetime, hand_over: Callable[[str], str] | None = None
) -> State | None:
    """Hand the run's postings that wait for batch review over: request lines are written, ``hand_over(path)`` gives the batch id (an exception
    is the failure's text), then items, batch row and the postings' marks become visible together. Postings with a queued item of
    the run are left out, so a second call does nothing (None)."""
    def work(state: State) -> State | None:
        queue, items = state.table(QUEUE), state.table(ITEMS)
        rows = read_parts(spark, queue).filter((F.col("last_run_id") == run_id) & (F.col("llm_review_state") == "pending"))
        posting = rows.select(F.col("id").alias("job_id"), "company", "title", "location", "post_date", "source", "url", "jd_text")
        held = read_parts(spark, items) if items.version else empty_table(spark, ITEMS)
        queued = held.filter((F.col("run_id") == run_id) & (F.col("state") == "queued")).select("job_id").distinct()
        waiting = cut_lineage(posting.join(queued, "job_id", "left_anti"))
        if not waiting.limit(1).count():
            return None
        path = work_dir(spark, f"requests-{run_id}")
        ids = waiting.select(F.col("job_id").alias("id"))
        touched = touched_buckets(ids, "id", queue.buckets)
        part = read_parts(spark, queue, touched)
        empty = empty_table(spark, ITEMS)
        options, profile = settings.options, settings.profile
        # the request lines exist before they are handed over; nothing else is run here
        submit_batch(part, waiting, empty, profile, options, run_id, as_of, path, "")
        batch_id, error = f"batch-{run_id}", None
        if hand_over is not None:
            try:
                batch_id = hand_over(path)
            except Exception as failure:  # noqa: BLE001 - whatever the caller's delivery raises is the batch's error text
                error = str(failure)
        marked, new_items, batch, _ = submit_batch(part, waiting, empty, profile, options, run_id, as_of, path, batch_id, error)
        new_items = evolve_schema(new_items, TABLES[ITEMS])
        changes: list[Change] = [
            staged_change(spark, root, items, ITEMS, "custom_id", new_items, lambda df: df.unionByName(new_items), TABLES[ITEMS]),
        ]
        if error is None:
            changes.append(staged(marked, root, QUEUE, queue.version + 1, "id", queue.buckets, touched, "status", same_keys=True))
            rows_ = evolve_schema(batch, TABLES[BATCHES])
            changes.append(staged_change(spark, root, state.table(BATCHES), BATCHES, "batch_id", rows_, lambda df: df.unionByName(rows_), TABLES[BATCHES]))
        return CommitLog(spark, root).commit(state, changes)

    return retried(work, spark, root)
