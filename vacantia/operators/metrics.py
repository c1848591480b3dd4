"""Run counters, warnings, budgets and progress."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import fixed_values as fv
from vacantia.functions.dates import as_utc, instant
from vacantia.operators.filters import freshness_class
from vacantia.operators.skew import HOT_ROWS, in_ranges, running_max


def freshness_stats(postings: DataFrame, hours: int, allow_unknown: bool, as_of: datetime) -> DataFrame:
    kind = freshness_class(hours, allow_unknown, as_of)
    return postings.select("source", kind.alias("_k")).groupBy("source").agg(
        F.count("*").alias("raw_fetched"), F.count_if(F.col("_k") == "kept").alias("kept_fresh"),
        F.count_if(F.col("_k") == "old").alias("dropped_old"), F.count_if(F.col("_k") == "unknown").alias("dropped_unknown_date"),
    )


def url_quality_stats(postings: DataFrame, resolution: Column, url: str = "url") -> DataFrame:
    kind = F.coalesce(F.nullif(resolution, F.lit("")), F.when(F.nullif(F.col(url), F.lit("")).isNotNull(), "direct").otherwise("unavailable"))
    return postings.select(kind.alias("_k")).agg(
        F.count_if(F.col("_k") == "direct").alias("direct"), F.count_if(F.col("_k") == "decoded_redirect").alias("decoded"),
        F.count_if(~F.col("_k").isin("direct", "decoded_redirect")).alias("missing"),
    )


def search_stats(results: DataFrame) -> DataFrame:
    """From one row per query (n_results, failed)."""
    ok = ~F.col("failed")
    return results.agg(
        F.count("*").alias("attempted"), F.count_if(ok & (F.col("n_results") > 0)).alias("succeeded"),
        F.count_if(F.col("failed")).alias("failed"), F.count_if(ok & (F.col("n_results") == 0)).alias("empty"),
    )


def _outcome_counts() -> list[Column]:
    r = F.col("result")
    counts = [F.count_if(r == kind).alias(kind) for kind in ("inserted", "deduped", "failed", "skipped")]
    return [F.count_if(r == "fetched").alias("fetched"), *counts, F.count_if(F.col("resurfaced")).alias("resurfaced")]


def _counted_rows(fetched: DataFrame, outcome: DataFrame) -> DataFrame:
    marks = fetched.select("source", F.lit("fetched").alias("result"), F.lit(False).alias("resurfaced"))
    return marks.unionByName(outcome.select("source", "result", F.coalesce("resurfaced", F.lit(False)).alias("resurfaced")))


def run_totals(fetched: DataFrame, outcome: DataFrame) -> DataFrame:
    """``fetched`` counts rows after freshness; the rest counts outcome rows (source, result, resurfaced)."""
    return _counted_rows(fetched, outcome).agg(*_outcome_counts())


def run_totals_by_source(fetched: DataFrame, outcome: DataFrame) -> DataFrame:
    """One row per source and one with a null source for the run, in one pass; skipped rows count for the run only."""
    totals = _counted_rows(fetched, outcome).rollup("source").agg(F.grouping("source").alias("_all"), *_outcome_counts())
    skipped = F.when(F.col("_all") == 1, F.col("skipped")).otherwise(0)
    return totals.withColumn("skipped", skipped).drop("_all")


def quality_stats(outcome: DataFrame) -> DataFrame:
    admitted, new = F.col("admitted"), F.col("result") == "inserted"
    codes = F.col("reason_codes")
    hard = F.contains(F.concat(F.lit("\n"), F.array_join(codes, "\n")), F.lit("\nhard_exclusion:"))
    return outcome.agg(
        F.count_if(admitted).alias("admitted_to_inbox"), F.count_if(admitted & new).alias("new_admitted_to_inbox"),
        F.count_if(~admitted).alias("filtered_out"), F.count_if("llm_used").alias("llm_used"),
        F.count_if(hard).alias("hard_exclusions"), F.count_if(F.array_contains(codes, "location:mismatch")).alias("location_mismatches"),
        F.count_if(F.array_contains(codes, "must_skill:none")).alias("no_must_skill"),
        F.count_if("llm_eligible").alias("borderline_sent"),
    )


def llm_stats(outcome: DataFrame) -> DataFrame:
    eligible, used, queued = F.col("llm_eligible"), F.col("llm_used"), F.col("llm_queued")
    return outcome.agg(
        F.count_if(eligible).alias("eligible"), F.count_if(eligible & F.col("llm_attempted")).alias("attempted"),
        F.count_if(eligible & used).alias("completed"), F.count_if(eligible & ~used & ~queued).alias("skipped"),
        F.count_if(eligible & ~used & queued).alias("batch_queued"),
    )


def run_status(n_errors: Column | str, *progress: str) -> Column:
    """``success`` without errors, else ``partial`` when anything was done, else ``failed``."""
    done: Column = F.lit(False)
    for name in progress:
        done = done | (F.col(name) > 0)
    errors = F.col(n_errors) if isinstance(n_errors, str) else n_errors
    return F.when(errors == 0, "success").when(done, "partial").otherwise("failed")


def run_warnings(source_meta: DataFrame) -> DataFrame:
    """(seq, source, position, warning) from one row per source (seq, source, error, n_jobs, warning,
    budget_reason, search_attempted, search_succeeded, raw_fetched, targets)."""
    c = F.col
    zero = F.lit(0)
    raw = F.coalesce("raw_fetched", zero)
    named = [
        F.nullif("warning", F.lit("")),
        F.nullif("budget_reason", F.lit("")),
        F.when(
            (c("source") == "serpapi") & (F.coalesce("search_attempted", zero) > 0) & (F.coalesce("search_succeeded", zero) == 0),
            "all_queries_returned_empty",
        ),
        F.when((raw > 0) & (c("n_jobs") == 0), "all_filtered_by_freshness"),
        F.when(c("error").isNull() & (c("n_jobs") == 0) & (c("targets") > 0) & (raw == 0), "no_jobs_returned_from_targets"),
    ]
    texts = F.filter(
        F.array(*[F.struct(F.lit(i).alias("position"), F.concat_ws(": ", "source", w).alias("warning"), w.isNotNull().alias("on")) for i, w in enumerate(named)]),
        lambda w: w["on"],
    )
    rows = source_meta.select("seq", "source", F.explode(texts).alias("w"))
    return rows.select("seq", "source", "w.position", "w.warning")


def error_text(errors: DataFrame, key: str, target_rows: int = HOT_ROWS) -> DataFrame:
    """(key, n_errors, error_text): messages (key, seq, source, message) in order, joined by a bar.

    The text of a key is whole by definition. Ranges of ``seq`` are sorted and joined first, so no task sorts
    all messages of one key; the last step only joins the finished pieces.
    """
    listed = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(": ", "source", "message").alias("m"))))
    pieces = in_ranges(errors, "seq", target_rows).groupBy(key, "_chunk").agg(F.count("*").alias("_n"), listed.alias("_l")).select(
        key, "_chunk", "_n", F.concat_ws(" | ", F.transform("_l", lambda x: x["m"])).alias("_text")
    )
    whole = pieces.groupBy(key).agg(F.sum("_n").alias("n_errors"), F.array_sort(F.collect_list(F.struct("_chunk", "_text"))).alias("_l"))
    return whole.select(key, "n_errors", F.concat_ws(" | ", F.transform("_l", lambda x: x["_text"])).alias("error_text"))


def month_bounds(as_of: datetime) -> tuple[datetime, datetime]:
    now = as_utc(as_of)
    start = datetime(now.year, now.month, 1, tzinfo=timezone.utc)
    following = datetime(now.year + now.month // 12, now.month % 12 + 1, 1, tzinfo=timezone.utc)
    return start, following


def day_bounds(as_of: datetime) -> tuple[datetime, datetime]:
    now = as_utc(as_of)
    start = datetime(now.year, now.month, now.day, tzinfo=timezone.utc)
    return start, start + timedelta(days=1)


def usage_in_window(
    usage: DataFrame, amount: str, start: datetime | None = None, end: datetime | None = None, run_id: int | None = None
) -> DataFrame:
    """(used): sum of an amount in a half-open time window or for one run; 0 when there is nothing."""
    rows = usage
    if start is not None and end is not None:
        rows = rows.filter((F.col("created_at") >= instant(start)) & (F.col("created_at") < instant(end)))
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    return rows.agg(F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("used"))


def remaining_run_slots(as_of: datetime, interval_minutes: int = fv.SEARCH_INTERVAL_MINUTES) -> int:
    _, following = month_bounds(as_of)
    step = max(1, interval_minutes) * 60
    left = (following - as_utc(as_of)).total_seconds()
    return max(1, int(-(-left // step)))


def search_budget(
    usage: DataFrame, as_of: datetime, cap: int = fv.MONTHLY_QUERY_CAP, reserve: int = fv.BUDGET_RESERVE,
    interval_minutes: int = fv.SEARCH_INTERVAL_MINUTES,
) -> DataFrame:
    """One row: month usage, run slots left, queries per run and budget left. Zero settings mean the default."""
    def positive(value: int, default: int) -> int:
        return value if value and value > 0 else default

    cap, reserve = positive(cap, fv.MONTHLY_QUERY_CAP), positive(reserve, fv.BUDGET_RESERVE)
    slots = remaining_run_slots(as_of, positive(interval_minutes, fv.SEARCH_INTERVAL_MINUTES))
    used = usage_in_window(usage, "queries_used", *month_bounds(as_of))
    free = F.greatest(F.lit(0), F.lit(cap) - F.greatest(F.lit(0), F.col("used")) - F.lit(reserve))
    return used.select(
        F.lit(cap).alias("monthly_cap"), F.lit(reserve).alias("reserve"), F.col("used").alias("used_this_month"),
        F.lit(slots).alias("remaining_run_slots"), F.floor(free / F.lit(slots)).cast("bigint").alias("per_run_limit"),
        F.greatest(F.lit(0), F.lit(cap) - F.col("used")).cast("bigint").alias("remaining_budget"),
    )


def processed_total() -> Column:
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in ("inserted", "deduped", "failed", "skipped")]
    return F.greatest(F.lit(0), parts[0] + parts[1] + parts[2] + parts[3])


def _never_falling(rows: DataFrame, percent: Column) -> DataFrame:
    """Add ``percent``: the highest so far while the run is running, the plain value otherwise."""
    running = F.col("status") == "running"
    raised = running_max(rows.withColumn("_p", percent), "run_id", "seq", F.when(running, F.col("_p")), "_top")
    return raised.withColumn("percent", F.when(running, F.col("_top")).otherwise(F.col("_p"))).drop("_p", "_top")


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def core_phase_and_percent() -> tuple[Column, Column]:
    """Phase and percent of one progress record (status, totals and core counters), before the never-fall rule."""
    c = F.col
    fetching = (c("total_sources") > 0) & (c("completed_sources") < c("total_sources"))
    total = F.when(c("total_jobs") > 0, c("total_jobs")).otherwise(F.greatest(F.lit(0), c("fetched")))
    asked = F.when(c("processed_jobs") > 0, c("processed_jobs")).otherwise(processed_total())
    processed = F.when(total > 0, F.least(total, asked)).otherwise(asked)
    some = (c("total_sources") > 0) | (total > 0) | (processed > 0)
    running_phase = F.when(fetching, "fetching").when((total > 0) | (c("total_sources") > 0), "processing").otherwise("running")
    running_percent = (
        F.when(fetching, _half_up(F.try_divide(c("completed_sources"), c("total_sources")) * 25))
        .when(total > 0, F.lit(25) + _half_up(F.try_divide(processed, total) * 75))
        .when(c("total_sources") > 0, 100).otherwise(0)
    )
    running, idle = c("status") == "running", c("status") == "idle"
    phase = F.when(running, running_phase).when(idle, "idle").when(some, "done").otherwise("idle")
    percent = F.when(running, running_percent).when(idle, 0).when(some, 100).otherwise(0)
    return phase, percent


def run_progress(records: DataFrame) -> DataFrame:
    """Add ``phase`` and ``percent`` to progress records (run_id, seq, status, counters); the percent of a running
    run never falls."""
    phase, percent = core_phase_and_percent()
    return _never_falling(records.withColumn("phase", phase), percent)


def llm_percent() -> tuple[Column, Column]:
    """(in flight, percent) of the review, before the never-fall rule."""
    c = F.col
    resolved = c("completed") + c("llm_skipped")
    in_flight = F.greatest(F.lit(0), c("attempted") - resolved)
    fetched = F.greatest(F.lit(0), c("fetched"))
    processed = F.when(fetched > 0, F.least(fetched, processed_total())).otherwise(processed_total())
    unsettled = F.greatest(F.lit(0), c("eligible") - resolved)
    settled = F.greatest(F.lit(0), processed - unsettled)
    share = F.when(fetched > 0, F.least(F.lit(100), _half_up(F.try_divide(settled, fetched) * 100))).otherwise(0)
    finished = ~c("status").isin("running", "idle") & (fetched > 0) & (unsettled == 0)
    return in_flight, F.when(finished, 100).otherwise(share)


def llm_progress(records: DataFrame) -> DataFrame:
    in_flight, percent = llm_percent()
    return _never_falling(records.withColumn("in_flight", in_flight), percent)


SUMMARY_SCHEMA = (
    "runId bigint, trigger string, label string, requestedSources array<string>, startedAt string, finishedAt string, "
    "durationMs bigint, totals struct<fetched:bigint,inserted:bigint,deduped:bigint,resurfaced:bigint,failed:bigint,"
    "skipped:bigint>, core struct<phase:string,totalSources:bigint,completedSources:bigint,totalJobs:bigint,"
    "processedJobs:bigint,activeSource:string,percent:int>, quality struct<admittedToInbox:bigint,"
    "newAdmittedToInbox:bigint,filteredOut:bigint,llmUsed:bigint,hardExclusionCount:bigint,locationMismatchCount:bigint,"
    "mustNoneCount:bigint,borderlineSentToLlmCount:bigint>, llm struct<eligible:bigint,attempted:bigint,completed:bigint,"
    "skipped:bigint,batchQueued:bigint>, sources map<string,struct<fetched:bigint,inserted:bigint,deduped:bigint,"
    "resurfaced:bigint,failed:bigint>>, errors array<string>, warnings array<string>"
)


def run_detail(runs: DataFrame, run_id: int | None = None) -> DataFrame:
    """Progress view of finished runs from their stored summary; an unreadable summary counts as empty."""
    rows = runs if run_id is None else runs.filter(F.col("id") == run_id)
    s = F.col("_s")
    parsed = rows.withColumn("_s", F.from_json("summary_json", SUMMARY_SCHEMA))
    zero = F.lit(0).cast("bigint")

    def value(path: str) -> Column:
        return F.coalesce(F.col(f"_s.{path}"), zero)

    flat = parsed.select(
        F.col("id").alias("run_id"), F.lit(0).alias("seq"), "status", F.col("trigger_type").alias("trigger"),
        F.coalesce(F.nullif(s["label"], F.lit("")), F.lit("unknown")).alias("label"),
        *[value(f"totals.{t}").alias(t) for t in ("fetched", "inserted", "deduped", "resurfaced", "failed", "skipped")],
        value("core.totalSources").alias("total_sources"), value("core.completedSources").alias("completed_sources"),
        value("core.totalJobs").alias("total_jobs"), value("core.processedJobs").alias("processed_jobs"),
        value("llm.eligible").alias("eligible"), value("llm.attempted").alias("attempted"),
        F.when(s["llm"].isNotNull(), value("llm.completed")).otherwise(value("quality.llmUsed")).alias("completed"),
        value("llm.skipped").alias("llm_skipped"), "started_at", "finished_at",
    )
    phase, percent = core_phase_and_percent()
    in_flight, review_percent = llm_percent()
    return flat.withColumns(
        {"phase": phase, "core_percent": percent, "llm_in_flight": in_flight, "llm_percent": review_percent}
    ).drop("seq")
