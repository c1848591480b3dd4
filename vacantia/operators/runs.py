"""Run rows: start, summary and finish."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacantia.functions.dates import instant
from vacantia.operators.metrics import llm_stats, quality_stats, run_status, run_totals_by_source
from vacantia.schemas import TABLES, evolve_schema


def start_run(spark: SparkSession, run_id: int, trigger: str, as_of: datetime) -> DataFrame:
    row = spark.createDataFrame([(run_id, trigger, "running")], "id bigint, trigger_type string, status string")
    return evolve_schema(row.withColumn("started_at", instant(as_of)), TABLES["ingestion_runs"])


def _counts(names: dict[str, str], prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(n) for n, c in names.items()])


TOTALS = {n: n for n in ("fetched", "inserted", "deduped", "resurfaced", "failed", "skipped")}
BY_SOURCE = {n: n for n in ("fetched", "inserted", "deduped", "resurfaced", "failed")}
QUALITY = {
    "admittedToInbox": "admitted_to_inbox", "newAdmittedToInbox": "new_admitted_to_inbox", "filteredOut": "filtered_out",
    "llmUsed": "llm_used", "hardExclusionCount": "hard_exclusions", "locationMismatchCount": "location_mismatches",
    "mustNoneCount": "no_must_skill", "borderlineSentToLlmCount": "borderline_sent",
}
REVIEW = {
    "eligible": "eligible", "attempted": "attempted", "completed": "completed", "skipped": "skipped", "batchQueued": "batch_queued",
}


def run_summary(
    run_id: int, trigger: str, label: str, requested: Sequence[str], started: datetime, finished: datetime,
    fetched: DataFrame, outcome: DataFrame, errors: Sequence[str] = (), warnings: Sequence[str] = (),
) -> DataFrame:
    """One row (summary_json, status, error_text). Each part is one aggregate of the outcome; the per-source map
    has one entry per source name."""
    by_source = run_totals_by_source(fetched, outcome)
    totals = by_source.filter(F.col("source").isNull()).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS])
    entry = F.struct(F.col("source").alias("key"), _counts(BY_SOURCE).alias("value"))
    source_map = by_source.filter(F.col("source").isNotNull()).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sources"), F.count("*").alias("n_sources")
    )
    one = F.lit(1).alias("_one")
    row = (
        totals.select(_counts(TOTALS).alias("totals"), one)
        .join(source_map.select("sources", "n_sources", one), "_one")
        .join(quality_stats(outcome).select(_counts(QUALITY).alias("quality"), one), "_one")
        .join(llm_stats(outcome).select(_counts(REVIEW).alias("llm"), one), "_one")
    )
    t = F.col("totals")
    processed = t["inserted"] + t["deduped"] + t["failed"] + t["skipped"]
    core = F.struct(
        F.lit("done").alias("phase"), F.col("n_sources").alias("totalSources"), F.col("n_sources").alias("completedSources"),
        t["fetched"].alias("totalJobs"), processed.alias("processedJobs"), F.lit(None).cast("string").alias("activeSource"),
        F.lit(100).alias("percent"),
    )

    def texts(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    summary = F.struct(
        F.lit(run_id).cast("bigint").alias("runId"), F.lit(trigger).alias("trigger"), F.lit(label).alias("label"),
        texts(requested).alias("requestedSources"), F.lit(started.isoformat()).alias("startedAt"),
        F.lit(finished.isoformat()).alias("finishedAt"), F.lit(int((finished - started).total_seconds() * 1000)).alias("durationMs"),
        t.alias("totals"), core.alias("core"), F.col("quality"), F.col("llm"), F.col("sources"),
        texts(errors).alias("errors"), texts(warnings).alias("warnings"),
    )
    flat = row.withColumns({"inserted": t["inserted"], "deduped": t["deduped"]})
    return flat.select(
        F.to_json(summary, {"ignoreNullFields": "false"}).alias("summary_json"),
        run_status(F.lit(len(errors)), "inserted", "deduped").alias("status"),
        F.nullif(F.lit(" | ".join(errors)), F.lit("")).alias("error_text"),
    )


def finalize_run(run: DataFrame, summary: DataFrame, as_of: datetime) -> DataFrame:
    """The run row with its final status, summary and error text."""
    one = F.lit(1).alias("_one")
    done = summary.select(F.col("status").alias("_status"), F.col("summary_json").alias("_summary"), F.col("error_text").alias("_errors"), one)
    joined = run.withColumn("_one", F.lit(1)).join(done, "_one")
    return joined.select(
        "id", "started_at", instant(as_of).alias("finished_at"), "trigger_type", F.col("_status").alias("status"),
        F.col("_summary").alias("summary_json"), F.col("_errors").alias("error_text"),
    )
