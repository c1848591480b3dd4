"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each is warm, median of three."""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantia.operators import entities, metrics, review, state
from vacantia.operators.snapshots import read_snapshot, write_snapshot
from vacantia.plans import bindings as b
from vacantia.plans.catalog import cases
from vacantia.plans.catalog_entities import keyed_postings, new_batch, old_queue
from vacantia.session import work_dir

ROUNDS = 3


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def headline(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """Review queries read a stored queue, as they would; the others start from the given tables."""
    root = work_dir(spark, "bench")
    write_snapshot(b.queue(spark, sf_dir), root, "job_queue", 1, key="id", sort_by="status")
    write_snapshot(old_queue(spark, sf_dir), root, "old_queue", 1, key="id", sort_by="status")
    registered = cases()

    def queue() -> DataFrame:
        return read_snapshot(spark, root, "job_queue")

    def upsert() -> DataFrame:
        scored = state.evaluate_postings(new_batch(spark, sf_dir), b.RULES, b.PROFILE, b.OPTIONS, b.AS_OF)
        return state.upsert_postings(read_snapshot(spark, root, "old_queue"), scored, 2, b.AS_OF)[0]

    def components() -> DataFrame:
        from pyspark.sql import functions as F

        return entities.resolve_entities(keyed_postings(spark, sf_dir).withColumn("node_id", F.col("seq").cast("string")), ["seq"])

    filters = review.ReviewFilters(q="ring")
    return {
        "scoring_and_gate": lambda: b.scored(spark, sf_dir),
        "entity_resolution": components,
        "snapshot_upsert": upsert,
        "stage_counts": lambda: review.stage_counts(queue(), filters, b.AS_OF),
        "review_page": lambda: review.page_of(review.review_rows(queue(), filters, b.AS_OF), 2, 50),
        "freshness_stats": lambda: metrics.freshness_stats(b.postings(spark, sf_dir), b.FRESH_HOURS, False, b.AS_OF),
        "latest_events": lambda: review.latest_events_per_job(b.event_rows(spark, sf_dir)),
        "run_progress": lambda: registered["run_progress"][0](spark, sf_dir),
        "adapter_lever": lambda: registered["normalize_lever"][0](spark, sf_dir),
        "embedded_postings": lambda: registered["normalize_page"][0](spark, sf_dir),
        "reconcile_results": lambda: registered["reconcile_results"][0](spark, sf_dir),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name, build in headline(spark, sf_dir).items():
        run(build())
        times = []
        for _ in range(ROUNDS):
            start = time.perf_counter()
            run(build())
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
