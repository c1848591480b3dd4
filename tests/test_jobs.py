"""Snapshots, streams, run rows and the review round trip."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from vacantia.config import GateOptions, KeywordRules, Profile
from vacantia.operators import fit_review, review, runs, snapshots, state
from vacantia.operators.metrics import run_detail
from vacantia.plans.ingest import ingest_run, landed_postings
from vacantia.schemas import DEFAULTS, TABLES, empty_table, evolve_schema
from vacantia.session import cut_lineage, work_dir
from vacantia.sources import configuration
from vacantia.streaming import jobs

NOW = datetime(2026, 2, 9, tzinfo=timezone.utc)
ROWS = "seq bigint, company string, title string, location string, post_date string, source string, url string, jd_text string"
PROFILE = Profile(("engineer",), (), (), ("toronto",), hard_exclusions=("senior",))
OPTIONS = GateOptions(20, 5, 10)


def rows(n, start=0):
    return [(start + i, f"Co{i % 5}", f"Engineer {i % 5}", "Toronto", "2026-02-01", "s", f"https://e.com/{i % 7}", "engineer") for i in range(n)]


def test_snapshot_buckets_are_replaced_alone(spark):
    root = work_dir(spark, "t")
    first = spark.range(40).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("v"))
    snapshots.write_snapshot(first, root, "t", 1, key="id", buckets=4)
    snapshots.write_snapshot(first.withColumn("v", F.lit(2)), root, "t", 2, key="id", buckets=4, touched=[1, 3])
    got = snapshots.read_snapshot(spark, root, "t")
    assert got.count() == 40
    per = {r["b"]: r["v"] for r in got.groupBy(snapshots.bucket_of("id", 4).alias("b")).agg(F.max("v").alias("v")).collect()}
    assert per == {0: 1, 1: 2, 2: 1, 3: 2}
    assert snapshots.latest_version(spark, root, "t") == 2 and snapshots.latest_version(spark, root, "other") == 0
    assert snapshots.read_snapshot(spark, work_dir(spark, "none"), "t") is None


def test_unfinished_version_stays_invisible(spark):
    root = work_dir(spark, "t")
    snapshots.write_snapshot(spark.range(3), root, "t", 1)
    spark.range(99).write.parquet(f"{root}/t/v=2")
    assert snapshots.read_snapshot(spark, root, "t").count() == 3


def test_stream_ingest_over_several_batches_equals_runs(spark):
    root = work_dir(spark, "s")
    batches = [rows(12), rows(12, 100)]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = jobs.file_stream(spark, f"{root}/in", spark.createDataFrame(batch, ROWS).schema, files_per_batch=1)
        jobs.stream_ingest(stream, f"{root}/tables", f"{root}/cp", KeywordRules(), PROFILE, OPTIONS, NOW).awaitTermination()
    got = snapshots.read_snapshot(spark, f"{root}/tables", "job_queue")
    queue = empty_table(spark, "job_queue")
    for run, batch in enumerate(batches, 1):
        queue = ingest_run(queue, spark.createDataFrame(batch, ROWS), KeywordRules(), PROFILE, OPTIONS, run, NOW).queue
    columns = ["canonical_fingerprint", "title", "status", "fit_score", "last_run_id"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, queue.select(*columns).collect()))
    assert snapshots.read_rows(spark, f"{root}/tables", "job_sources").count() == 24
    assert state.check_uniqueness(got).count() == 0


def test_run_summary_round_trip(spark):
    batch = spark.createDataFrame(rows(12), ROWS)
    result = ingest_run(empty_table(spark, "job_queue"), batch, KeywordRules(), PROFILE, OPTIONS, 1, NOW)
    summary = runs.run_summary(1, "manual", "core", ["s"], NOW, NOW, result.fetched, result.outcome)
    run = runs.finalize_run(runs.start_run(spark, 1, "manual", NOW), summary, NOW)
    stored = json.loads(run.first()["summary_json"])
    assert stored["totals"]["fetched"] == 12 and stored["totals"]["inserted"] + stored["totals"]["deduped"] == 12
    assert list(stored["sources"]) == ["s"] and run.first()["status"] == "success"
    view = run_detail(run).first()
    assert (view["phase"], view["core_percent"], view["label"]) == ("done", 100, "core")


def test_review_batch_round_trip(spark):
    options = GateOptions(90, 5, 89, review_mode="batch")
    batch = spark.createDataFrame(rows(4), ROWS)
    queue = cut_lineage(ingest_run(empty_table(spark, "job_queue"), batch, KeywordRules(), PROFILE, options, 1, NOW).queue)
    pending = queue.withColumn("job_id", F.col("id"))
    path = work_dir(spark, "req")
    marked, items, batches, lines = fit_review.submit_batch(queue, pending, empty_table(spark, "llm_batch_items"), PROFILE, options, 1, NOW, path, "b1")
    sent = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert len(sent) == queue.count() and json.loads(sent[0]["body"]["messages"][1]["content"])["profile"]["target_roles"] == ["engineer"]
    assert {r["llm_review_state"] for r in marked.collect()} == {"pending"}
    answers = [
        (i, json.dumps({"custom_id": s["custom_id"], "response": {"body": {"choices": [{"message": {"content": '{"fit_label":"high","fit_score":80}' if i else "{bad"}}]}}}))
        for i, s in enumerate(sent)
    ]
    matched = fit_review.reconcile_results(spark.createDataFrame(answers, "seq bigint, value string"), items)
    done, events = fit_review.apply_llm_results(marked, matched, 65, NOW)
    assert sorted(r["llm_review_state"] for r in done.collect()) == ["completed"] * (len(sent) - 1) + ["pending"]
    assert events.count() == len(sent) - 1 and batches.first()["status"] == "validating"
    _, failed_items, none, _ = fit_review.submit_batch(queue, pending, empty_table(spark, "llm_batch_items"), PROFILE, options, 1, NOW, work_dir(spark, "req"), "b2", error="file_upload_500")
    assert {r["state"] for r in failed_items.collect()} == {"failed"} and none.count() == 0


def test_schemas_and_evolution(spark):
    assert len(TABLES) == 9 and len(TABLES["job_queue"]) == 38
    old = spark.createDataFrame([("a", "b")], "company string, title string")
    r = evolve_schema(old, TABLES["job_queue"], DEFAULTS).first()
    assert (r["status"], r["tier"], r["score"], r["is_bigtech"], r["fit_score"]) == ("inbox", "B", 0, False, None)


def test_page_bounds():
    assert review.page_bounds(0, 0) == (0, 50) and review.page_bounds(3, 500) == (400, 200) and review.page_bounds(None, -4) == (0, 1)


def test_configuration_files(spark):
    root = work_dir(spark, "cfg")
    rules = '{"tiers":{"A":{"keywords":{"z":3,"a":2}},"B":{"keywords":{}}},"negative":{"n":1},"freshness":{"hours24":5,"days7":2},"titleBoost":0}'
    spark.createDataFrame([(rules,)], "value string").coalesce(1).write.text(f"{root}/rules")
    spark.createDataFrame([('{"target_roles":[" Engineer ",""],"must_have_skills":["SQL"],"hard_exclusions":"x"}',)], "value string").coalesce(1).write.text(f"{root}/profile")
    loaded = configuration.load_keyword_rules(spark, f"{root}/rules")
    assert loaded.tier_a == (("z", 3), ("a", 2)) and loaded.boost == 2 and loaded.fresh_day == 5
    profile = configuration.load_profile(spark, f"{root}/profile")
    assert profile.target_roles == ("engineer",) and profile.must_have_skills == ("sql",) and profile.hard_exclusions[0] == "senior"


def test_paged_source_stops_after_the_first_short_page(spark):
    def page(n, first):
        return json.dumps({"content": [{"id": str(first + i), "name": f"Job {first + i}"} for i in range(n)]})

    landed = [("a", 0, 200, page(100, 0)), ("a", 1, 200, page(3, 100)), ("a", 2, 200, page(100, 200)), ("b", 0, 500, page(100, 0)), ("b", 1, 200, page(100, 0)), ("c", 1, 200, page(9, 0))]
    df = spark.createDataFrame(landed, "slug string, page bigint, http_status int, body string").withColumns(
        {"target": F.col("slug"), "source": F.lit("smartrecruiters"), "content_type": F.lit("application/json"), "priority": F.lit(0)}
    )
    out = landed_postings(df, "smartrecruiters", NOW).collect()
    assert sorted(int(r["meta"]["smartrecruiters_id"]) for r in out) == list(range(103)) and {r["company"] for r in out} == {"a"}
