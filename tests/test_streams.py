"""Streams onto tables that other writers change, replays, and results that reach the queue."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tests.test_jobs import NOW, OPTIONS, PROFILE, ROWS, rows
from vacantia.config import KeywordRules
from vacantia.operators import fit_review, snapshots, state
from vacantia.plans.ingest import ingest_run
from vacantia.schemas import TABLES, empty_table, evolve_schema
from vacantia.session import cut_lineage, work_dir
from vacantia.streaming import jobs

COLUMNS = ["canonical_fingerprint", "title", "status", "fit_score"]


def shown(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def run(spark, queue, batch, number):
    return cut_lineage(ingest_run(queue, spark.createDataFrame(batch, ROWS), KeywordRules(), PROFILE, OPTIONS, number, NOW).queue)


def test_stream_onto_a_filled_queue_with_another_writer_and_a_replay(spark):
    root = work_dir(spark, "s")
    tables, schema = f"{root}/tables", spark.createDataFrame(rows(1), ROWS).schema
    first, second, third = rows(12), rows(12, 100), rows(6, 200)
    queue = run(spark, empty_table(spark, "job_queue"), first, 1)
    for version in (1, 2, 3):  # the table is ahead of any batch number
        snapshots.write_snapshot(queue, tables, "job_queue", version, key="id")

    def ingest(batch):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = jobs.file_stream(spark, f"{root}/in", schema, files_per_batch=1)
        jobs.stream_ingest(stream, tables, f"{root}/cp", KeywordRules(), PROFILE, OPTIONS, NOW).awaitTermination()

    ingest(second)
    queue = run(spark, queue, second, 4)
    got = snapshots.read_snapshot(spark, tables, "job_queue")
    assert shown(got) == shown(queue)
    skipped, _ = state.skip_company(cut_lineage(got), got.first()["company"], NOW)
    snapshots.write_snapshot(cut_lineage(skipped), tables, "job_queue", snapshots.latest_version(spark, tables, "job_queue") + 1, key="id")
    ingest(third)
    queue = run(spark, cut_lineage(skipped), third, 6)
    assert shown(snapshots.read_snapshot(spark, tables, "job_queue")) == shown(queue)
    assert snapshots.read_rows(spark, tables, "job_sources").count() == len(second) + len(third)
    version = snapshots.latest_version(spark, tables, "job_queue")
    again = jobs.stream_ingest(jobs.file_stream(spark, f"{root}/in", schema, files_per_batch=1), tables, f"{root}/cp2", KeywordRules(), PROFILE, OPTIONS, NOW)
    again.awaitTermination()  # a lost checkpoint replays both batches
    assert snapshots.latest_version(spark, tables, "job_queue") == version
    assert snapshots.read_rows(spark, tables, "job_sources").count() == len(second) + len(third)


def test_results_reach_queue_items_batches_and_cache(spark):
    root = work_dir(spark, "r")
    tables = f"{root}/tables"
    queue = run(spark, empty_table(spark, "job_queue"), rows(6), 1)
    ids = sorted(r["id"] for r in queue.select("id").collect())
    items = [(f"c{i}", "b1", job, f"k{i}", "queued", 1) for i, job in enumerate(ids)]
    items = spark.createDataFrame(items, "custom_id string, batch_id string, job_id string, cache_key string, state string, run_id bigint")
    batches = spark.createDataFrame([("b1", "validating"), ("b2", "validating")], "batch_id string, status string")
    snapshots.write_snapshot(queue, tables, "job_queue", 5, key="id")
    snapshots.write_snapshot(evolve_schema(items, TABLES["llm_batch_items"]), tables, "llm_batch_items", 1, key="custom_id")
    snapshots.write_snapshot(evolve_schema(batches, TABLES["llm_batches"]), tables, "llm_batches", 1)

    def land(numbers, score):
        lines = [
            (json.dumps({"custom_id": f"c{i}", "response": {"body": {"choices": [{"message": {"content": json.dumps({"fit_label": "low", "fit_score": score})}}]}}}),)
            for i in numbers
        ]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(f"{root}/in")
        jobs.stream_llm_results(jobs.result_lines(spark, f"{root}/in"), tables, f"{root}/cp", 65, NOW).awaitTermination()

    land([0], 80)
    more = run(spark, snapshots.read_snapshot(spark, tables, "job_queue"), rows(3, 50), 2)
    snapshots.write_snapshot(more, tables, "job_queue", snapshots.latest_version(spark, tables, "job_queue") + 1, key="id")
    land([1], 10)
    after = {r["id"]: r for r in snapshots.read_snapshot(spark, tables, "job_queue").collect()}
    assert len(after) == more.count()
    assert (after[ids[0]]["fit_score"], after[ids[1]]["fit_score"]) == (80, 10)
    assert after[ids[1]]["llm_review_state"] == "completed"
    states = {r["custom_id"]: r["state"] for r in snapshots.read_snapshot(spark, tables, "llm_batch_items").collect()}
    assert states == {f"c{i}": "completed" if i < 2 else "queued" for i in range(len(ids))}
    assert {r["batch_id"]: r["status"] for r in snapshots.read_snapshot(spark, tables, "llm_batches").collect()} == {"b1": "completed", "b2": "validating"}
    assert {r["cache_key"]: r["fit_score"] for r in snapshots.read_snapshot(spark, tables, "llm_fit_cache").collect()} == {"k0": 80, "k1": 10}
    assert snapshots.read_rows(spark, tables, "llm_usage").agg(F.sum("calls")).first()[0] == 2
    assert snapshots.read_rows(spark, tables, "job_events").where("event_type = 'llm_batch_completed'").count() == 2


def test_events_of_all_kinds_are_unique_and_the_newest_come_first(spark):
    from datetime import timedelta

    from vacantia.operators.review import latest_events_per_job

    batch = spark.createDataFrame(rows(12), ROWS)
    result = ingest_run(empty_table(spark, "job_queue"), batch, KeywordRules(), PROFILE, OPTIONS, 9, NOW)
    queue = cut_lineage(result.queue)
    job = queue.first()["id"]
    later = NOW + timedelta(hours=1)
    change = spark.createDataFrame([(1, job, "applied")], "seq bigint, id string, status string")
    _, status = state.set_status(queue, change, later)
    _, again = state.set_status(queue, change, later + timedelta(hours=1))
    _, cleaned, _ = state.cleanup_inbox(queue, PROFILE, OPTIONS, 10, NOW)
    events = cut_lineage(result.events.unionByName(status).unionByName(again).unionByName(cleaned))
    assert events.select("id").distinct().count() == events.count()
    newest = latest_events_per_job(events, 2).where(F.col("job_id") == job).collect()
    assert {r["event_type"] for r in newest} == {"status_changed"}
    assert fit_review.rule_answers(spark.createDataFrame([("k", 80)], "cache_key string, fit_score int")).count() == 1


def test_deep_postings_long_page_runs_and_keyset_pages(spark):
    from vacantia.operators import review
    from vacantia.sources.landing import stitch_pages
    from vacantia.sources.pages import extract_jsonld_postings

    node = '{"@type":"JobPosting","title":"t%d"}'
    blocks = []
    for depth in range(11):
        body = node % depth
        for level in range(depth):
            body = f"[{body}]" if level % 2 else f'{{"@graph":[{body}]}}'
        blocks.append((depth, f'<script type="application/ld+json">{body}</script>'))
    found = extract_jsonld_postings(spark.createDataFrame(blocks, "page_id long, html string"))
    assert sorted(r[0] for r in found.select("page_id").collect()) == list(range(11))
    assert {r["page_id"]: r["node"].count(".") for r in found.select("page_id", "node").collect()} == {d: max(0, d - 1) for d in range(11)}
    pages = [("s", "long", i, True, 20 if i < 130 else 3) for i in range(140)] + [("s", "gap", i, True, 20) for i in range(9) if i != 4] + [("z", "gap", i, True, 20) for i in range(9)]
    kept = stitch_pages(spark.createDataFrame(pages, "source string, target string, page long, usable boolean, n_rows int"), 20)
    assert {(r["source"], r["target"]): r["n"] for r in kept.groupBy("source", "target").agg(F.count("*").alias("n")).collect()} == {("s", "long"): 131, ("s", "gap"): 4, ("z", "gap"): 9}
    data = [(f"{i:03d}", None if i % 7 == 0 else f"2020-01-{i % 5 + 1:02d}", i % 3, "c" if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(data, "id string, post_date string, score int, company string")
    for mode in ("newest", "oldest", "score", "company"):
        whole, paged, last = [r["id"] for r in review.sort_postings(df, mode).collect()], [], None
        while page := [r.asDict() for r in review.page_after(df, last, 13, mode).collect()]:
            paged += [r["id"] for r in page]
            last = page[-1]
        assert paged == whole
        assert [r["id"] for r in review.ranked_postings(df, mode).orderBy("place").collect()] == whole


def times(*days):
    from datetime import timedelta

    return [NOW + timedelta(days=d) for d in days]


def run_stream(spark, root, schema, start, batch):
    spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    start(jobs.file_stream(spark, f"{root}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)).awaitTermination()


def test_seen_state_writes_only_the_keys_of_a_micro_batch(spark):
    from vacantia.streaming.jobs import seen_state, stream_seen

    root, schema = work_dir(spark, "seen"), "key long, at timestamp"
    batches = [[(k, times(d)[0]) for k in range(100) for d in (0, 1)], [(7, times(-3)[0]), (500, times(2)[0]), (None, times(1)[0])], [(7, times(9)[0])]]
    for n, batch in enumerate(batches):
        before = snapshots.table_state(spark, root).table("seen_state")
        run_stream(spark, root, schema, lambda s: stream_seen(s, root, f"{root}/cp", "key", "at", buckets=16), batch)
        after = snapshots.table_state(spark, root).table("seen_state")
        changes = snapshots.read_rows(spark, root, "seen_changes").filter(F.col("version") == n)
        assert {r["key"] for r in changes.collect()} == {k for k, _ in batch}
        if n:
            own = snapshots.touched_buckets(spark.createDataFrame(batch, schema), "key", 16)
            assert sorted(b for b, (v, _) in after.parts.items() if v > before.version) == own and len(own) < 16
    whole = seen_state(spark.createDataFrame([r for b in batches for r in b], schema), "key", "at")
    assert sorted(map(str, snapshots.read_snapshot(spark, root, "seen_state").collect())) == sorted(map(str, whole.collect()))
    lost = jobs.file_stream(spark, f"{root}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    stream_seen(lost, root, f"{root}/cp-new", "key", "at").awaitTermination()  # a lost checkpoint replays what is visible
    assert sorted(map(str, snapshots.read_snapshot(spark, root, "seen_state").collect())) == sorted(map(str, whole.collect()))


def test_seen_keys_expire(spark):
    from datetime import timedelta

    root, schema = work_dir(spark, "seen"), "key long, at timestamp"
    for batch in ([(1, times(0)[0]), (2, times(4)[0])], [(3, times(9)[0])], [(1, times(9)[0])]):
        run_stream(spark, root, schema, lambda s: jobs.stream_seen(s, root, f"{root}/cp", "key", "at", keep=timedelta(days=6), buckets=1), batch)
    assert {r["key"]: r["n_seen"] for r in snapshots.read_snapshot(spark, root, "seen_state").collect()} == {1: 1, 2: 1, 3: 1}


def test_months_of_closed_days_and_late_events(spark):
    root, schema = work_dir(spark, "usage"), "calls long, created_at timestamp"
    start = lambda s: jobs.stream_usage(s, "calls", root, f"{root}/cp")
    day = {n: t for n, t in enumerate(times(*range(60)))}  # day 0 is 9 February
    run_stream(spark, root, schema, start, [(1, day[0]), (2, day[1]), (5, day[1]), (4, day[20])])  # 1 March
    run_stream(spark, root, schema, start, [(100, day[1]), (8, day[19]), (16, day[25])])  # day 1 is closed by now, day 19 is not
    assert {str(r["day"]): r["used"] for r in snapshots.read_rows(spark, root, "usage_days").collect()} == {"2026-02-09": 1, "2026-02-10": 7, "2026-02-28": 8, "2026-03-01": 4}
    months = {str(r["month"]): (r["used"], r["days"], str(r["last_day"])) for r in snapshots.read_snapshot(spark, root, "usage_months").collect()}
    assert months == {"2026-02-01": (16, 3, "2026-02-28"), "2026-03-01": (4, 1, "2026-03-01")}


def test_late_rows_are_dropped_and_counted_by_the_clock_of_the_batch(spark, monkeypatch):
    from datetime import datetime

    root, schema = work_dir(spark, "fresh"), "source string, post_date string"
    clock = iter(times(0, 5))

    class Clock(datetime):
        @classmethod
        def now(cls, tz=None):
            return next(clock)

    monkeypatch.setattr(jobs, "datetime", Clock)
    start = lambda s: jobs.stream_fresh(s, root, f"{root}/cp", 48)
    rows_ = [("a", "2026-02-08"), ("a", "2026-02-01"), ("b", None), ("b", "no date")]
    run_stream(spark, root, schema, start, rows_)
    run_stream(spark, root, schema, start, [*rows_, ("b", "2026-02-13")])  # five days later the first row is old too
    kept = snapshots.read_rows(spark, root, "fresh_postings")
    assert sorted((r["version"], r["source"], r["post_date"]) for r in kept.collect()) == [(0, "a", "2026-02-08"), (1, "b", "2026-02-13")]
    counts = snapshots.read_rows(spark, root, "freshness_counts").collect()
    told = {(r["version"], r["source"]): (r["raw_fetched"], r["kept_fresh"], r["dropped_old"], r["dropped_unknown_date"]) for r in counts}
    assert told == {(0, "a"): (2, 1, 1, 0), (0, "b"): (2, 0, 1, 1), (1, "a"): (2, 0, 2, 0), (1, "b"): (3, 1, 1, 1)}


def test_the_later_of_two_answers_wins_over_files_and_splits(spark):
    root = work_dir(spark, "order")
    tables = f"{root}/tables"
    queue = run(spark, empty_table(spark, "job_queue"), rows(5), 1)
    ids = sorted(r["id"] for r in queue.select("id").collect())
    custom = [(f"{'z' if n == 0 else 'a'}{i}", "b1", job, f"k{i}-{n}", "queued", 1) for i, job in enumerate(ids) for n in (0, 1)]  # the first answer has the greater id
    items = spark.createDataFrame(custom, "custom_id string, batch_id string, job_id string, cache_key string, state string, run_id bigint")
    snapshots.write_snapshot(queue, tables, "job_queue", 1, key="id", buckets=4)
    snapshots.write_snapshot(evolve_schema(items, TABLES["llm_batch_items"]), tables, "llm_batch_items", 1, key="custom_id", buckets=4)

    def line(custom_id, score, pad=0):
        answer = json.dumps({"fit_label": "low", "fit_score": score})
        return json.dumps({"custom_id": custom_id, "pad": "x" * pad, "response": {"body": {"choices": [{"message": {"content": answer}}]}}})

    filler = [line("nobody", 1, 900) for _ in range(400)]
    first_file = [line("z0", 10), line("a0", 20), *filler, line("z1", 30), *filler, line("a1", 40), line("z2", 50)]
    second_file = [line("a2", 60), line("a3", 70), *filler, line("z3", 80)]
    for n, lines in enumerate((first_file, second_file)):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{root}/in/{n}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        jobs.stream_llm_results(jobs.result_lines(spark, f"{root}/in/*"), tables, f"{root}/cp", 65, NOW).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    scores = {r["id"]: r["fit_score"] for r in snapshots.read_snapshot(spark, tables, "job_queue").collect()}
    assert [scores[i] for i in ids[:4]] == [20, 40, 60, 80]
