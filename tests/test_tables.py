"""Writers that get in each other's way, the key index, whole runs with failures anywhere, and the shared call budget."""

from __future__ import annotations

import glob
import json
from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.test_jobs import NOW, OPTIONS, PROFILE, ROWS, rows
from vacantia.config import GateOptions, KeywordRules
from vacantia.operators import commits, key_index, reservations, snapshots
from vacantia.plans import table_run
from vacantia.plans.ingest import ingest_run
from vacantia.schemas import empty_table
from vacantia.session import cut_lineage, work_dir
from vacantia.streaming import jobs

QUEUE_COLUMNS = ["canonical_fingerprint", "company", "title", "location", "post_date", "url", "status", "fit_score", "last_run_id", "first_seen_at"]


def numbers(spark, n, value=1):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(value).alias("v"))


def values(spark, root, name="t"):
    return {int(r["id"]): r["v"] for r in snapshots.read_snapshot(spark, root, name).collect()}


def test_two_writers_of_other_buckets_both_count(spark):
    root = work_dir(spark, "t")
    df = numbers(spark, 200)
    snapshots.write_snapshot(df, root, "t", 1, key="id", buckets=4)
    first = snapshots.write_snapshot(df.withColumn("v", F.lit(2)), root, "t", 2, key="id", buckets=4, touched=[0])
    second = snapshots.write_snapshot(df.withColumn("v", F.lit(3)), root, "t", 2, key="id", buckets=4, touched=[1])
    assert (first, second) == (2, 3)
    got = values(spark, root)
    buckets = {int(r["id"]): r["b"] for r in df.select("id", snapshots.bucket_of("id", 4).alias("b")).collect()}
    assert got == {i: {0: 2, 1: 3}.get(b, 1) for i, b in buckets.items()}


def test_two_writers_of_one_bucket_conflict_and_a_retry_keeps_both(spark):
    root = work_dir(spark, "t")
    snapshots.write_snapshot(numbers(spark, 20), root, "t", 1, key="id", buckets=2)
    base = snapshots.table_state(spark, root)
    for touched in ([0], None):
        snapshots.write_snapshot(numbers(spark, 20, 2), root, "t", snapshots.latest_version(spark, root, "t") + 1, key="id", buckets=2, touched=[0, 1])
        with pytest.raises(commits.WriteConflict):
            snapshots.write_snapshot(numbers(spark, 20, 9), root, "t", base.table("t").version + 1, key="id", buckets=2, touched=touched)
    assert set(values(spark, root).values()) == {2}
    others = [7]

    def change(part):
        if others:  # another writer comes in between, once
            own = spark.createDataFrame([(str(others.pop()),)], "id string")
            snapshots.change_table(spark, root, "t", "id", own, lambda df: df.withColumn("v", F.col("v") + 100), part.schema)
        return part.withColumn("v", F.col("v") + 10)

    everything = numbers(spark, 20)
    snapshots.change_table(spark, root, "t", "id", everything, change, everything.schema)
    bucket = snapshots.bucket_of("id", 2)
    of_seven = everything.filter(F.col("id") == "7").select(bucket).first()[0]
    told = {int(r["id"]): r["b"] for r in everything.select("id", bucket.alias("b")).collect()}
    assert values(spark, root) == {i: 112 if b == of_seven else 12 for i, b in told.items()}


def test_a_commit_number_is_given_once(spark):
    root = work_dir(spark, "t")
    log = commits.CommitLog(spark, root)
    assert log._create(1, "{}") and not log._create(1, "{}") and log.numbers() == [1]


def test_commits_in_a_store_behind_a_path_only_spark_reads(spark):
    """The route by a rename without overwriting, through a mount of a local folder."""
    root = work_dir(spark, "t").removeprefix("file:")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tables.link./in", f"file://{root}")
    far = "viewfs://tables/in"
    snapshots.write_snapshot(numbers(spark, 30), far, "t", 1, key="id", buckets=2)
    log = commits.CommitLog(spark, far)
    assert not log._create(1, "{}") and log._create(7, "{}") and not log._create(7, "{}") and log.numbers() == [1, 7]
    assert commits.CommitLog(spark, far).content(1)["number"] == 1
    assert not [f for f in glob.glob(f"{root}/_commits/.*") if not f.endswith(".crc")]


def test_read_buckets_guard_a_change(spark):
    log = commits.CommitLog(spark, work_dir(spark, "t"))
    first = log.commit(log.state(), [commits.Change("t", 1, {b: "a" for b in range(4)}, "id", 4, whole=True)])
    log.commit(first, [commits.Change("t", 2, {0: "b"}, "id", 4)])
    with pytest.raises(commits.WriteConflict):
        log.commit(first, [commits.Change("t", 2, {1: "c"}, "id", 4, read=[0])])
    assert log.commit(first, [commits.Change("t", 2, {1: "c"}, "id", 4, read=[2])]).table("t").version == 3


def test_appended_rows_show_with_their_commit(spark):
    root = work_dir(spark, "t")
    assert snapshots.read_rows(spark, root, "facts") is None
    snapshots.staged_rows(numbers(spark, 5), root, "facts", "w", 0)  # never committed
    snapshots.append_rows(numbers(spark, 3), root, "facts", 0, "w")
    snapshots.append_rows(numbers(spark, 3), root, "facts", 0, "w")
    snapshots.append_rows(numbers(spark, 4), root, "facts", 1, "w")
    assert snapshots.read_rows(spark, root, "facts").count() == 7


# --- the key index


def posting(seq, company, title, url, place="Toronto", day="2026-02-01"):
    return (seq, company, title, place, day, "s", url, "engineer")


def chains():
    """Batches whose rows link earlier ones through different keys: by link, by place and date, by fingerprint, and across two rows."""
    return [
        [posting(0, "A", "Engineer", "https://e.com/0"), posting(1, "B", "Engineer", "https://e.com/1"), posting(2, "C", "Engineer", None), posting(3, "D", "Engineer", "https://e.com/3")],
        [posting(10, "A", "Engineer", "https://e.com/1", "Ottawa"), posting(11, "C", "Engineer", "https://e.com/2"), posting(12, "E", "Engineer", "https://e.com/9")],
        [posting(20, "B", "Engineer", "https://e.com/2"), posting(21, "D", "Engineer", "https://e.com/3", day="2026-02-05"), posting(22, "F", "Engineer", "https://e.com/9", "Ottawa")],
        [posting(30, "A", "Engineer", "https://e.com/0"), posting(31, "C", "Engineer", None, day="2026-02-09"), posting(32, "G", "Engineer", "https://e.com/7")],
        [posting(40, "A", "Engineer", "https://e.com/7"), posting(41, "E", "Engineer", "https://e.com/2"), posting(42, "G", "Engineer", "https://e.com/3")],
    ]


def settings(options=OPTIONS, buckets=4, **more):
    return table_run.RunSettings(KeywordRules(), PROFILE, options, buckets=buckets, **more)


def shown(df, columns=QUEUE_COLUMNS):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def queue_of(spark, root):
    return snapshots.read_snapshot(spark, root, "job_queue")


def test_runs_through_the_index_equal_runs_over_the_whole_queue(spark):
    root = work_dir(spark, "k")
    queue = empty_table(spark, "job_queue")
    for n, batch in enumerate(chains()):
        df = spark.createDataFrame(batch, ROWS)
        now = NOW + timedelta(hours=n)
        table_run.run_on_tables(spark, root, df, settings(), now, "w", n)
        queue = cut_lineage(ingest_run(queue, df, KeywordRules(), PROFILE, OPTIONS, n + 1, now).queue)
        assert shown(queue_of(spark, root)) == shown(queue)
        state = snapshots.table_state(spark, root)
        assert key_index.is_current(state)
        index = snapshots.read_parts(spark, state.table(key_index.INDEX))
        fresh = key_index.index_rows(queue_of(spark, root))
        assert sorted(map(str, index.collect())) == sorted(map(str, fresh.collect()))


def test_untouched_buckets_are_neither_read_nor_written(spark):
    root = work_dir(spark, "k")
    many = [posting(i, f"Co{i}", "Engineer", f"https://e.com/{i}") for i in range(300)]
    table_run.run_on_tables(spark, root, spark.createDataFrame(many, ROWS), settings(buckets=64), NOW, "w", 0)
    state = snapshots.table_state(spark, root)
    batch = spark.createDataFrame([posting(900, "Co7", "Engineer", "https://e.com/7")], ROWS)
    keyed = cut_lineage(key_index.row_keys(table_run.gate_postings(batch, KeywordRules(), PROFILE, OPTIONS, NOW).withColumn("id", F.col("seq").cast("string"))))
    found, read = key_index.reachable(spark, state.table("queue_keys"), keyed.select(F.explode("keys").alias("key")))
    own = snapshots.touched_buckets(found, "id", 64)
    assert found.count() == 1 and 1 <= len(read) <= 3 and len(own) == 1
    spoiled = 0
    for table, kept in (("queue_keys", read), ("job_queue", own)):  # every other bucket is made unreadable
        folder = next(iter(state.table(table).parts.values()))[1].removeprefix("file:")
        for file in glob.glob(f"{folder}/bucket=*/*.parquet"):
            if int(file.split("bucket=")[1].split("/")[0]) not in kept:
                spoiled += 1
                with open(file, "wb") as f:
                    f.write(b"no Parquet")
    assert spoiled > 100
    table_run.run_on_tables(spark, root, batch, settings(), NOW + timedelta(hours=1), "w", 1)
    after = snapshots.table_state(spark, root)
    for table, kept in (("queue_keys", read), ("job_queue", own)):
        assert sorted(b for b, (v, _) in after.table(table).parts.items() if v > state.table(table).version) == kept
    assert [r["last_run_id"] for r in snapshots.read_snapshot(spark, root, "job_queue", own).filter("company = 'Co7'").collect()] == [2]


def test_index_sees_writers_that_leave_it_behind(spark):
    root = work_dir(spark, "k")
    first, second = chains()[:2]
    table_run.run_on_tables(spark, root, spark.createDataFrame(first, ROWS), settings(), NOW, "w", 0)
    queue = queue_of(spark, root)
    extra = queue.filter("company = 'A'").withColumns({"id": F.lit("zz"), "company": F.lit("E"), "company_key": F.lit("e"), "canonical_fingerprint": F.lit("own"), "url": F.lit("https://e.com/9")})
    snapshots.change_table(spark, root, "job_queue", "id", extra.select("id"), lambda df: df.unionByName(extra), queue.schema)
    assert not key_index.is_current(snapshots.table_state(spark, root))
    snapshots.change_table(spark, root, "job_queue", "id", queue.select("id"), lambda df: df.withColumn("status", F.lit("inbox")), queue.schema, same_keys=True)
    table_run.run_on_tables(spark, root, spark.createDataFrame(second, ROWS), settings(), NOW, "w", 1)
    assert key_index.is_current(snapshots.table_state(spark, root))
    assert queue_of(spark, root).filter("id = 'zz' and canonical_fingerprint like 'url:%'").count() == 1  # row 12 found it by its link
    snapshots.change_table(spark, root, "job_queue", "id", queue.select("id"), lambda df: df.withColumn("status", F.lit("skipped")), queue.schema, same_keys=True)
    assert key_index.is_current(snapshots.table_state(spark, root))


def test_long_chain_of_old_rows_and_a_hot_key(spark):
    """Rows written without matching: 12 that each share a key with the next, and 500 of one key."""
    root = work_dir(spark, "k")
    base = ingest_run(empty_table(spark, "job_queue"), spark.createDataFrame([posting(0, "A", "Engineer", None)], ROWS), KeywordRules(), PROFILE, OPTIONS, 1, NOW).queue
    chain = spark.range(12).select(
        F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("cid"), F.concat(F.lit("fp"), ((F.col("id") + 1) / 2).cast("int").cast("string")).alias("fp"),
        F.concat(F.lit("Chain"), (F.col("id") / 2).cast("int").cast("string")).alias("company_"),
    )
    hot = spark.range(500).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("cid"), F.lit("hot").alias("fp"), F.concat(F.lit("Hot"), F.col("id").cast("string")).alias("company_"))
    made = chain.unionByName(hot).crossJoin(F.broadcast(base.limit(1))).withColumns({"id": F.col("cid"), "canonical_fingerprint": F.col("fp"), "company": F.col("company_"), "company_key": F.lower("company_")})
    made = cut_lineage(made.select(*base.columns))
    snapshots.write_snapshot(made, root, "job_queue", 1, key="id", buckets=4)
    state = key_index.current_index(spark, root, snapshots.table_state(spark, root), 4)
    start = key_index.row_keys(made.filter("id = 'c000'")).select(F.explode("keys").alias("key"))
    assert {r["id"] for r in key_index.reachable(spark, state.table("queue_keys"), start)[0].collect()} == {f"c{i:03d}" for i in range(12)}
    start = key_index.row_keys(made.filter("id = 'h7'")).select(F.explode("keys").alias("key"))
    assert key_index.reachable(spark, state.table("queue_keys"), start)[0].count() == 500
    batch = spark.createDataFrame([posting(5, "Chain3", "Engineer", None), posting(6, "Hot44", "Engineer", None)], ROWS)
    table_run.run_on_tables(spark, root, batch, settings(), NOW, "w", 0)
    expected = ingest_run(made, batch, KeywordRules(), PROFILE, OPTIONS, 2, NOW).queue
    assert shown(queue_of(spark, root)) == shown(expected)


# --- whole runs

REVIEW = GateOptions(90, 5, 89, review_enabled=True, daily_cap=4, run_cap=3)
TABLE_COLUMNS = {
    "job_queue": [*QUEUE_COLUMNS, "id", "fit_source", "llm_review_state", "llm_review_error"], "queue_keys": ["key", "id"],
    "llm_fit_cache": ["cache_key", "fit_label", "fit_score"], "llm_reservations": ["run_key", "calls"],
}
ROW_COLUMNS = {
    "job_sources": ["job_id", "run_id", "source_job_key", "payload_hash"], "job_events": ["id", "job_id", "run_id", "event_type"],
    "ingestion_runs": ["id", "status", "summary_json"], "llm_usage": ["run_id", "calls"], "freshness_counts": ["source", "raw_fetched", "kept_fresh", "dropped_old", "dropped_unknown_date", "run_id"],
}


def contents(spark, root):
    out = {n: shown(snapshots.read_snapshot(spark, root, n), c) for n, c in TABLE_COLUMNS.items() if snapshots.latest_version(spark, root, n)}
    for name, columns in ROW_COLUMNS.items():
        found = snapshots.read_rows(spark, root, name)
        out[name] = shown(found, columns) if found is not None else []
    return out


def visible(found):
    """What a run shows: reservations are made before it, and an index of nothing has no rows."""
    return {n: r for n, r in found.items() if r and n != "llm_reservations"}


def landed():
    stale = [posting(50, "Old", "Engineer", "https://e.com/50", day="2026-01-01"), posting(51, "None", "Engineer", "https://e.com/51", day=None)]
    return [chains()[0] + stale, chains()[1], chains()[2]]


def test_stream_equals_runs_in_all_tables_whatever_fails(spark, monkeypatch):
    told = dict(fresh_hours=24 * 30, trigger="schedule")
    plain = work_dir(spark, "plain")
    for n, batch in enumerate(landed()):
        table_run.run_on_tables(spark, plain, spark.createDataFrame(batch, ROWS), settings(REVIEW, **told), NOW, "ingest", n)
    expected = contents(spark, plain)
    assert len(expected["ingestion_runs"]) == 3 and expected["llm_usage"] and expected["llm_reservations"] == []
    assert [r[1:5] for r in expected["freshness_counts"] if r[5] == 1] == [(6, 4, 1, 1)]

    root = work_dir(spark, "failing")
    left, calls = [[1, 5], [2, 4, 8], [3, 7]], {"n": 0}  # the writes that fail, one after the other, for each batch

    def failing(real):
        def write(*args, **kwargs):
            calls["n"] += 1
            if now_left and calls["n"] == now_left[0]:
                now_left.pop(0)
                raise OSError("lost")
            return real(*args, **kwargs)

        return write

    for name in ("staged", "staged_rows", "index_change", "staged_change", "settled"):
        monkeypatch.setattr(table_run, name, failing(getattr(table_run, name)))
    schema, failed = spark.createDataFrame(landed()[0], ROWS).schema, 0
    for batch, now_left in zip(landed(), left, strict=True):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.mode("append").parquet(f"{root}/in")
        before = visible(contents(spark, root))
        while True:
            calls["n"] = 0
            stream = jobs.file_stream(spark, f"{root}/in", schema, files_per_batch=1)
            try:
                jobs.stream_ingest(stream, root, f"{root}/cp", KeywordRules(), PROFILE, REVIEW, NOW, buckets=4, **told).awaitTermination()
                break
            except StreamingQueryException:
                failed += 1
                assert visible(contents(spark, root)) == before
    assert failed == 7 and contents(spark, root) == expected


def test_postings_without_numbers_get_them_in_order(spark):
    df = spark.createDataFrame([(i % 3, i, f"c{i}") for i in range(50)], "source_rank int, row int, company string").repartition(5)
    out = table_run.number_rows(df, "source_rank", "row").collect()
    assert len({r["seq"] for r in out}) == 50
    assert [(r["source_rank"], r["row"]) for r in sorted(out, key=lambda r: r["seq"])] == sorted((i % 3, i) for i in range(50))


def test_batch_review_is_handed_over_once(spark):
    options = GateOptions(90, 5, 89, review_mode="batch")
    root, told = work_dir(spark, "b"), settings(options)
    table_run.run_on_tables(spark, root, spark.createDataFrame(chains()[0], ROWS), told, NOW, "w", 0)
    failed = table_run.flush_review_batch(spark, root, 1, told, NOW, lambda path: (_ for _ in ()).throw(RuntimeError("file_upload_500")))
    assert failed is not None and {r["state"] for r in snapshots.read_snapshot(spark, root, "llm_batch_items").collect()} == {"failed"}
    paths = []
    assert table_run.flush_review_batch(spark, root, 1, told, NOW, lambda path: paths.append(path) or "b9") is not None
    assert table_run.flush_review_batch(spark, root, 1, told, NOW, lambda path: paths.append(path) or "b10") is None and len(paths) == 1
    queue = queue_of(spark, root)
    assert {(r["llm_review_state"], r["llm_pending_batch_id"]) for r in queue.collect()} == {("pending", "b9")}
    assert spark.read.text(paths[0]).count() == queue.count()
    assert [r["batch_id"] for r in snapshots.read_snapshot(spark, root, "llm_batches").collect()] == ["b9"]


def test_overlapping_runs_share_the_days_calls(spark):
    root = work_dir(spark, "r")
    first = reservations.reserve_calls(spark, root, "a/0", NOW, 3, 5, 10)
    second = reservations.reserve_calls(spark, root, "b/0", NOW, 4, 5, 10)
    again = reservations.reserve_calls(spark, root, "a/0", NOW, 3, 5, 10)
    assert (first.calls, second.calls, second.by_day, again) == (3, 2, True, first)
    assert reservations.reserve_calls(spark, root, "c/0", NOW, 4, 5, 10).calls == 0
    assert reservations.reserve_calls(spark, root, "c/1", NOW + timedelta(days=1), 9, 5, 2) == reservations.Reservation("c/1", 2, False)
    state = snapshots.table_state(spark, root)
    commits.CommitLog(spark, root).commit(state, [reservations.settled(spark, root, state, first)])
    assert reservations.used_today(spark, root, snapshots.table_state(spark, root), NOW) == 2


def payload_rows(spark):
    def board(jobs_):
        return json.dumps({"jobs": jobs_})

    lever = [{"text": f"Engineer {i}", "categories": {"location": "Toronto"}, "hostedUrl": f"https://l.com/{i}", "createdAt": 1, "descriptionPlain": "engineer"} for i in range(3)]
    bamboo = [{"id": str(i), "jobOpeningName": f"Engineer {i}", "location": "Toronto", "date": day, "url": f"https://b.com/{i}", "description": "engineer"}
              for i, day in enumerate(["2026-02-08", "2026-01-01", "2026-02-07"])]
    landed_rows = [("lever", "a", "a", json.dumps(lever)), ("bamboohr", "b", "b", board(bamboo)), ("bamboohr", "c", "c", "{}")]
    df = spark.createDataFrame(landed_rows, "source string, slug string, target string, body string")
    return df.withColumns({"http_status": F.lit(200), "content_type": F.lit("application/json"), "priority": F.lit(0), "batch_seq": F.lit(0).cast("bigint"), "site": F.lit(None).cast("string")})


def test_a_run_from_payloads_to_the_run_row(spark):
    root = work_dir(spark, "p")
    options = GateOptions(90, 5, 89, review_mode="batch")
    told = settings(options, fresh_hours=72)
    handed = []
    run_ = lambda: table_run.run_payloads(spark, root, payload_rows(spark), ["lever", "bamboohr"], told, NOW, "core", 0, hand_over=lambda p: handed.append(p) or "b1")
    assert run_() is not None
    queue = queue_of(spark, root)
    row = snapshots.read_rows(spark, root, "ingestion_runs").first()
    summary = json.loads(row["summary_json"])
    n = queue.count()
    assert row["status"] == "success" and summary["requestedSources"] == ["lever", "bamboohr"] and summary["totals"]["fetched"] == n == summary["totals"]["inserted"]
    assert {r["source"] for r in queue.collect()} == {"lever", "bamboohr"} and queue.filter("source = 'lever'").count() == 3
    counts = {r["source"]: (r["raw_fetched"], r["kept_fresh"], r["dropped_old"]) for r in snapshots.read_rows(spark, root, "freshness_counts").collect()}
    assert counts["bamboohr"][0] == 3 and counts["bamboohr"][1] == n - 3 and "lever" not in counts
    assert summary["llm"]["batchQueued"] == spark.read.text(handed[0]).count() > 0
    version = snapshots.table_state(spark, root).number
    run_()
    assert snapshots.table_state(spark, root).number == version and len(handed) == 1
