"""Queries on tables with copies of rows under shifted keys, as larger tables have them."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vacantia.config import GateOptions, KeywordRules
from vacantia.operators import fit_review, state
from vacantia.plans import bindings as b, catalog_entities, catalog_fit, catalog_review, catalog_sources, table_run
from vacantia.session import work_dir

COPY = 100


@pytest.fixture(scope="module")
def grown(spark):
    """Documents 0 to 59 and copies of them under numbers that are ``COPY`` higher, which differ in nothing but the number and, for most, the link."""
    root = work_dir(spark, "grown")
    ids = [*range(60), *range(COPY, COPY + 60)]
    tables = {
        "documents": ([(i, f"text {i % COPY}", "en", "src1", 6) for i in reversed(ids)], "doc_id bigint, text string, lang string, source string, n_chars int"),
        "labels": ([(5, 0, 1), (COPY + 5, 1, 0), (10, 1, 0)], "doc_id bigint, quality int, toxic int"),
        "part": ([(i, f"red ring {i % COPY}", 3) for i in ids], "p_partkey bigint, p_name string, p_size int"),
        "orders": ([(i, datetime(2001, 1, 1)) for i in ids], "o_orderkey bigint, o_orderdate timestamp"),
        "nation": ([(i, f"nation_{i}") for i in range(25)], "n_nationkey int, n_name string"),
        "pages": ([(i, f"https://e.com/{i}") for i in range(COPY)], "page_id bigint, url string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def test_copies_share_one_cache_row(spark, grown):
    rows = catalog_fit.join_fit_cache(spark, grown).collect()
    assert len(rows) == len({r["seq"] for r in rows}) == 120
    found = {r["seq"]: r["fit_label"] for r in rows if r["fit_label"]}
    assert found == {5: "high", COPY + 5: "high", 10: "high", COPY + 10: "high"}


def test_review_answers_gives_each_posting_once(spark, grown):
    rows = catalog_fit.review_answers(spark, grown).collect()
    assert rows and len(rows) == len({r["seq"] for r in rows})


def test_landed_pages_do_not_depend_on_the_order_of_rows(spark, grown, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog_sources, "land", lambda rows, *_: seen.append(rows) or rows.select(*[F.lit(None).alias(c) for c in ("target", "kind", "priority", "company", "title", "location", "post_date", "url")]))
    catalog_sources.landed_postings(spark, grown)
    for page in seen[0].filter("priority = 3").collect():
        places = [page["body"].index(f'"title":"red ring {i % COPY}"') for i in range(page["batch_seq"] * 20, page["batch_seq"] * 20 + 20)]
        assert places == sorted(places)


def test_texts_are_shuffled_once_when_no_table_is_small(spark, grown):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = b.postings(spark, grown)._jdf.queryExecution().executedPlan().toString()
        rows = b.postings(spark, grown).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") <= 4  # the texts and the three tables joined to them
    assert {r["seq"]: r["url"] for r in rows} == {i: f"https://e.com/{i // 4}" if i % 5 else None for i in [*range(60), *range(COPY, COPY + 60)]}


def test_page_numbers_below_zero_link_like_a_division(spark):
    root = work_dir(spark, "negative")
    ids = list(range(-9, 10))
    tables = {
        "documents": ([(i, "t", "en", "s") for i in ids], "doc_id bigint, text string, lang string, source string"),
        "part": ([(i, "n", 3) for i in ids], "p_partkey bigint, p_name string, p_size int"),
        "orders": ([(i, datetime(2001, 1, 1)) for i in ids], "o_orderkey bigint, o_orderdate timestamp"),
        "nation": ([(i, f"nation_{i}") for i in range(-24, 25)], "n_nationkey int, n_name string"),
        "pages": ([(i, f"https://e.com/{i}") for i in range(-3, 4)], "page_id bigint, url string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    found = {r["seq"]: r["url"] for r in b.postings(spark, root).collect()}
    assert found == {i: f"https://e.com/{int(i / 4)}" if i % 5 else None for i in ids}


def test_sort_postings_scores_the_texts_once(spark, grown, monkeypatch):
    ranked, plans = catalog_review.rv.ranked_postings, []
    monkeypatch.setattr(catalog_review.rv, "ranked_postings", lambda rows, mode: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or ranked(rows, mode))
    assert catalog_review.sort_postings(spark, grown).count() == 5 * 120
    assert len(plans) == 5 and not any("Join" in p for p in plans)


def test_submit_batch_gates_the_queue_once(spark, grown, monkeypatch):
    submit, plans = catalog_fit.fr.submit_batch, []

    def spied(queue, pending, items, *rest):
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in (pending, items))
        return submit(queue, pending, items, *rest)

    monkeypatch.setattr(catalog_fit.fr, "submit_batch", spied)
    catalog_fit.submit_batch(spark, grown)
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_a_run_without_review_writes_the_texts_twice(spark, monkeypatch):
    cut, written = table_run.cut_lineage, []
    monkeypatch.setattr(table_run, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    rows = spark.createDataFrame([(1, "Co", "Ring", "nation_1", "2001-01-01", "s", "https://e.com/1", "red ring")], "seq bigint, company string, title string, location string, post_date string, source string, url string, jd_text string")
    root = work_dir(spark, "run")
    assert table_run.run_on_tables(spark, root, rows, table_run.RunSettings(KeywordRules(), b.PROFILE, GateOptions(45, 20, 44)), b.AS_OF, "run", 0) is not None
    assert sum("jd_text" in columns for columns in written) == 2  # as they came and as they are gated
    assert table_run.read_rows(spark, root, "job_sources").count() == 1


def test_the_old_queue_leaves_the_other_half_out_before_scoring(spark, grown):
    queue = catalog_entities.old_queue(spark, grown)
    plan = queue._jdf.queryExecution().optimizedPlan().toString()
    assert "% 2) = 0" in plan[plan.rindex("CollectMetrics"):]  # below the scoring, which later filters do not pass
    assert {r["id"] for r in queue.select("id").collect()} == {f"j{i:012d}" for i in [*range(0, 60, 2), *range(COPY, COPY + 60, 2)]}


def test_the_outcome_alone_writes_no_texts_and_scores_no_keywords(spark, grown, monkeypatch):
    cut, written = state.cut_lineage, []
    monkeypatch.setattr(state, "cut_lineage", lambda df: written.append(df) or cut(df))
    alone = catalog_entities.append_lineage(spark, grown)
    assert not any("jd_text" in df.columns for df in written)
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "payload_hash" in plan and "+A:ringx" not in plan
    both = state.upsert_postings(catalog_entities.old_queue(spark, grown), catalog_entities.evaluated_batch(spark, grown), catalog_entities.RUN, b.AS_OF)[1]
    whole = state.append_lineage(both, catalog_entities.RUN, b.AS_OF).withColumn("ingested_at", catalog_entities.ts("ingested_at"))
    assert alone.count() == 60 and sorted(map(str, alone.collect())) == sorted(map(str, whole.collect()))


def test_verdicts_meet_the_queue_without_moving_its_texts(spark, grown):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queue = b.queue(spark, grown)
        answer = F.struct(F.lit("high").alias("fit_label"), F.lit(70).alias("fit_score"), F.lit(0.5).alias("confidence"), *[F.array().cast("array<string>").alias(c) for c in ("reason_codes", "missing_must_have")])
        results = spark.range(2).select("id", F.col("id").alias("seq"), F.col("id").cast("string").alias("custom_id"), F.lit("j000000000005").alias("job_id"), F.lit(1).cast("bigint").alias("run_id"), F.lit("completed").alias("state"), answer.alias("answer")).drop("id")
        changed, events = fit_review.apply_llm_results(queue, results, 65, b.AS_OF)
        plans = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") for df in (queue, changed)]
        found = {r["id"]: r["fit_source"] for r in changed.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[0] == plans[1] and events.count() == 2
    assert len(found) == 120 and [i for i, source in found.items() if source == "llm"] == ["j000000000005"]
