"""Entity resolution and skew helpers against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import Window as W, functions as F

from vacantia.config import GateOptions, KeywordRules, Profile
from vacantia.functions.keys import fingerprint, normalize_posting, posting_keys
from vacantia.operators import entities, skew, state
from vacantia.schemas import empty_table

NOW = datetime(2026, 2, 9, tzinfo=timezone.utc)
ROWS = "seq bigint, company string, title string, location string, post_date string, source string, url string, jd_text string"
PROFILE = Profile(("engineer",), (), (), ("toronto",), hard_exclusions=("senior",))
OPTIONS = GateOptions(20, 5, 10)
HOT = {"at_least": 2, "limit": 3}


def components_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for node, key in edges:
        a, b = find(node), find(("key", key))
        if a != b:
            parent[a] = b
    groups = {}
    for node, _ in edges:
        groups.setdefault(find(node), set()).add(node)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("hot", [{}, HOT])
def test_components_match_union_find(spark, hot):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(60):02d}", f"p{rng.randrange(70)}", rng.choice([None, f"l{rng.randrange(70)}"])) for _ in range(110)]
    out = entities.dedup_components(spark.createDataFrame(rows, "node string, key_posting string, key_link string").distinct(), **hot).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["component"], set()).add(r["node"])
    expected = components_of([(n, k) for n, a, b in rows for k in (a, b) if k])
    assert {frozenset(g) for g in groups.values()} == expected
    assert all(c == min(g) for c, g in groups.items())


@pytest.mark.parametrize("hot", [{}, HOT])
def test_a_long_chain_closes(spark, hot):
    order = list(range(64))
    random.Random(3).shuffle(order)
    rows = [(f"n{order[i]:03d}", f"k{i}", f"k{i + 1}") for i in range(64)]
    out = entities.dedup_components(spark.createDataFrame(rows, "node string, key_posting string, key_link string"), **hot)
    assert {r["component"] for r in out.collect()} == {"n000"}


def test_lookup_join_keeps_every_row_on_all_paths(spark):
    rows = spark.createDataFrame([("hot",)] * 50 + [("warm",)] * 9 + [(f"k{i}",) for i in range(20)] + [(None,)] * 7, "key string").withColumn("n", F.monotonically_increasing_id())
    lookup = spark.createDataFrame([("hot", 1), ("warm", 2), ("k3", 3), ("unused", 4)], "key string, value int")
    got = skew.lookup_join(rows, lookup, "key", limit=1, at_least=5)
    expected = rows.join(lookup, "key", "left")
    assert sorted(map(repr, got.select("n", "key", "value").collect())) == sorted(map(repr, expected.select("n", "key", "value").collect()))


def test_previous_value_and_running_max_equal_plain_windows(spark):
    rng = random.Random(1)
    seqs = rng.sample(range(1000), 200)
    rows = spark.createDataFrame([("a" if rng.random() < 0.7 else "b", s, rng.choice([None, rng.randrange(100)])) for s in seqs], "g string, seq bigint, v int")
    w = W.partitionBy("g").orderBy("seq")
    plain = rows.withColumns({"prev": F.lag("v").over(w), "top": F.max("v").over(w.rowsBetween(W.unboundedPreceding, 0))})
    got = skew.running_max(skew.previous_value(rows, "g", "seq", F.col("v"), "prev", 7), "g", "seq", F.col("v"), "top", 5)
    assert sorted(map(repr, got.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_negative_and_sparse_orders(spark):
    rows = spark.createDataFrame([("a", -50, "x"), ("a", -3, "y"), ("a", 10**9, "z")], "g string, seq bigint, v string")
    got = skew.previous_value(rows, "g", "seq", F.col("v"), "prev", 1).orderBy("seq").collect()
    assert [r["prev"] for r in got] == [None, "x", "y"]


def batch_of(rng, start, n):
    """Postings whose entity is decided by one key: an entity has one link, or one company and title without a link."""
    rows = []
    for i in range(n):
        e = rng.randrange(8)
        if e % 2:
            url, place, day = f"https://e.com/{e}?x={i}", "Toronto", f"2026-02-{rng.randrange(1, 28):02d}"
            title = f"Engineer {e} v{start + i}"
        else:
            url, place, day, title = None, rng.choice(["Toronto", "Paris"]), f"2026-02-0{rng.randrange(1, 9)}", f"Engineer {e}"
        text = rng.choice(["engineer role", "senior engineer", "cook"])
        rows.append((start + i, f"Co{e}", title, place, day, "s", url, text))
    return rows


def sequential(batches, evaluated):
    """Row-by-row model: match on any key, rewrite or insert, keep decided statuses."""
    queue, results = [], []
    for batch in batches:
        for row in batch:
            e = evaluated[row[0]]
            hit = next(
                (q for q in queue if q["fp"] == e["canonical_fingerprint"] or q["k4"] == (e["company_key"], e["title_key"], e["location_key"], e["post_date_key"])
                 or (q["company"], q["title"], q["url"] or "") == (e["company"], e["title"], e["url"] or "")), None)
            before = hit["status"] if hit else None
            if hit is None:
                hit = {"first": row[0], "status": None}
                queue.append(hit)
            hit.update(
                fp=e["canonical_fingerprint"], k4=(e["company_key"], e["title_key"], e["location_key"], e["post_date_key"]), company=e["company"], title=e["title"],
                url=e["url"], seq=row[0], status=before if before in ("approved", "applied", "skipped") else e["admission_status"],
            )
            results.append((row[0], "deduped" if before else "inserted", before, before == "filtered" and e["admission_status"] == "inbox"))
    return queue, results


@pytest.mark.parametrize("seed,hot", [(1, {}), (2, HOT)])
def test_upsert_equals_the_row_by_row_model(spark, seed, hot):
    rng = random.Random(seed)
    batches = [batch_of(rng, 0, 25), batch_of(rng, 100, 25)]
    queue, got, evaluated = empty_table(spark, "job_queue"), [], {}
    for run, batch in enumerate(batches, 1):
        scored = state.evaluate_postings(spark.createDataFrame(batch, ROWS), KeywordRules(), PROFILE, OPTIONS, NOW)
        evaluated.update({r["seq"]: r for r in scored.collect()})
        queue, outcome = state.upsert_postings(queue, scored, run, NOW, **hot)
        got += [(r["seq"], r["result"], r["previous_status"], r["resurfaced"]) for r in outcome.collect()]
    expected_queue, expected = sequential(batches, evaluated)
    assert sorted(got) == sorted(expected)
    rows = queue.collect()
    assert sorted((r["canonical_fingerprint"], r["status"], r["title"], r["last_run_id"]) for r in rows) == sorted(
        (q["fp"], q["status"], q["title"], 1 if q["seq"] < 100 else 2) for q in expected_queue)
    assert len({r["id"] for r in rows}) == len(rows)


def test_decided_status_survives_and_null_fingerprints_never_match(spark):
    rows = [(1, "Co", "Engineer", "Toronto", "2026-02-01", "s", None, "engineer")]
    scored = state.evaluate_postings(spark.createDataFrame(rows, ROWS), KeywordRules(), PROFILE, OPTIONS, NOW)
    queue, _ = state.upsert_postings(empty_table(spark, "job_queue"), scored, 1, NOW)
    manual, _ = state.ingest_manual(queue, spark.createDataFrame([(7, "Other", "Cook", None, None, None, None, None)], ROWS), KeywordRules(), NOW)
    approved = manual.withColumn("status", F.lit("approved"))
    again, outcome = state.upsert_postings(approved, scored, 2, NOW)
    assert {(r["company"], r["status"]) for r in again.collect()} == {("Co", "approved"), ("Other", "approved")}
    assert [(r["result"], r["previous_status"]) for r in outcome.collect()] == [("deduped", "approved")]


@pytest.mark.parametrize("hot", [{}, HOT])
def test_match_existing_equals_an_or_condition(spark, hot):
    rng = random.Random(9)
    base = [(i, f"Co{rng.randrange(3)}", f"T{rng.randrange(3)}", rng.choice(["A", "B"]), f"2026-02-0{rng.randrange(1, 4)}", "s", rng.choice([None, f"https://e.com/{rng.randrange(6)}"]), "x") for i in range(60)]
    keyed = fingerprint(posting_keys(normalize_posting(spark.createDataFrame(base, ROWS))))
    queue = keyed.filter("seq < 20").withColumns({"id": F.lpad(F.col("seq").cast("string"), 3, "0"), "first_seen_at": F.timestamp_seconds("seq")})
    batch = keyed.filter("seq >= 20")
    got = {r["seq"]: r["matched_by"] for r in entities.match_existing(batch, queue, **hot).collect()}
    q, expected = queue.collect(), {}
    for r in batch.collect():
        tests = {
            "fingerprint": lambda x: x["canonical_fingerprint"] == r["canonical_fingerprint"],
            "posting": lambda x: all(x[k] == r[k] for k in ("company_key", "title_key", "location_key", "post_date_key")),
            "link": lambda x: (x["company"], x["title"], x["url"] or "") == (r["company"], r["title"], r["url"] or ""),
        }
        hit = next((name for name, t in tests.items() if any(t(x) for x in q)), None)
        if hit:
            expected[r["seq"]] = hit
    assert got == expected


def test_ranges_hold_even_shares_of_bunched_values(spark):
    from vacantia.operators.metrics import error_text

    rows = spark.range(20_000).select(
        F.when(F.col("id") % 100 > 0, 10_000_000 + F.col("id")).otherwise(F.col("id") * 1_000_000).alias("seq"), F.lit("hot").alias("g"),
        (F.col("id") % 97).alias("v"),
    ).distinct()
    sizes = [r["count"] for r in skew.in_ranges(rows, "seq", 500).groupBy("_chunk").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 2 * sum(sizes) / len(sizes)
    w = W.partitionBy("g").orderBy("seq")
    expected = rows.withColumns({"prev": F.lag("v").over(w), "top": F.max("v").over(w.rowsBetween(W.unboundedPreceding, 0))})
    got = skew.running_max(skew.previous_value(rows, "g", "seq", F.col("v"), "prev", 500), "g", "seq", F.col("v"), "top", 700)
    assert sorted(map(str, got.select("seq", "prev", "top").collect())) == sorted(map(str, expected.select("seq", "prev", "top").collect()))
    told = error_text(rows.select("g", "seq", F.lit("s").alias("source"), F.col("v").cast("string").alias("message")), "g", 500).first()
    assert told["error_text"] == " | ".join(f"s: {r['v']}" for r in rows.orderBy("seq").collect())


def test_ranges_of_equal_and_no_values(spark):
    same = spark.range(50).select(F.lit(3).cast("bigint").alias("seq"))
    assert skew.in_ranges(same, "seq", 5).select("_chunk").distinct().count() == 1
    assert skew.in_ranges(same.limit(0), "seq", 5).count() == 0
