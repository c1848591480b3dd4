"""Postings, queue rows and landed payloads derived from the given tables, for queries, tests and bench."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from vacantia.config import GateOptions, KeywordRules, Profile
from vacantia.functions.keys import fingerprint, normalize_posting, posting_keys
from vacantia.functions.text import years_requirement
from vacantia.operators.gate import fit_gate
from vacantia.operators.scoring import keyword_score
from vacantia.schemas import TABLES, evolve_schema
from vacantia.session import spread

AS_OF = datetime(2001, 8, 2, tzinfo=timezone.utc)
EVENTS_AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
FRESH_HOURS = 17520
RULES = KeywordRules(
    tier_a=(("ring", 15), ("widget", 12)), tier_b=(("red", 6), ("ring", 4)), negative=(("old", 10), ("plate", 8)),
    hard_words=("rod",),
)
PROFILE = Profile(
    target_roles=("ring", "widget"), must_have_skills=("red", "the"), nice_to_have_skills=("blue",),
    location_preferences=("nation_1",), hard_exclusions=("rod", "40+ years"),
)
OPTIONS = GateOptions(min_inbox_score=45, borderline_min=20, borderline_max=44)
PAYLOAD_ROWS = 20
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zoneless times are UTC."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def postings(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """One posting per document; ``documents`` may be a stream. Four documents share a page link. Every table that grows is joined on the document's
    number, so the texts are shuffled once at most."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id") if documents is None else documents
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    page = F.col("page_id")
    sharing = F.sequence(page * 4 - F.when(page > 0, 0).otherwise(3), page * 4 + F.when(page < 0, 0).otherwise(3))  # ids with ``id div 4`` = page
    g = table(spark, sf_dir, "pages").select(F.explode(sharing).alias("_linked"), "url")
    joined = (
        d.select("doc_id", "text", "lang", "source")
        .join(p, F.col("p_partkey") == F.col("doc_id"))
        .join(o, F.col("o_orderkey") == F.col("doc_id"))
        .join(g, F.col("_linked") == F.col("doc_id"))
        .join(F.broadcast(n), F.col("n_nationkey") == F.col("doc_id") % 25)
    )
    return joined.select(
        F.col("doc_id").alias("seq"), F.col("source").alias("company"), F.col("p_name").alias("title"),
        F.col("n_name").alias("location"),
        F.when(F.col("doc_id") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("post_date"),
        F.col("lang").alias("source"), F.when(F.col("doc_id") % 5 != 0, F.col("url")).alias("url"),
        F.concat("text", F.lit(" Needs "), F.col("p_size").cast("string"), F.lit("+ years. "), "p_name").alias("jd_text"),
    )


def scored(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    keyed = fingerprint(posting_keys(normalize_posting(postings(spark, sf_dir) if rows is None else rows)))
    return fit_gate(keyword_score(keyed, RULES, AS_OF), PROFILE, OPTIONS)


def minutes_after(base: str, n: Column | str) -> Column:
    start = F.unix_micros(F.lit(base).cast("timestamp"))
    count = F.col(n) if isinstance(n, str) else n
    return F.timestamp_micros(start + count * F.lit(60_000_000))


def queue(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Every posting, or those of ``rows``, as a queue row of its own, in mixed states, the state following its number."""
    c = F.col
    rows = scored(spark, sf_dir, rows).withColumn("years_req", years_requirement("jd_text"))
    state = F.get(F.array(*[F.lit(s) for s in ("inbox", "approved", "skipped", "applied", "filtered", "inbox")]), (c("seq") % 6).cast("int"))
    review = F.when(c("seq") % 6 == 5, "pending").when(c("seq") % 6 == 4, "failed").when(c("seq") % 6 != 3, "none")
    full = rows.withColumns(
        {
            "id": F.concat(F.lit("j"), F.lpad(c("seq").cast("string"), 12, "0")), "status": state,
            "created_at": minutes_after("2001-01-01 00:00:00", "seq"), "updated_at": minutes_after("2001-01-01 00:00:00", "seq"),
            "first_seen_at": minutes_after("2001-01-01 00:00:00", "seq"),
            "last_seen_at": minutes_after("2001-07-01 00:00:00", c("seq") * 40), "last_run_id": c("seq") % 9,
            "fit_reason_codes": c("reason_codes"), "rejected_by_quality": ~c("admitted"), "llm_review_state": review,
            "is_bigtech": c("seq") % 4 == 0,
            "llm_pending_batch_id": F.when(c("seq") % 6 == 5, F.concat(F.lit("b"), (c("seq") % 7).cast("string"))),
        }
    )
    return evolve_schema(full, TABLES["job_queue"])


def payloads(rows: DataFrame, source: str, job: Column, wrap: str | None, slug: str = "org") -> DataFrame:
    """Landed JSON bodies of up to ``PAYLOAD_ROWS`` jobs each; ``wrap`` is the body with ``{jobs}`` in it."""
    part = F.floor(F.col("seq") / PAYLOAD_ROWS).cast("bigint")
    grouped = rows.groupBy(part.alias("batch_seq")).agg(F.array_sort(F.collect_list(F.struct("seq", job.alias("job")))).alias("_l"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: F.to_json(x["job"])), ","), F.lit("]"))
    before, after = (wrap or "{jobs}").split("{jobs}")
    name = F.concat(F.lit(f"{slug}-"), F.col("batch_seq").cast("string"))
    return grouped.select(
        "batch_seq", F.lit(source).alias("source"), name.alias("slug"), F.lit("careers").alias("site"),
        F.concat(F.lit("https://"), name, F.lit(".wd5.example.com")).alias("origin"),
        F.concat(F.lit(before), listed, F.lit(after)).alias("body"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log rows from the events table: the posting is the user, an error is a failed sync, every seventh
    payload is broken."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("j"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("job_id"),
        F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "error", "sync_failed").otherwise(F.col("event_type")).alias("event_type"),
        F.concat(F.lit("seen "), "event_type").alias("message"),
        F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("payload_json"),
        F.col("ts").alias("created_at"),
    )


def lineage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("j"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("job_id"), F.col("user_id").alias("run_id"),
        F.col("event_type").alias("source"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("source_job_key"),
        F.lit(None).cast("string").alias("raw_post_date"), F.date_format("ts", "yyyy-MM-dd").alias("normalized_post_date"),
        F.col("ts").alias("ingested_at"), F.sha1("props").alias("payload_hash"),
    )
