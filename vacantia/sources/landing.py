"""Landed raw responses: scan, validity, targets, endpoint choice and page stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from vacantia.functions.links import link_host, path_segment
from vacantia.functions.text import col, trim_blanks

PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("page", T.LongType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)


def scan_landed_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PAYLOAD_SCHEMA).format(fmt).load(path)


def is_ok(status: Column | str = "http_status") -> Column:
    return col(status).between(200, 299)


def valid_json_responses(payloads: DataFrame) -> DataFrame:
    """Successful responses that say they are JSON and do parse to something."""
    return payloads.filter(
        is_ok()
        & F.contains(F.lower("content_type"), F.lit("json"))
        & F.try_parse_json(F.col("body")).isNotNull()
        & ~trim_blanks("body").isin("null", "false", "0", '""')
    )


def classify_payloads(payloads: DataFrame) -> DataFrame:
    """Add ``kind`` (json or html by content type) and ``usable``: successful, and parsing or not empty."""
    is_json = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("json"))
    parses = F.try_parse_json("body").isNotNull() & ~trim_blanks("body").isin("null", "false", "0", '""')
    filled = F.when(is_json, parses).otherwise(F.coalesce("body", F.lit("")) != "")
    return payloads.withColumns(
        {"kind": F.when(is_json, "json").otherwise("html"), "usable": F.coalesce(is_ok() & filled, F.lit(False))}
    )


def _slug_or_site(target: Column, on_site: Column, otherwise: Column | None = None) -> Column:
    slug = F.when(~F.contains(target, F.lit("://")), target)
    return F.coalesce(slug, on_site if otherwise is None else F.coalesce(on_site, otherwise))


def resolve_targets(targets: DataFrame) -> DataFrame:
    """Add ``slug``, ``site`` and ``api_url`` to (source, target); an invalid target gets a null slug."""
    target = trim_blanks("target")
    host = link_host(target)
    first = path_segment(target, 1)
    second = path_segment(target, 2)
    label = F.nullif(F.substring_index(host, ".", 1), F.lit(""))
    locale = F.coalesce(first.rlike("(?i)^[a-z]{2}(?:-[a-z]{2})?$"), F.lit(False))
    workday_site = F.when(locale, second).otherwise(first)
    source = F.col("source")

    greenhouse = F.nullif(F.regexp_extract(F.col("target"), r"boards\.greenhouse\.io/([A-Za-z0-9-]+)", 1), F.lit(""))
    lever = F.when(host.endswith("lever.co"), first)
    ashby = _slug_or_site(target, F.when(host.endswith("ashbyhq.com"), first))
    workday = F.when(workday_site.isNotNull(), label)
    smart = _slug_or_site(target, F.when(host.endswith("smartrecruiters.com"), first))
    workable = _slug_or_site(target, F.when(host.endswith("workable.com"), first))
    recruitee = _slug_or_site(
        target,
        F.when(host == "jobs.recruitee.com", first).when(host.endswith(".recruitee.com"), label).otherwise(first),
    )
    bamboo = _slug_or_site(target, F.when(host.endswith("bamboohr.com"), label))
    jobvite = _slug_or_site(
        target, F.when(host.endswith("jobvite.com"), F.when(label != "jobs", label).otherwise(first))
    )
    slug = (
        F.when(source == "greenhouse", greenhouse).when(source == "lever", lever).when(source == "ashby", ashby)
        .when(source == "workday", workday).when(source == "smartrecruiters", smart)
        .when(source == "workable", workable).when(source == "recruitee", recruitee)
        .when(source == "bamboohr", bamboo).when(source == "jobvite", jobvite)
    )
    slug = F.nullif(slug, F.lit(""))
    origin = F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    resolved = targets.withColumns({"slug": slug, "site": F.when(source == "workday", workday_site)})

    def url(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    s = F.col("slug")
    api = (
        F.when(source == "greenhouse", url("https://boards-api.greenhouse.io/v1/boards/", s, "/jobs?content=true"))
        .when(source == "lever", url("https://api.lever.co/v0/postings/", s, "?mode=json"))
        .when(source == "ashby", url("https://jobs.ashbyhq.com/api/non-user-graphql?op=ApiJobBoardWithTeams"))
        .when(source == "workday", url(origin, "/wday/cxs/", s, "/", F.col("site"), "/jobs"))
        .when(source == "smartrecruiters", url("https://api.smartrecruiters.com/v1/companies/", s, "/postings"))
        .when(source == "workable", url("https://apply.workable.com/api/v3/accounts/", s, "/jobs?state=published&limit=100"))
        .when(source == "recruitee", url("https://", s, ".recruitee.com/api/offers/"))
        .when(source == "bamboohr", url("https://", s, ".bamboohr.com/careers/list?output=json"))
        .when(source == "jobvite", url("https://jobs.jobvite.com/api/v1/job?company=", s))
    )
    return resolved.withColumn("api_url", F.when(s.isNotNull(), api))


def first_success_endpoint(payloads: DataFrame) -> DataFrame:
    """The winning payload of each (source, target): lowest-priority-number usable JSON response,
    even an empty one; an HTML page only when no JSON was usable and it holds postings. Of two fetches
    with the same rank the newest wins, and of equal times the one with the greater body digest.

    Expects ``kind`` (``json`` or ``html``), ``usable`` and ``n_postings``. Only the small rank
    columns are aggregated; the bodies stay where they are and meet the winners in a semi join.
    """
    eligible = payloads.filter(
        F.col("usable") & ((F.col("kind") == "json") | (F.col("n_postings") > 0))
    ).withColumn("_rank", F.when(F.col("kind") == "json", 0).otherwise(1_000_000) + F.col("priority"))
    ages = [F.col(c) for c in ("fetched_at",) if c in payloads.columns]
    ties = [F.sha1("body")] if "body" in payloads.columns else []
    eligible = eligible.withColumn("_key", F.struct((-F.col("_rank")).alias("rank"), *ages, *ties)).drop("_rank")
    winners = eligible.groupBy("source", "target").agg(F.max("_key").alias("_key"))
    return eligible.join(winners, ["source", "target", "_key"], "left_semi").drop("_key")


def stitch_pages(payloads: DataFrame, page_size: int) -> DataFrame:
    """Pages of each target up to the first failed, empty, missing or short one; a short page is kept. There is no limit on their number.

    Expects ``target``, ``page`` (from 0), ``usable`` and ``n_rows``; pages of different sources, and of different fetches where a
    ``fetch_id`` is given, are stitched apart. A page belongs when every page before it was full: the first page that is not full, or that the
    page after it is missing, is a minimum per target, combined before the shuffle and without the bodies.
    """
    group = [c for c in ("source", "target", "fetch_id") if c in payloads.columns]
    asked = payloads.filter(F.col("page") >= 0)
    usable = F.coalesce("usable", F.lit(False))
    full = usable & (F.col("n_rows") >= page_size)
    pages = asked.groupBy(*group, "page").agg(F.max(full).alias("_full"))
    short = pages.groupBy(*group).agg(F.min(F.when(~F.col("_full"), F.col("page"))).alias("_short"))
    order = Window.partitionBy(*group).orderBy("page")
    gaps = pages.withColumn("_at", F.row_number().over(order) - 1).filter(F.col("page") != F.col("_at"))
    missing = gaps.groupBy(*group).agg(F.min("_at").alias("_missing"))
    last = short.join(missing, group, "left").select(*group, F.least("_short", F.col("_missing") - 1).alias("_last"))
    kept = asked.filter(usable & (F.col("n_rows") > 0)).join(last, group)
    return kept.filter(F.col("_last").isNull() | (F.col("page") <= F.col("_last"))).drop("_last")
