"""Source adapters: one landed payload row (``slug``, ``body``) to posting rows.

Every adapter is a projection and an explode: no shuffle, no Python per row. ``row`` is the position
in the payload, so (payload order, row) orders postings without a global counter. A registry maps the
source name to its adapter; ``register_source`` adds another one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.dates import epoch_ms_day, normalize_date, relative_date, relative_date_or_parse
from vacantia.functions.links import resolve_best_link
from vacantia.functions.payloads import json_list, json_text
from vacantia.functions.text import cut_text, join_parts, strip_html_spaced, strip_tags_tight
from vacantia.session import hold_filters
from vacantia.sources.pages import extract_jsonld_postings, jsonld_identifier, jsonld_location

Adapter = Callable[[DataFrame, datetime], DataFrame]


def _rows(payloads: DataFrame, *paths: str, pick: Callable[[Column], Column] | None = None) -> DataFrame:
    """Explode the first path that holds a list; a payload without one gives no row."""
    v = F.col("_body")
    lists = pick(v) if pick else F.coalesce(*[json_list(v, p) for p in paths])
    parsed = payloads.withColumn("_body", F.try_parse_json("body")).drop("body")
    keep = [c for c in parsed.columns if c != "_body"]
    return parsed.select(*keep, F.posexplode(lists).alias("row", "_job"))


def _fields(rows: DataFrame, **paths: str) -> DataFrame:
    """Add ``j_<name>``: the text at each path, null when it is missing, empty, zero or false.

    Text and type are read once per path; the next projection combines them. Keeping the two apart keeps
    the generated code small, since later expressions use a field many times.
    """
    read = {}
    for name, path in paths.items():
        read[f"_x_{name}"] = json_text("_job", path)
        read[f"_k_{name}"] = F.schema_of_variant(F.try_variant_get("_job", path, "variant"))
    truthy = {
        f"j_{name}": F.expr(f"if(_x_{name} = '' or (_k_{name} <> 'STRING' and _x_{name} in ('0', '0.0', 'false')), null, _x_{name})")
        for name in paths
    }
    return rows.withColumns(read).withColumns(truthy).drop(*read)


def _j(*names: str) -> Column:
    """First field that is there."""
    return F.coalesce(*[F.col(f"j_{n}") for n in names])


def _meta(**entries: Column) -> Column:
    pairs: list[Column] = []
    for name, value in entries.items():
        pairs += [F.lit(name), value.cast("string")]
    return F.create_map(*pairs)


def _posting(rows: DataFrame, source: str, *, company: Column, title: Column, location: Column, post_date: Column,
             url: Column, jd_text: Column, meta: Column | None = None, need_title: bool = True) -> DataFrame:
    dropped = ("_job", "source", "slug", "site", "origin")
    carried = [c for c in rows.columns if c not in dropped and not c.startswith("j_")]
    out = rows.select(
        *carried,
        company.alias("company"), title.alias("title"), location.alias("location"), post_date.alias("post_date"),
        F.lit(source).alias("source"), url.alias("url"), jd_text.alias("jd_text"), F.lit(False).alias("is_bigtech"),
        (F.lit(None).cast("map<string,string>") if meta is None else meta).alias("meta"),
    )
    return hold_filters(out.filter(F.col("title").isNotNull()) if need_title else out)


def _spaced(*names: str) -> Column:
    return strip_html_spaced(_j(*names))


def _tight(name: str) -> Column:
    return strip_tags_tight(_j(name))


def _date(*names: str) -> Column:
    return normalize_date(_j(*names))


def normalize_greenhouse(payloads: DataFrame, as_of: datetime) -> DataFrame:
    rows = _fields(_rows(payloads, "$.jobs"), title="$.title", place="$.location.name", updated="$.updated_at", link="$.absolute_url", content="$.content")
    return _posting(
        rows, "greenhouse", company=F.col("slug"), title=_j("title"), location=_j("place"), post_date=cut_text(_j("updated"), 10),
        url=_j("link"), jd_text=_tight("content"), need_title=False,
    )


def normalize_lever(payloads: DataFrame, as_of: datetime) -> DataFrame:
    rows = _fields(
        _rows(payloads, "$"), title="$.text", place="$.categories.location", created="$.createdAt", hosted="$.hostedUrl", apply="$.applyUrl",
        plain="$.descriptionPlain", described="$.description",
    )
    return _posting(
        rows, "lever", company=F.col("slug"), title=_j("title"), location=_j("place"), post_date=epoch_ms_day(_j("created").try_cast("bigint")),
        url=_j("hosted", "apply"), jd_text=F.coalesce(_j("plain"), _tight("described")), need_title=False,
    )


def _ashby_jobs(v: Column) -> Column:
    boards = ("$.data.jobBoard.jobs", "$.data.jobBoardWithTeams.jobs", "$.results[0].data.jobBoard.jobs")
    teams = ("$.data.jobBoardWithTeams.teams", "$.data.jobBoard.teams", "$.results[0].data.jobBoardWithTeams.teams")
    of_teams = F.flatten(
        F.transform(
            F.coalesce(*[json_list(v, p) for p in teams]),
            lambda t: F.coalesce(json_list(t, "$.jobs"), F.array().cast("array<variant>")),
        )
    )
    return F.coalesce(*[json_list(v, p) for p in boards], of_teams)


def normalize_ashby(payloads: DataFrame, as_of: datetime) -> DataFrame:
    rows = _fields(
        _rows(payloads, pick=_ashby_jobs), id="$.id", title="$.title", named="$.locationName", place="$.location", published="$.publishedDate",
        posted="$.postedDate", updated="$.updatedAt", apply="$.applyUrl", link="$.jobUrl", html="$.descriptionHtml", described="$.description",
    )
    return _posting(
        rows, "ashby", company=F.col("slug"), title=_j("title"), location=_j("named", "place"), post_date=_date("published", "posted", "updated"),
        url=_j("apply", "link"), jd_text=_spaced("html", "described"), meta=_meta(ashby_job_id=_j("id")),
    )


def normalize_workday(payloads: DataFrame, as_of: datetime) -> DataFrame:
    """Needs ``site`` and ``origin`` besides ``slug``."""
    rows = _fields(
        _rows(payloads, "$.jobPostings"), title="$.title", places="$.locationsText", place="$.location", posted="$.postedOn",
        bullet="$.bulletFields[0]", published="$.publishedDate", path="$.externalPath", described="$.description", short="$.shortDescription",
    )
    bullets = F.try_variant_get("_job", "$.bulletFields", "array<string>")
    with_r = F.get(F.filter(bullets, lambda b: F.contains(b, F.lit("R"))), F.lit(0))
    rows = rows.withColumns({"j_posted_on": _j("posted", "bullet", "published"), "j_r": with_r})
    return _posting(
        rows, "workday", company=F.col("slug"), title=_j("title"), location=_j("places", "place"),
        post_date=relative_date_or_parse("j_posted_on", as_of), url=F.concat(F.col("origin"), _j("path")), jd_text=_spaced("described", "short"),
        meta=_meta(workday_id=_j("r"), tenant=F.col("slug"), site=F.col("site")),
    )


def normalize_smartrecruiters(payloads: DataFrame, as_of: datetime) -> DataFrame:
    rows = _fields(
        _rows(payloads, "$.content"), id="$.id", uuid="$.uuid", ref="$.ref", title="$.name", city="$.location.city", region="$.location.region",
        country="$.location.country", remote="$.location.remote", released="$.releasedDate", created="$.createdOn", updated="$.updatedDate",
        full="$.jobAd.sections.jobDescription.text", summary="$.jobAd.summary",
    )
    built = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("slug"), F.lit("/"), _j("id", "uuid", "ref"))
    return _posting(
        rows, "smartrecruiters", company=F.col("slug"), title=_j("title"), location=join_parts("j_city", "j_region", "j_country", fallback="j_remote"),
        post_date=_date("released", "created", "updated"), url=F.when(_j("ref").rlike("(?i)^https?://"), _j("ref")).otherwise(built),
        jd_text=_spaced("full", "summary"), meta=_meta(smartrecruiters_id=_j("id", "uuid")),
    )


def normalize_workable(payloads: DataFrame, as_of: datetime, widget: bool = False) -> DataFrame:
    """``widget`` reads the older endpoint, which prefers ``jobs`` to ``results``."""
    paths = ("$.jobs", "$.results") if widget else ("$.results", "$.jobs")
    rows = _fields(
        _rows(payloads, *paths), id="$.id", code="$.shortcode", title="$.title", city="$.location.city", region="$.location.region",
        country="$.location.country", place="$.location.location_str", published="$.published", created="$.created_at", updated="$.updated_at",
        link="$.url", described="$.description", requirements="$.requirements",
    )
    built = F.concat(F.lit("https://apply.workable.com/"), F.col("slug"), F.lit("/j/"), _j("code"), F.lit("/"))
    return _posting(
        rows, "workable", company=F.col("slug"), title=_j("title"), location=join_parts("j_city", "j_region", "j_country", fallback="j_place"),
        post_date=_date("published", "created", "updated"), url=F.coalesce(_j("link"), built), jd_text=_spaced("described", "requirements"),
        meta=_meta(workable_id=_j("id", "code")),
    )


def normalize_recruitee(payloads: DataFrame, as_of: datetime) -> DataFrame:
    rows = _fields(
        _rows(payloads, "$.offers", "$"), id="$.id", title="$.title", city="$.city", place="$.location", country="$.country", created="$.created_at",
        published="$.published_at", updated="$.updated_at", careers="$.careers_url", link="$.url", described="$.description", html="$.description_html",
    )
    built = F.concat(F.lit("https://"), F.col("slug"), F.lit(".recruitee.com/o/"), _j("id"))
    return _posting(
        rows, "recruitee", company=F.col("slug"), title=_j("title"), location=join_parts(_j("city", "place"), "j_country"),
        post_date=_date("created", "published", "updated"), url=F.coalesce(_j("careers", "link"), built), jd_text=_spaced("described", "html"),
        meta=_meta(recruitee_id=_j("id")),
    )


def normalize_bamboohr(payloads: DataFrame, as_of: datetime) -> DataFrame:
    rows = _fields(
        _rows(payloads, "$.jobs", "$.openings", "$.result", "$"), id="$.id", opening="$.jobOpeningId", name="$.jobOpeningName", title="$.title",
        place="$.location", department="$.departmentLabel", date="$.date", published="$.datePublished", created="$.created", posted="$.postedDate",
        opening_link="$.jobOpeningUrl", link="$.url", described="$.description", label="$.descriptionLabel",
    )
    return _posting(
        rows, "bamboohr", company=F.col("slug"), title=_j("name", "title"), location=_j("place", "department"),
        post_date=_date("date", "published", "created", "posted"), url=_j("opening_link", "link"), jd_text=_spaced("described", "label"),
        meta=_meta(bamboohr_id=_j("id", "opening")),
    )


def normalize_jobvite(payloads: DataFrame, as_of: datetime) -> DataFrame:
    rows = _fields(
        _rows(payloads, "$.jobs", "$.requisitions", "$"), id="$.id", job="$.jobId", title="$.title", name="$.jobTitle", place="$.location",
        job_place="$.jobLocation", date="$.postDate", posted="$.postedDate", created="$.createdDate", apply="$.applyUrl", link="$.url",
        described="$.description", text="$.jobDescription",
    )
    return _posting(
        rows, "jobvite", company=F.col("slug"), title=_j("title", "name"), location=_j("place", "job_place"), post_date=_date("date", "posted", "created"),
        url=_j("apply", "link"), jd_text=_spaced("described", "text"), meta=_meta(jobvite_id=_j("id", "job")),
    )


def normalize_amazon(payloads: DataFrame, as_of: datetime) -> DataFrame:
    """Dates and texts stay as given: neither stripped nor cut."""
    rows = _fields(
        _rows(payloads, "$.jobs"), id="$.id", job="$.job_id", team="$.team", virtual="$.is_virtual", title="$.title", city="$.city", state="$.state",
        country="$.country_code", place="$.location", posted="$.posting_date", updated="$.updated_time", path="$.job_path", link="$.job_url",
        described="$.description", basic="$.basic_qualifications", preferred="$.preferred_qualifications",
    )
    return _posting(
        rows, "amazon", company=F.lit("amazon"), title=_j("title"), location=join_parts("j_city", "j_state", "j_country", fallback="j_place"),
        post_date=_j("posted", "updated"), url=F.coalesce(F.concat(F.lit("https://www.amazon.jobs"), _j("path")), _j("link")),
        jd_text=_j("described", "basic", "preferred"),
        meta=_meta(team=_j("team"), job_id=_j("id", "job"), is_virtual=F.coalesce(_j("virtual"), F.lit("false"))), need_title=False,
    )


def _links(path: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.transform(json_list("_job", path), lambda o: json_text(o, "$.link")), empty)


def normalize_serpapi(payloads: DataFrame, as_of: datetime) -> DataFrame:
    rows = _fields(
        _rows(payloads, "$.jobs_results"), company="$.company_name", title="$.title", place="$.location", posted="$.detected_extensions.posted_at",
        described="$.description", share="$.share_link",
    )
    listed = rows.withColumns({"j_apply": _links("$.apply_options"), "j_related": _links("$.related_links")})
    best = listed.withColumn("j_best", resolve_best_link("j_apply", "j_related", "j_share"))
    return _posting(
        best, "serpapi", company=F.coalesce(_j("company"), F.lit("Unknown")), title=_j("title"), location=_j("place"),
        post_date=relative_date("j_posted", as_of), url=F.col("j_best.url"), jd_text=F.col("j_described"),
        meta=_meta(url_resolution=F.col("j_best.resolution"), url_source=F.col("j_best.source")), need_title=False,
    )


def normalize_page(payloads: DataFrame, source: str) -> DataFrame:
    """Fallback of four sources: postings embedded in an HTML page. Rows keep ``block`` and ``node`` as their order."""
    found = extract_jsonld_postings(payloads, "body").withColumnRenamed("posting", "_job")
    rows = _fields(found, title="$.title", posted="$.datePosted", valid="$.validFrom", link="$.url", described="$.description").withColumns(
        {"j_place": jsonld_location("_job"), "j_id": jsonld_identifier("_job")}
    )
    return _posting(
        rows, source, company=F.col("slug"), title=_j("title"), location=_j("place"), post_date=_date("posted", "valid"), url=_j("link"),
        jd_text=_spaced("described"), meta=_meta(**{f"{source}_id": _j("id")}),
    )


ADAPTERS: dict[str, Adapter] = {
    "greenhouse": normalize_greenhouse,
    "lever": normalize_lever,
    "ashby": normalize_ashby,
    "workday": normalize_workday,
    "smartrecruiters": normalize_smartrecruiters,
    "workable": normalize_workable,
    "recruitee": normalize_recruitee,
    "bamboohr": normalize_bamboohr,
    "jobvite": normalize_jobvite,
    "amazon": normalize_amazon,
    "serpapi": normalize_serpapi,
}


def register_source(name: str, adapter: Adapter) -> None:
    ADAPTERS[name] = adapter


def normalize_all(payloads: DataFrame, as_of: datetime, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Posting frame per source; each reads only its own payload rows."""
    return {n: ADAPTERS[n](payloads.filter(F.col("source") == n), as_of) for n in (names or list(ADAPTERS))}
