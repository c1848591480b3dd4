"""Queries of the landed payloads, the source adapters, search queries and configuration documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.plans import bindings as b
from vacantia.plans.catalog_scoring import joined
from vacantia.plans.ingest import fetch_sources, landed_postings as land, union_sources as unite
from vacantia.plans.sql_text import TB, spaced, ts_text
from vacantia.session import work_dir
from vacantia.sources import adapters as ad, configuration, landing, search
from vacantia.sources.pages import extract_jsonld_postings as jsonld, jsonld_location as place_of

DAY_TIME = "T10:00:00Z"


def landed(spark, sf_dir) -> DataFrame:
    """Pages as landed HTML responses, every tenth a failure."""
    g = b.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    return g.select(
        F.lit("workable").alias("source"), F.concat(F.lit("t"), k.cast("string")).alias("target"), F.col("url").alias("endpoint"),
        (k % 3).cast("int").alias("priority"), (k * 0).cast("bigint").alias("page"),
        F.when(k % 10 == 0, 404).otherwise(200).alias("http_status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"),
        F.timestamp_seconds(k).alias("fetched_at"),
    )


def scan_landed_payloads(spark, sf_dir):
    path = work_dir(spark, "landed")
    landed(spark, sf_dir).write.parquet(path)
    rows = landing.scan_landed_payloads(spark, path)
    return rows.select("source", "target", "endpoint", "priority", "http_status", F.length("body").alias("n_body"),
                       F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))


def valid_json_responses(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    k = F.col("event_id")
    rows = e.select(
        "event_id", F.when(F.col("event_type") == "error", 503).otherwise(200).alias("http_status"),
        F.when(F.col("user_id") % 5 == 0, "text/html").otherwise("Application/JSON; charset=utf-8").alias("content_type"),
        F.when(k % 7 == 0, F.substring("props", 1, 3)).when(k % 31 == 0, " null ").otherwise(F.col("props")).alias("body"),
    )
    return landing.valid_json_responses(rows).select("event_id", F.get_json_object("body", "$.k").cast("int").alias("k"))


SOURCES = ("greenhouse", "lever", "ashby", "workday", "smartrecruiters", "workable", "recruitee", "bamboohr", "jobvite")


def _targets(spark, sf_dir) -> DataFrame:
    """A board address per customer: the source, a link or bare name, and a foreign link for every fifth."""
    c = b.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    slug = F.concat(F.lit("Org-"), k.cast("string"))
    links = {
        "greenhouse": F.concat(F.lit("https://boards.greenhouse.io/"), slug, F.lit("/jobs")),
        "lever": F.concat(F.lit("https://jobs.lever.co/"), slug), "ashby": F.concat(F.lit("https://jobs.ashbyhq.com/"), slug, F.lit("?a=1")),
        "workday": F.concat(F.lit("https://"), slug, F.lit(".wd5.myworkdayjobs.com/en-US/Careers")),
        "smartrecruiters": F.concat(F.lit("https://jobs.smartrecruiters.com/"), slug),
        "workable": F.concat(F.lit("https://apply.workable.com/"), slug, F.lit("/")),
        "recruitee": F.concat(F.lit("https://"), slug, F.lit(".recruitee.com/")),
        "bamboohr": F.concat(F.lit("https://"), slug, F.lit(".bamboohr.com/careers")),
        "jobvite": F.concat(F.lit("https://jobs.jobvite.com/"), slug, F.lit("/jobs")),
    }
    source = F.get(F.array(*[F.lit(s) for s in SOURCES]), (k % 9).cast("int"))
    link = F.get(F.array(*[links[s] for s in SOURCES]), (k % 9).cast("int"))
    target = F.when(k % 5 == 0, F.concat(F.lit("https://other.example.com/"), slug)).when(k % 5 == 1, F.concat(F.lit(" "), slug)).otherwise(link)
    return c.select("c_custkey", source.alias("source"), target.alias("target"))


def resolve_targets(spark, sf_dir):
    return landing.resolve_targets(_targets(spark, sf_dir)).select("c_custkey", "source", "slug", "site", "api_url")


TARGET_SQL = """with c as (select c_custkey as k, 'Org-' || c_custkey as org, c_custkey % 5 as form,
    ['greenhouse','lever','ashby','workday','smartrecruiters','workable','recruitee','bamboohr','jobvite'][(c_custkey % 9) + 1] as source from customer),
  s as (select *, case
    when form = 0 then case source when 'workday' then 'other' when 'recruitee' then org end
    when form = 1 then case when source in ('greenhouse', 'lever', 'workday') then null else org end
    when source in ('workday', 'recruitee', 'bamboohr') then lower(org) else org end as slug from c)
select k as c_custkey, source, slug, case when source = 'workday' then case when form = 0 then org when form > 1 then 'Careers' end end as site,
  case when slug is not null then case source when 'greenhouse' then 'https://boards-api.greenhouse.io/v1/boards/' || slug || '/jobs?content=true'
    when 'lever' then 'https://api.lever.co/v0/postings/' || slug || '?mode=json' when 'ashby' then 'https://jobs.ashbyhq.com/api/non-user-graphql?op=ApiJobBoardWithTeams'
    when 'workday' then case when form = 0 then 'https://other.example.com/wday/cxs/other/' || org || '/jobs' else 'https://' || org || '.wd5.myworkdayjobs.com/wday/cxs/' || slug || '/Careers/jobs' end
    when 'smartrecruiters' then 'https://api.smartrecruiters.com/v1/companies/' || slug || '/postings'
    when 'workable' then 'https://apply.workable.com/api/v3/accounts/' || slug || '/jobs?state=published&limit=100'
    when 'recruitee' then 'https://' || slug || '.recruitee.com/api/offers/' when 'bamboohr' then 'https://' || slug || '.bamboohr.com/careers/list?output=json'
    when 'jobvite' then 'https://jobs.jobvite.com/api/v1/job?company=' || slug end end as api_url from s"""


def first_success_endpoint(spark, sf_dir):
    g = b.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    rows = g.select(
        "page_id", F.lit("bamboohr").alias("source"), F.floor(k / 5).alias("target"), (k % 5).cast("int").alias("priority"),
        F.when(k % 5 >= 3, "html").otherwise("json").alias("kind"), ((k * 7) % 3 != 0).alias("usable"), ((k * 3) % 4).alias("n_postings"),
    )
    return landing.first_success_endpoint(rows).select("page_id", "target", "kind", "priority")


def stitch_pages(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    k = F.col("event_id")
    rows = e.select(
        "event_id", F.floor(k / 8).alias("target"), (k % 8).alias("page"), (F.col("event_type") != "error").alias("usable"),
        F.when(F.col("value") > 40, 3).otherwise(F.when(k % 9 == 0, 0).otherwise(20)).alias("n_rows"),
    )
    return landing.stitch_pages(rows, 20).select("event_id", "target", "page", "n_rows")


def _json(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _out(df: DataFrame, *meta: str) -> DataFrame:
    return df.select("batch_seq", "row", "company", "title", "location", "post_date", "source", "url", "jd_text",
                     *[F.col("meta")[m].alias(m) for m in meta])


def _sql(source: str, *, company: str = "'org-' || (seq // 20)", title: str = "title", location: str = "location", post_date: str = "post_date",
         url: str = "url", jd_text: str = "", where: str = "true", **meta: str) -> str:
    extra = "".join(f", {v} as {k}" for k, v in meta.items())
    return f"""with {TB} select seq // 20 as batch_seq, seq % 20 as row, {company} as company, {title} as title, {location} as location, {post_date} as post_date,
      '{source}' as source, {url} as url, {jd_text} as jd_text{extra} from tb where {where}"""


def _tb(spark, sf_dir) -> DataFrame:
    return b.postings(spark, sf_dir)


K = "seq"


def _html() -> Column:
    return F.concat(F.lit("<p>"), F.col("jd_text"), F.lit("</p> <br/>"))


def _stamp() -> Column:
    return F.concat(F.col("post_date"), F.lit(DAY_TIME))


HTML_SQL = "'<p>' || jd_text || '</p> <br/>'"
SPACED = spaced(HTML_SQL)
TIGHT = f"regexp_replace({HTML_SQL}, '<[^>]*>', '', 'g')"


def _when(n: int, value: Column, every: int = 3) -> Column:
    return F.when(F.col(K) % every == n, value)


def normalize_greenhouse(spark, sf_dir):
    job = _json(title=F.col("title"), location=_json(name=F.col("location")), updated_at=_stamp(), absolute_url=F.col("url"), content=_html())
    return _out(ad.normalize_greenhouse(b.payloads(_tb(spark, sf_dir), "greenhouse", job, '{"jobs":{jobs}}'), b.AS_OF))


def normalize_lever(spark, sf_dir):
    ms = F.unix_millis(F.concat(F.col("post_date"), F.lit(" 10:00:00")).cast("timestamp"))
    job = _json(text=F.col("title"), categories=_json(location=F.col("location")), createdAt=F.coalesce(ms, F.lit(0)), hostedUrl=_when(0, F.col("url")),
                applyUrl=F.col("url"), descriptionPlain=_when(1, F.col("jd_text")), description=_html())
    return _out(ad.normalize_lever(b.payloads(_tb(spark, sf_dir), "lever", job, None), b.AS_OF))


def normalize_ashby(spark, sf_dir):
    job = _json(id=F.concat(F.lit("a"), F.col(K).cast("string")), title=_when(0, F.col("title"), 1), locationName=_when(0, F.col("location")), location=F.col("location"),
                publishedDate=_when(1, _stamp()), updatedAt=_stamp(), jobUrl=F.col("url"), descriptionHtml=_html())
    rows = b.payloads(_tb(spark, sf_dir), "ashby", job, '{"data":{"jobBoardWithTeams":{"teams":[{"name":"x"},{"jobs":{jobs}}]}}}')
    return _out(ad.normalize_ashby(rows, b.AS_OF), "ashby_job_id")


def normalize_workday(spark, sf_dir):
    job = _json(title=F.when(F.col(K) % 8 != 0, F.col("title")), locationsText=F.col("location"),
                postedOn=F.when(F.col(K) % 3 == 0, F.concat(F.lit("Posted "), (F.col(K) % 30).cast("string"), F.lit(" Days Ago"))).when(F.col(K) % 3 == 1, F.col("post_date")),
                bulletFields=F.array(F.lit("yesterday"), F.concat(F.lit("R"), F.col(K).cast("string"))), externalPath=F.concat(F.lit("/job/"), F.col(K).cast("string")),
                shortDescription=_html())
    return _out(ad.normalize_workday(b.payloads(_tb(spark, sf_dir), "workday", job, '{"jobPostings":{jobs}}'), b.AS_OF), "workday_id", "tenant", "site")


def normalize_smartrecruiters(spark, sf_dir):
    job = _json(id=_when(0, F.col(K).cast("string")), uuid=F.concat(F.lit("u"), F.col(K).cast("string")), ref=_when(1, F.lit("https://example.com/ref")), name=F.col("title"),
                location=_json(city=_when(0, F.lit("City")), country=_when(0, F.col("location")), remote=_when(1, F.lit(True)).cast("boolean")), releasedDate=_when(0, _stamp()), createdOn=_stamp(),
                jobAd=_json(sections=_json(jobDescription=_json(text=_when(2, _html()))), summary=F.lit("Short")))
    rows = b.payloads(_tb(spark, sf_dir), "smartrecruiters", job, '{"content":{jobs}}')
    return _out(ad.normalize_smartrecruiters(rows, b.AS_OF), "smartrecruiters_id")


def normalize_workable(spark, sf_dir):
    job = _json(shortcode=F.concat(F.lit("S"), F.col(K).cast("string")), title=F.col("title"), location=_json(city=F.lit(""), country=_when(0, F.col("location")), location_str=F.lit("Anywhere")),
                created_at=_stamp(), url=_when(0, F.col("url")), requirements=_html())
    return _out(ad.normalize_workable(b.payloads(_tb(spark, sf_dir), "workable", job, '{"results":{"x":1},"jobs":{jobs}}'), b.AS_OF), "workable_id")


def normalize_recruitee(spark, sf_dir):
    job = _json(id=F.col(K), title=F.col("title"), city=_when(0, F.lit("Town")), location=F.col("location"), country=_when(1, F.lit("CA")), published_at=_stamp(),
                careers_url=_when(0, F.col("url")), description_html=_html())
    return _out(ad.normalize_recruitee(b.payloads(_tb(spark, sf_dir), "recruitee", job, None), b.AS_OF), "recruitee_id")


def normalize_bamboohr(spark, sf_dir):
    job = _json(jobOpeningId=F.col(K), jobOpeningName=_when(0, F.concat(F.lit("Open "), F.col("title"))), title=F.col("title"), departmentLabel=F.col("location"), date=_stamp(),
                url=F.col("url"), descriptionLabel=_html())
    return _out(ad.normalize_bamboohr(b.payloads(_tb(spark, sf_dir), "bamboohr", job, '{"jobs":null,"result":{jobs}}'), b.AS_OF), "bamboohr_id")


def normalize_jobvite(spark, sf_dir):
    job = _json(jobId=F.concat(F.lit("v"), F.col(K).cast("string")), jobTitle=F.when(F.col(K) % 9 != 0, F.col("title")), jobLocation=F.col("location"), createdDate=_stamp(),
                applyUrl=F.col("url"), jobDescription=_html())
    return _out(ad.normalize_jobvite(b.payloads(_tb(spark, sf_dir), "jobvite", job, '{"requisitions":{jobs}}'), b.AS_OF), "jobvite_id")


def normalize_amazon(spark, sf_dir):
    job = _json(id=F.col(K), team=F.lit("core"), title=F.col("title"), city=_when(0, F.lit("Big City")), country_code=_when(0, F.lit("CAN")), location=F.col("location"),
                posting_date=F.col("post_date"), job_path=_when(0, F.concat(F.lit("/jobs/"), F.col(K).cast("string"))), job_url=F.col("url"), basic_qualifications=_html(),
                is_virtual=F.col(K) % 2 == 0)
    rows = b.payloads(_tb(spark, sf_dir), "amazon", job, '{"jobs":{jobs}}')
    return _out(ad.normalize_amazon(rows, b.AS_OF), "team", "job_id", "is_virtual")


def normalize_serpapi(spark, sf_dir):
    search_link = F.lit("https://www.google.com/search?q=a")
    redirect = F.concat(F.lit("https://www.google.com/url?q="), F.url_encode("url"))
    job = _json(company_name=_when(0, F.col("company")), title=F.col("title"), location=F.col("location"),
                detected_extensions=_json(posted_at=F.concat((F.col(K) % 20).cast("string"), F.lit(" days ago"))),
                apply_options=F.array(_json(link=search_link), _json(link=_when(0, F.col("url")))), related_links=F.array(_json(link=_when(1, redirect))), share_link=search_link,
                description=F.col("jd_text"))
    rows = b.payloads(_tb(spark, sf_dir), "serpapi", job, '{"jobs_results":{jobs}}')
    return _out(ad.normalize_serpapi(rows, b.AS_OF), "url_resolution", "url_source")


def _ld_pages(spark, sf_dir) -> DataFrame:
    """Postings embedded in their pages: plain, in a graph, in an array of graphs, or beside a broken block."""
    node = F.to_json(
        F.struct(
            F.when(F.col(K) % 4 == 1, F.array(F.lit("Thing"), F.lit("JobPosting"))).otherwise(F.array(F.lit("jobposting"))).alias("@type"), F.col("title").alias("title"),
            F.array(_json(address=_json(addressLocality=F.lit(None).cast("string"), addressCountry=F.lit(""))), _json(address=_json(addressLocality=F.col("location"), addressCountry=_when(0, F.lit("CA"))))).alias("jobLocation"),
            F.col("post_date").alias("datePosted"), F.col("url").alias("url"), F.concat(F.lit("<b>"), F.col("title"), F.lit("</b>")).alias("description"),
            _json(value=F.concat(F.lit("i"), F.col(K).cast("string"))).alias("identifier"),
        )
    )
    k = F.col(K) % 4
    other = F.lit('{"@type":"Organization","name":"x"}')
    body = (
        F.when(k == 0, node).when(k == 1, F.concat(F.lit('{"@graph":['), other, F.lit(","), node, F.lit("]}")))
        .when(k == 2, F.concat(F.lit('[{"@graph":['), node, F.lit("]}]"))).otherwise(F.concat(F.lit("["), node, F.lit(","), other, F.lit("]")))
    )
    script = F.concat(F.lit("<SCRIPT id='a' type='application/ld+json'>"), body, F.lit("</SCRIPT><script type=\"application/ld+json\">{broken</script>"))
    g = b.table(spark, sf_dir, "pages").select("page_id", "html")
    rows = _tb(spark, sf_dir).join(g, F.col("page_id") == F.floor(F.col(K) / 4))
    return rows.select(K, F.concat(F.lit("org-"), F.col(K).cast("string")).alias("slug"), F.concat("html", script).alias("body"))


def extract_jsonld_postings(spark, sf_dir):
    found = jsonld(_ld_pages(spark, sf_dir), "body")
    return found.select(K, "block", F.try_variant_get("posting", "$.title", "string").alias("title"), F.try_variant_get("posting", "$.identifier.value", "string").alias("identifier"))


def jsonld_location(spark, sf_dir):
    found = jsonld(_ld_pages(spark, sf_dir), "body")
    return found.select(K, place_of("posting").alias("location"))


def normalize_page(spark, sf_dir):
    rows = ad.normalize_page(_ld_pages(spark, sf_dir), "workable")
    return rows.select(K, "company", "title", "location", "post_date", "source", "url", "jd_text", F.col("meta")["workable_id"].alias("workable_id"))


def landed_postings(spark, sf_dir):
    """Responses of a target by its number: a good list; an empty list after a failure; a page after a failure."""
    tb = _tb(spark, sf_dir)
    job = _json(title=F.col("title"), location=F.col("location"), date=F.col("post_date"), url=F.col("url"))
    lists = b.payloads(tb, "bamboohr", job, '{"jobs":{jobs}}').withColumn("target", F.col("slug"))
    part = F.col("batch_seq") % 3
    node = F.to_json(_json(**{"@type": F.lit("JobPosting")}, title=F.col("title"), datePosted=F.col("post_date"), url=F.col("url")))
    script = F.concat(F.lit('<script type="application/ld+json">'), node, F.lit("</script>"))
    in_order = F.array_sort(F.collect_list(F.struct(K, script.alias("script"))))  # a body that is read again must be the same body
    scripts = tb.groupBy(F.floor(F.col(K) / 20).alias("batch_seq")).agg(F.array_join(F.transform(in_order, lambda x: x["script"]), "").alias("html"))
    both = lists.join(scripts, "batch_seq")

    def response(priority: int, status: Column, kind: str, body: Column) -> Column:
        return F.struct(F.lit(priority).alias("priority"), status.alias("http_status"), F.lit(kind).alias("content_type"), body.alias("body"))

    ok = F.lit(200)
    responses = F.array(
        response(0, F.when(part == 0, 200).otherwise(503), "application/json", F.col("body")),
        response(1, F.when(part == 1, 200).otherwise(404), "application/json", F.lit('{"jobs":[]}')),
        response(2, ok, "text/html", F.lit("<p>no postings here</p>")), response(3, ok, "text/html", F.col("html")),
    )
    landed_rows = both.select("batch_seq", "source", "slug", "target", F.inline(responses))
    return land(landed_rows, "bamboohr", b.AS_OF).select("target", "kind", "priority", "company", "title", "location", "post_date", "url")


def registered_source(spark, sf_dir):
    """An adapter added under a new name is used like the built-in ones."""
    ad.register_source("board", lambda payloads, as_of: ad.normalize_bamboohr(payloads, as_of).withColumn("source", F.lit("board")))
    job = _json(title=F.col("title"), location=F.col("location"), date=F.col("post_date"), url=F.col("url"))
    rows = b.payloads(_tb(spark, sf_dir), "board", job, '{"jobs":{jobs}}')
    return ad.normalize_all(rows, b.AS_OF, ["board"])["board"].select("batch_seq", "row", "company", "title", "location", "post_date", "source", "url")


def transform_hook(spark, sf_dir):
    """Two sources fetched, one of them by freshness, and a caller's transform over the union. Each response also landed as an older
    copy, as a failure and as a less preferred one; only the chosen one counts."""
    tb = _tb(spark, sf_dir)
    jobvite = b.payloads(tb, "jobvite", _json(title=F.col("title"), location=F.col("location"), postDate=_stamp(), url=F.col("url")), '{"jobs":{jobs}}')
    lever = b.payloads(tb, "lever", _json(text=F.col("title"), categories=_json(location=F.col("location")), hostedUrl=F.col("url")), None)
    def response(priority: int, status: int, day: str, body: Column) -> Column:
        return F.struct(
            F.lit(priority).alias("priority"), F.lit(status).alias("http_status"), F.lit("application/json").alias("content_type"),
            F.lit(day).cast("timestamp").alias("fetched_at"), body.alias("body"),
        )

    older = F.when(F.col("source") == "lever", F.lit("[]")).otherwise(F.lit('{"jobs":[]}'))
    responses = F.array(
        response(0, 200, "2001-08-02", F.col("body")), response(0, 200, "2001-08-01", older), response(0, 503, "2001-08-02", F.col("body")),
        response(1, 200, "2001-08-02", F.col("body")),
    )
    chosen = jobvite.unionByName(lever).withColumn("target", F.col("slug"))
    both = chosen.select(*[c for c in chosen.columns if c != "body"], F.inline(responses))
    out = fetch_sources(both, ["lever", "jobvite"], b.AS_OF, b.FRESH_HOURS, False, lambda df: df.filter(F.col("url").isNotNull()))
    return out.select("source_rank", "batch_seq", "row", "source", "title", "url")


def union_sources(spark, sf_dir):
    tb = _tb(spark, sf_dir)
    united = unite([tb.filter(F.col("source") == lang) for lang in ("en", "fr", "de", "es")])
    return united.select("seq", "source", "source_rank", "title")


LOCATIONS = ("toronto", "remote canada", "")


def _base_queries(spark, sf_dir) -> DataFrame:
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat_ws(" ", "p_name", "p_type").alias("query"))


def generate_search_queries(spark, sf_dir):
    return search.generate_search_queries(_base_queries(spark, sf_dir), LOCATIONS, ("new grad", "junior"), ("remote", "full time"), ("senior", "8+ years"))


def query_location_grid(spark, sf_dir):
    return search.query_location_grid(_base_queries(spark, sf_dir), LOCATIONS)


def distinct_queries(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    explicit = p.select(F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("query"))
    generated = p.select(F.col("p_partkey").alias("seq"), F.concat_ws(" ", "p_name", "p_type").alias("query"))
    return search.distinct_queries(explicit, generated)


def target_aliases(spark, sf_dir):
    s = b.table(spark, sf_dir, "supplier")
    slug = F.when(F.col("s_suppkey") % 3 == 0, F.replace("s_name", F.lit("#"), F.lit("-"))).otherwise(F.col("s_name"))
    return s.select("s_suppkey", F.explode(search.target_aliases(slug)).alias("alias"))


def take_budgeted_queries(spark, sf_dir):
    return search.take_budgeted_queries(generate_search_queries(spark, sf_dir), 50, "seq", "loc_seq")


def _rule_documents(spark, sf_dir) -> DataFrame:
    """One rules document per supplier, its keywords named after the supplier."""
    s = b.table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    body = F.concat(
        F.lit('{"tiers":{"A":{"keywords":{"zeta'), k, F.lit('":20,"alpha'), k, F.lit('":'), n, F.lit('}},"B":{"keywords":{"beta":6}}},"negative":{"qa '), n,
        F.lit('":10},"freshness":{"hours24":20,"days7":10},"titleBoost":2}'),
    )
    return s.select("s_suppkey", body.alias("body"))


def load_keyword_rules(spark, sf_dir):
    return configuration.keyword_rows(_rule_documents(spark, sf_dir))


def load_profile(spark, sf_dir):
    s = b.table(spark, sf_dir, "supplier")
    roles = F.when(F.col("s_suppkey") % 3 == 0, "[]").otherwise(F.concat(F.lit('[" '), F.upper("s_name"), F.lit('","  ","New Grad"]')))
    body = F.concat(F.lit('{"target_roles":'), roles, F.lit(',"must_have_skills":["SQL"],"remote_policy":"Onsite"}'))
    broken = F.when(F.col("s_suppkey") % 11 == 0, "{broken").otherwise(body)
    rows = configuration.profile_rows(s.select("s_suppkey", broken.alias("body")))
    return rows.select("s_suppkey", *[joined(c) for c in configuration.PROFILE_LISTS], "remote_policy")


GENERATED = """select p_partkey as seq, l.i as loc_seq, concat_ws(' ', p_name || ' ' || p_type, 'new grad junior', nullif(l.loc, ''), 'remote full time', '-senior -8+ years') as query
  from part cross join (values (0, 'toronto'), (1, 'remote canada'), (2, '')) l(i, loc)"""
LD_PLACE = "location || case when seq % 3 = 0 then ', CA' else '' end"

CASES = {
    "scan_landed_payloads": (scan_landed_payloads, f"""select 'workable' as source, 't' || page_id as target, url as endpoint, cast(page_id % 3 as int) as priority,
        case when page_id % 10 = 0 then 404 else 200 end as http_status, length(html) as n_body, {ts_text("timestamp '1970-01-01' + to_seconds(page_id)")} as fetched_at from pages"""),
    "valid_json_responses": (valid_json_responses, """select event_id, cast(props->>'$.k' as int) as k from events
        where event_type <> 'error' and user_id % 5 <> 0 and event_id % 7 <> 0 and event_id % 31 <> 0"""),
    "resolve_targets": (resolve_targets, TARGET_SQL),
    "first_success_endpoint": (first_success_endpoint, """select page_id, page_id // 5 as target, case when page_id % 5 >= 3 then 'html' else 'json' end as kind, page_id % 5 as priority
        from (select *, row_number() over (partition by page_id // 5 order by page_id % 5) as n from pages
          where (page_id * 7) % 3 <> 0 and (page_id % 5 < 3 or (page_id * 3) % 4 > 0)) where n = 1"""),
    "stitch_pages": (stitch_pages, """with r as (select event_id, event_id // 8 as target, event_id % 8 as page, event_type <> 'error' as usable,
          case when value > 40 then 3 when event_id % 9 = 0 then 0 else 20 end as n_rows from events),
        p as (select *, coalesce(bool_and(usable and n_rows >= 20) over (partition by target order by page rows between unbounded preceding and 1 preceding), true) as before_full from r)
        select event_id, target, page, n_rows from p where before_full and usable and n_rows > 0"""),
    "normalize_greenhouse": (normalize_greenhouse, _sql("greenhouse", jd_text=TIGHT)),
    "normalize_lever": (normalize_lever, _sql("lever", jd_text=f"case when seq % 3 = 1 then jd_text else {TIGHT} end")),
    "normalize_ashby": (normalize_ashby, _sql("ashby", jd_text=SPACED, ashby_job_id="'a' || seq")),
    "normalize_workday": (normalize_workday, _sql("workday", url="'https://org-' || (seq // 20) || '.wd5.example.com/job/' || seq", jd_text=SPACED, where="seq % 8 <> 0",
        post_date="case when seq % 3 = 0 then case when seq % 30 > 0 then strftime(timestamp '2001-08-02' - to_days(cast(seq % 30 as int)), '%Y-%m-%d') end when seq % 3 = 1 and post_date is not null then post_date else '2001-08-01' end",
        workday_id="'R' || seq", tenant="'org-' || (seq // 20)", site="'careers'")),
    "normalize_smartrecruiters": (normalize_smartrecruiters, _sql("smartrecruiters", location="case seq % 3 when 0 then 'City, ' || location when 1 then 'true' end",
        url="case seq % 3 when 1 then 'https://example.com/ref' when 0 then 'https://jobs.smartrecruiters.com/org-' || (seq // 20) || '/' || seq else 'https://jobs.smartrecruiters.com/org-' || (seq // 20) || '/u' || seq end",
        jd_text=f"case when seq % 3 = 2 then {SPACED} else 'Short' end", smartrecruiters_id="case when seq % 3 = 0 then cast(seq as varchar) else 'u' || seq end")),
    "normalize_workable": (normalize_workable, _sql("workable", location="case when seq % 3 = 0 then location else 'Anywhere' end",
        url="coalesce(case when seq % 3 = 0 then url end, 'https://apply.workable.com/org-' || (seq // 20) || '/j/S' || seq || '/')", jd_text=SPACED, workable_id="'S' || seq")),
    "normalize_recruitee": (normalize_recruitee, _sql("recruitee", location="case when seq % 3 = 0 then 'Town' else location end || case when seq % 3 = 1 then ', CA' else '' end",
        url="coalesce(case when seq % 3 = 0 then url end, case when seq <> 0 then 'https://org-' || (seq // 20) || '.recruitee.com/o/' || seq end)", jd_text=SPACED,
        recruitee_id="case when seq <> 0 then cast(seq as varchar) end")),
    "normalize_bamboohr": (normalize_bamboohr, _sql("bamboohr", title="case when seq % 3 = 0 then 'Open ' || title else title end", jd_text=SPACED,
        bamboohr_id="case when seq <> 0 then cast(seq as varchar) end")),
    "normalize_jobvite": (normalize_jobvite, _sql("jobvite", jd_text=SPACED, where="seq % 9 <> 0", jobvite_id="'v' || seq")),
    "normalize_amazon": (normalize_amazon, _sql("amazon", company="'amazon'", location="case when seq % 3 = 0 then 'Big City, CAN' else location end",
        url="case when seq % 3 = 0 then 'https://www.amazon.jobs/jobs/' || seq else url end", jd_text=HTML_SQL, team="'core'",
        job_id="case when seq <> 0 then cast(seq as varchar) end", is_virtual="case when seq % 2 = 0 then 'true' else 'false' end")),
    "normalize_serpapi": (normalize_serpapi, _sql("serpapi", company="case when seq % 3 = 0 then company else 'Unknown' end",
        post_date="case when seq % 20 > 0 then strftime(timestamp '2001-08-02' - to_days(cast(seq % 20 as int)), '%Y-%m-%d') end",
        url="case when seq % 3 < 2 then url end", jd_text="jd_text",
        url_resolution="case when url is null or seq % 3 = 2 then 'unavailable' when seq % 3 = 0 then 'direct' else 'decoded_redirect' end",
        url_source="case when url is null or seq % 3 = 2 then 'none' when seq % 3 = 0 then 'apply_options' else 'related_links' end")),
    "extract_jsonld_postings": (extract_jsonld_postings, f"with {TB} select seq, 0 as block, title, 'i' || seq as identifier from tb"),
    "jsonld_location": (jsonld_location, f"with {TB} select seq, {LD_PLACE} as location from tb"),
    "normalize_page": (normalize_page, f"""with {TB} select seq, 'org-' || seq as company, title, {LD_PLACE} as location, post_date, 'workable' as source, url, title as jd_text,
        'i' || seq as workable_id from tb"""),
    "landed_postings": (landed_postings, f"""with {TB} select 'org-' || (seq // 20) as target, case when seq // 20 % 3 = 0 then 'json' else 'html' end as kind,
        case when seq // 20 % 3 = 0 then 0 else 3 end as priority, 'org-' || (seq // 20) as company, title, case when seq // 20 % 3 = 0 then location end as location, post_date, url
        from tb where seq // 20 % 3 <> 1"""),
    "source_registry": (registered_source, f"""with {TB} select seq // 20 as batch_seq, seq % 20 as row, 'org-' || (seq // 20) as company, title, location, post_date, 'board' as source, url from tb"""),
    "transform_hook": (transform_hook, f"""with {TB} select 0 as source_rank, seq // 20 as batch_seq, seq % 20 as row, 'lever' as source, title, url from tb where url is not null
        union all select 1, seq // 20, seq % 20, 'jobvite', title, url from tb where url is not null and post_date >= '1999-08-03'"""),
    "union_sources": (union_sources, f"""with {TB} select seq, source, case source when 'en' then 0 when 'fr' then 1 when 'de' then 2 else 3 end as source_rank, title from tb"""),
    "generate_search_queries": (generate_search_queries, GENERATED),
    "query_location_grid": (query_location_grid, """select p_partkey as seq, p_name || ' ' || p_type as query, l.i as loc_seq, l.loc as location
        from part cross join (values (0, 'toronto'), (1, 'remote canada'), (2, '')) l(i, loc)"""),
    "distinct_queries": (distinct_queries, """with e as (select 0 as list, p_partkey as seq, trim(case when p_partkey % 3 = 0 then '  ' else ' ' || p_name end) as query from part
          union all select 1, p_partkey, p_name || ' ' || p_type from part)
        select query, min({'list': list, 'seq': seq}).list as list, min({'list': list, 'seq': seq}).seq as seq from e where query <> '' group by query"""),
    "target_aliases": (target_aliases, """with s as (select s_suppkey, case when s_suppkey % 3 = 0 then replace(s_name, '#', '-') else s_name end as slug from supplier)
        select distinct s_suppkey, alias from (select s_suppkey, slug as alias from s union all select s_suppkey, replace(slug, '-', '') from s)"""),
    "take_budgeted_queries": (take_budgeted_queries, f"select * from ({GENERATED}) order by seq, loc_seq limit 50"),
    "load_keyword_rules": (load_keyword_rules, """select s_suppkey, 'A' as class, 0 as position, 'zeta' || s_suppkey as keyword, 20 as weight from supplier
        union all select s_suppkey, 'A', 1, 'alpha' || s_suppkey, s_nationkey from supplier union all select s_suppkey, 'B', 0, 'beta', 6 from supplier
        union all select s_suppkey, 'negative', 0, 'qa ' || s_nationkey, 10 from supplier"""),
    "load_profile": (load_profile, """select s_suppkey, case when s_suppkey % 11 = 0 or s_suppkey % 3 = 0 then 'software engineer|backend engineer|full stack engineer|new grad|entry level'
          else lower(s_name) || '|new grad' end as target_roles, case when s_suppkey % 11 = 0 then '' else 'sql' end as must_have_skills, '' as nice_to_have_skills,
        'toronto|ontario|canada|remote' as location_preferences, 'senior|staff|principal|manager|director' as hard_exclusions,
        case when s_suppkey % 11 = 0 then 'hybrid_or_remote' else 'onsite' end as remote_policy from supplier"""),
}
