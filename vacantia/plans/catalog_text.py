"""Queries of the column expressions: text, dates, links, keys and JSON fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacantia.fixed_values import BLANK_CLASS
from vacantia.functions import dates, keys, links, payloads, text
from vacantia.operators.review import event_payload_view, list_projection
from vacantia.plans import bindings as b
from vacantia.plans.sql_text import BASE, EVENT_ROWS, NORM, QUEUED, TB, YEARS, cut, link_key, quote, spaced, trimmed, ts_text


def _rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with blanks around values, missing companies and blank fields."""
    c = F.col
    return b.postings(spark, sf_dir).withColumns(
        {
            "company": F.when(c("seq") % 7 == 0, None).otherwise(F.concat(F.lit(" \t"), "company", F.lit("\u00a0"))),
            "title": F.concat(F.lit("  "), F.upper("title"), F.lit("\n")),
            "location": F.when(c("seq") % 9 == 0, "   ").otherwise(c("location")),
            "source": F.when(c("seq") % 13 == 0, "").otherwise(F.concat(F.upper("source"), F.lit(" "))),
        }
    )


ROUGH = """rough as (
  select seq, case when seq % 7 = 0 then null else ' ' || chr(9) || company || chr(160) end as company,
    '  ' || upper(title) || chr(10) as title, case when seq % 9 = 0 then '   ' else location end as location, post_date,
    case when seq % 13 = 0 then '' else upper(source) || ' ' end as source, url, jd_text from tb)"""
ROUGH_NORM = f"""rnorm as (
  select seq, {trimmed("coalesce(nullif(company,''),'Unknown')")} as company, {trimmed("title")} as title,
    nullif({trimmed("location")}, '') as location, post_date, lower({trimmed("coalesce(nullif(source,''),'unknown')")}) as source,
    nullif({trimmed("url")}, '') as url, nullif({trimmed("jd_text")}, '') as jd_text from rough)"""


def normalize_posting(spark, sf_dir):
    return keys.normalize_posting(_rough(spark, sf_dir)).drop("meta").withColumn("is_bigtech", F.col("is_bigtech").cast("int"))


def posting_keys(spark, sf_dir):
    return keys.posting_keys(keys.normalize_posting(_rough(spark, sf_dir))).select(
        "seq", "company_key", "title_key", "location_key", "post_date_key"
    )


def strip_html_spaced(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", text.strip_html_spaced("html").alias("plain"))


def strip_tags_tight(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", text.strip_tags_tight("html").alias("plain"))


def cut_text(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", *[text.cut_text("text", n).alias(f"cut_{n}") for n in (400, 2000, 6000, 7000)])


def _date_texts(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "EEE, d MMM yyyy HH:mm:ss 'GMT'", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy"]
    written = F.lit("soon")
    for i, f in enumerate(forms):
        written = F.when(F.col("o_orderkey") % 7 == i, F.date_format(d, f)).otherwise(written)
    return o.select("o_orderkey", "o_orderdate", written.alias("date_text"))


DATE_TEXTS = """date_texts as (select o_orderkey, case o_orderkey % 7 when 0 then strftime(o_orderdate, '%Y-%m-%d')
  when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') when 2 then strftime(o_orderdate, '%a, %-d %b %Y %H:%M:%S GMT')
  when 3 then strftime(o_orderdate, '%B %-d, %Y') when 4 then strftime(o_orderdate, '%b %-d, %Y')
  when 5 then strftime(o_orderdate, '%-m/%-d/%Y') else 'soon' end as date_text, o_orderdate from orders)"""


def normalize_date(spark, sf_dir):
    return _date_texts(spark, sf_dir).select("o_orderkey", "date_text", dates.normalize_date("date_text").alias("day"))


def _ago_texts(spark, sf_dir):
    """Relative texts: a number from the order price, a unit from its key."""
    units = ["hour", "days", "week", "months", "year"]
    o = b.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    n = (F.floor("o_totalprice").cast("bigint") % 40).cast("string")
    unit = F.get(F.array(*[F.lit(u) for u in units]), (k % 5).cast("int"))
    written = (
        F.when(k % 11 == 0, "Posted Today").when(k % 11 == 1, "yesterday").when(k % 11 == 2, F.date_format("o_orderdate", "MMM d, yyyy"))
        .when(k % 11 == 3, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 11 == 4, "soon").otherwise(F.concat(n, F.lit(" "), unit, F.lit(" ago")))
    )
    return o.select("o_orderkey", written.alias("posted"))


AGO_TEXTS = """ago as (select o_orderkey, o_orderdate, cast(floor(o_totalprice) as bigint) % 40 as n,
    ['hour','days','week','months','year'][(o_orderkey % 5) + 1] as unit,
    [3600, 86400, 604800, 2592000, 31536000][(o_orderkey % 5) + 1] as secs, o_orderkey % 11 as k from orders),
  ago_texts as (select *, case k when 0 then 'Posted Today' when 1 then 'yesterday' when 2 then strftime(o_orderdate, '%b %-d, %Y')
    when 3 then strftime(o_orderdate, '%Y-%m-%d') when 4 then 'soon' else n || ' ' || unit || ' ago' end as posted,
   case k when 0 then '2001-08-02' when 1 then '2001-08-01' when 2 then null when 3 then strftime(o_orderdate, '%Y-%m-%d') when 4 then null
    else case when n > 0 then strftime(timestamp '2001-08-02' - to_seconds(n * secs), '%Y-%m-%d') end end as day from ago)"""


def relative_date(spark, sf_dir):
    return _ago_texts(spark, sf_dir).withColumn("day", dates.relative_date("posted", b.AS_OF))


def relative_date_or_parse(spark, sf_dir):
    return _ago_texts(spark, sf_dir).withColumn("day", dates.relative_date_or_parse("posted", b.AS_OF))


def epoch_ms_day(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    ms = F.when(F.col("event_id") % 10 == 0, F.lit(0).cast("bigint")).otherwise(F.unix_millis("ts"))
    return e.select("event_id", dates.epoch_ms_day(ms).alias("day"))


def url_key(spark, sf_dir):
    g = b.table(spark, sf_dir, "pages")
    www = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("://"), F.lit("://WWW."))).otherwise(F.col("url"))
    port = F.when(F.col("page_id") % 5 == 0, F.regexp_replace(www, r"\.(com|org|net)/", r".$1:8080/")).otherwise(www)
    bare = F.when(F.col("page_id") % 17 == 0, F.regexp_replace(port, r"^([a-z]+://[^/]+).*$", "$1/")).otherwise(port)
    return g.select("page_id", bare.alias("link")).withColumn("url_key", links.url_key("link"))


def fingerprint(spark, sf_dir):
    return keys.fingerprint(keys.normalize_posting(b.postings(spark, sf_dir))).select("seq", "canonical_fingerprint", "dedup_reason")


def source_job_key(spark, sf_dir):
    return keys.source_job_key(keys.normalize_posting(b.postings(spark, sf_dir))).select("seq", "source_job_key")


def payload_hash(spark, sf_dir):
    return keys.payload_hash(keys.normalize_posting(b.postings(spark, sf_dir))).select("seq", "payload_hash")


def json_value(x: str) -> str:
    return f"coalesce(to_json({x})::varchar, 'null')"


HASH_BODY = " || ".join(
    [f"'{{\"company\":' || {json_value('company')}"]
    + [f"',\"{f}\":' || {json_value(f)}" for f in ("title", "location", "post_date", "source", "url", "jd_text")]
    + ["',\"is_bigtech\":false,\"meta\":null}'"]
)


def linked_pages(spark, sf_dir):
    """Apply, related and share links of a page: plain, redirect, double-encoded redirect or search-only."""
    g = b.table(spark, sf_dir, "pages")
    k, url = F.col("page_id"), F.col("url")
    redirect = F.concat(F.lit("https://www.google.com/url?sa=D&q="), F.url_encode(url))
    twice = F.concat(F.lit("https://www.google.ca/url?url="), F.url_encode(F.url_encode(url)))
    search = F.concat(F.lit("https://www.google.co.uk/search?q=job"), k.cast("string"))
    empty = F.array().cast("array<string>")
    return g.select(
        "page_id",
        F.when(k % 5 == 0, F.array(search, url)).when(k % 5 == 1, F.array(redirect)).otherwise(empty).alias("apply_links"),
        F.when(k % 5 == 2, F.array(search, F.lit(None).cast("string"), twice)).otherwise(empty).alias("related_links"),
        F.when(k % 5 == 3, redirect).when(k % 5 == 4, search).alias("share_link"),
    )


def resolve_best_link(spark, sf_dir):
    best = links.resolve_best_link("apply_links", "related_links", "share_link")
    return linked_pages(spark, sf_dir).select("page_id", best.alias("b")).select("page_id", "b.url", "b.resolution", "b.source")


BEST_LINK_SQL = """select page_id, case when page_id % 5 <> 4 then url end as url,
  case page_id % 5 when 0 then 'direct' when 4 then 'unavailable' else 'decoded_redirect' end as resolution,
  case page_id % 5 when 0 then 'apply_options' when 1 then 'apply_options' when 2 then 'related_links' when 3 then 'share_link' else 'none' end as source
from pages"""


def join_parts(spark, sf_dir):
    s = b.table(spark, sf_dir, "supplier")
    n = b.table(spark, sf_dir, "nation")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    city = F.when(k % 3 != 0, F.col("s_name"))
    country = F.when(k % 4 == 0, F.lit("")).otherwise(F.col("n_name"))
    place = text.join_parts(city, F.lit(None).cast("string"), country, fallback=F.lit("remote"))
    return rows.select("s_suppkey", place.alias("place"))


def years_requirement(spark, sf_dir):
    return b.postings(spark, sf_dir).select("seq", text.years_requirement("jd_text").alias("years_req"))


def count_substring(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", *[text.count_substring("text", w).alias(f"n_{w}") for w in ("en", "on", "La", "er")])


def count_word(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", *[text.count_word("text", w).alias(f"n_{w}") for w in ("en", "on", "La", "er", "the")])


def min_years_hit(spark, sf_dir):
    return b.postings(spark, sf_dir).select(
        "seq", *[text.min_years_hit("jd_text", k).cast("int").alias(f"at_least_{k}") for k in (5, 8, 10, 37)]
    )


def posted_at_granularity(spark, sf_dir):
    posted = dates.posted_at_granularity("date_text")
    return _date_texts(spark, sf_dir).select("o_orderkey", posted.alias("p")).select(
        "o_orderkey", F.date_format("p.ts", "yyyy-MM-dd HH:mm:ss").alias("posted_at"), "p.granularity"
    )


def _answers(spark, sf_dir):
    """Classifier answers built from the labels; every thirteenth is broken, some values are out of range."""
    lab = b.table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    score = F.lit(40) + F.col("quality") * 50 - F.col("toxic") * 10
    body = F.concat(
        F.lit('{"fit_label":"'), F.when(F.col("quality") == 1, "High").otherwise("Medium"), F.lit('","fit_score":'),
        F.when(k % 4 == 0, F.concat(F.lit('"'), score.cast("string"), F.lit(' pts"'))).when(k % 4 == 1, F.lit("187.9")).otherwise(score.cast("string")),
        F.lit(',"confidence":'), F.when(k % 3 == 0, "1.5").when(k % 3 == 1, "0.25").otherwise('"high"'),
        F.lit(',"reason_codes":["c'), (k % 5).cast("string"), F.lit('",'), F.col("toxic").cast("string"), F.lit('],"missing_must_have":'),
        F.when(k % 2 == 0, '["red"]').otherwise('"red"'), F.lit("}"),
    )
    return lab.select("doc_id", "quality", "toxic", F.when(k % 13 == 0, F.substring(body, 1, 20)).otherwise(body).alias("answer_json"))


FIT_VALUES = """fit as (select doc_id,
  case when doc_id % 13 = 0 then 'low' when quality = 1 then 'high' else 'medium' end as fit_label,
  case when doc_id % 13 = 0 then 0 when doc_id % 4 = 1 then 100 else 40 + 50 * quality - 10 * toxic end as fit_score,
  case when doc_id % 13 = 0 then 0.0 when doc_id % 3 = 0 then 1.0 when doc_id % 3 = 1 then 0.25 else 0.0 end as confidence,
  case when doc_id % 13 = 0 then [] else ['c' || (doc_id % 5), cast(toxic as varchar)] end as reason_codes,
  case when doc_id % 13 = 0 or doc_id % 2 = 1 then [] else ['red'] end as missing_must_have from labels)"""


def normalize_fit_payload(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("doc_id", payloads.normalize_fit_payload("answer_json").alias("a"))
    return rows.select(
        "doc_id", "a.fit_label", "a.fit_score", "a.confidence", F.array_join("a.reason_codes", "|").alias("reason_codes"),
        F.array_join("a.missing_must_have", "|").alias("missing_must_have"),
    )


def fit_cache_key(spark, sf_dir):
    return keys.fit_cache_key(keys.normalize_posting(b.postings(spark, sf_dir)), b.PROFILE).select("seq", "cache_key")


CACHE_BODY = " || ".join(
    [f"'{{\"title\":' || {json_value('title')}", f"',\"location\":' || {json_value(chr(99) + 'oalesce(location,' + chr(39) * 2 + ')')}"]
    + [f"',\"jdText\":' || {json_value('jd_text')}", f"',\"source\":' || {json_value('source')}"]
    + [f"',\"url\":' || {json_value('coalesce(url,' + chr(39) * 2 + ')')} || '}}'"]
)


def parse_json_list_safe(spark, sf_dir):
    lab = b.table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    eight = F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('"x'), (k + i).cast("string"), F.lit('"')) for i in range(8)]), F.lit("]"))
    body = F.when(k % 13 == 0, "[broken").when(k % 5 == 0, '{"a":1}').when(k % 7 == 0, None).otherwise(eight)
    shown = payloads.shown_codes(payloads.parse_json_list_safe("j"))
    return lab.select("doc_id", body.alias("j")).select("doc_id", F.array_join(shown, "|").alias("shown"))


def truthy_coalesce(spark, sf_dir):
    k = F.col("seq")
    blank = F.when(k % 3 == 0, "").otherwise(F.col("url"))
    return b.postings(spark, sf_dir).select(
        "seq", text.truthy_coalesce(blank, "post_date", F.lit("none")).alias("first_text"),
        F.coalesce(text.truthy_number(k % 4), F.lit(-1)).alias("first_number"),
    )


def event_payloads(spark, sf_dir):
    return event_payload_view(b.event_rows(spark, sf_dir)).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).withColumn(
        "k", F.get_json_object("payload_json", "$.k").cast("int")).drop("payload_json")


def _flat(df: DataFrame) -> DataFrame:
    """Lists as joined text, times as text, flags as 0 and 1."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            out[f.name] = F.array_join(f.name, "|")
        elif kind == "timestamp":
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        elif kind == "boolean":
            out[f.name] = F.col(f.name).cast("int")
    return df.withColumns(out)


def list_columns(spark, sf_dir):
    return _flat(list_projection(b.queue(spark, sf_dir)))


def provenance_columns(spark, sf_dir):
    return _flat(list_projection(b.queue(spark, sf_dir), "provenance"))


_LIST_SQL = f"""{{id}}, company, title, source, url, {ts_text("first_seen_at")} as first_seen_at, {ts_text("last_seen_at")} as last_seen_at,
  dedup_reason, canonical_fingerprint, fit_score, fit_label, fit_source, array_to_string(fit_reason_codes, '|') as fit_reason_codes,
  quality_bucket, cast(rejected_by_quality as int) as rejected_by_quality, cast(null as double) as llm_confidence,
  cast(null as varchar) as llm_missing_must_have, llm_review_state, llm_pending_batch_id, cast(null as varchar) as llm_pending_custom_id,
  cast(null as varchar) as llm_review_updated_at, cast(null as varchar) as llm_review_error"""
LIST_SQL = f"with {QUEUED} select " + _LIST_SQL.format(id="id") + """, location, post_date, score, tier, status,
  array_to_string(hits, '|') as hits, years_req, cast(is_bigtech as int) as is_bigtech from queue"""
PROVENANCE_SQL = f"with {QUEUED} select " + _LIST_SQL.format(id="id") + " from queue"

WS = BLANK_CLASS
CASES = {
    "normalize_posting": (normalize_posting, f"with {TB}, {ROUGH}, {ROUGH_NORM} select *, 0 as is_bigtech from rnorm"),
    "posting_keys": (posting_keys, f"""with {TB}, {ROUGH}, {ROUGH_NORM} select seq, lower(company) as company_key, lower(title) as title_key,
        lower(coalesce(location,'')) as location_key, coalesce(post_date,'') as post_date_key from rnorm"""),
    "strip_html_spaced": (strip_html_spaced, f"select page_id, {spaced('html')} as plain from pages"),
    "strip_tags_tight": (strip_tags_tight, "select page_id, regexp_replace(html, '<[^>]*>', '', 'g') as plain from pages"),
    "cut_text": (cut_text, "select doc_id, " + ", ".join(f"{cut('text', n)} as cut_{n}" for n in (400, 2000, 6000, 7000)) + " from documents"),
    "normalize_date": (normalize_date, f"""with {DATE_TEXTS} select o_orderkey, date_text,
        case when o_orderkey % 7 < 6 then strftime(o_orderdate, '%Y-%m-%d') end as day from date_texts"""),
    "relative_date": (relative_date, f"with {AGO_TEXTS} select o_orderkey, posted, day from ago_texts"),
    "relative_date_or_parse": (relative_date_or_parse, f"""with {AGO_TEXTS} select o_orderkey, posted,
        case when k = 2 then strftime(o_orderdate, '%Y-%m-%d') else day end as day from ago_texts"""),
    "epoch_ms_day": (epoch_ms_day, "select event_id, case when event_id % 10 <> 0 then strftime(ts, '%Y-%m-%d') end as day from events"),
    "url_key": (url_key, f"""with a as (select page_id, case when page_id % 3 = 0 then replace(url, '://', '://WWW.') else url end as u from pages),
        p as (select page_id, case when page_id % 5 = 0 then regexp_replace(u, '\\.(com|org|net)/', '.\\1:8080/', 'g') else u end as u from a),
        l as (select page_id, case when page_id % 17 = 0 then regexp_replace(u, '^([a-z]+://[^/]+).*$', '\\1/') else u end as link from p)
        select page_id, link, {link_key('link')} as url_key from l"""),
    "fingerprint": (fingerprint, f"with {BASE} select seq, canonical_fingerprint, dedup_reason from keyed"),
    "source_job_key": (source_job_key, f"""with {BASE} select seq, source || ':' || coalesce(url, concat_ws('|', company_key, title_key, coalesce(post_date,''))) as source_job_key from keyed"""),
    "payload_hash": (payload_hash, f"with {TB}, {NORM} select seq, sha1({HASH_BODY}) as payload_hash from norm"),
    "resolve_best_link": (resolve_best_link, BEST_LINK_SQL),
    "join_parts": (join_parts, """select s_suppkey, coalesce(nullif(concat_ws(', ', case when s_suppkey % 3 <> 0 then s_name end,
        case when s_suppkey % 4 <> 0 then n_name end), ''), 'remote') as place from supplier join nation on s_nationkey = n_nationkey"""),
    "years_requirement": (years_requirement, f"with {TB} select seq, {YEARS} as years_req from tb"),
    "count_substring": (count_substring, "select doc_id, " + ", ".join(f"(length(text) - length(replace(lower(text), '{w.lower()}', ''))) // {len(w)} as \"n_{w}\"" for w in ("en", "on", "La", "er")) + " from documents"),
    "count_word": (count_word, "select doc_id, " + ", ".join(f"len(regexp_extract_all(lower(text), '\\b{w.lower()}\\b')) as \"n_{w}\"" for w in ("en", "on", "La", "er", "the")) + " from documents"),
    "min_years_hit": (min_years_hit, f"with {TB} select seq, " + ", ".join(
        f"cast(len(list_filter(regexp_extract_all(lower(jd_text), '\\b(\\d{{1,2}})\\s*\\+?\\s*(?:years?|yrs?)\\b', 1), lambda x: cast(x as int) >= {k})) > 0 as int) as at_least_{k}" for k in (5, 8, 10, 37)) + " from tb"),
    "posted_at_granularity": (posted_at_granularity, f"""with {DATE_TEXTS} select o_orderkey,
        case o_orderkey % 7 when 6 then null when 1 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') when 2 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
          else strftime(o_orderdate, '%Y-%m-%d 00:00:00') end as posted_at,
        case o_orderkey % 7 when 0 then 'day' when 6 then null else 'exact' end as granularity from date_texts"""),
    "normalize_fit_payload": (normalize_fit_payload, f"""with {FIT_VALUES} select doc_id, fit_label, fit_score, confidence,
        array_to_string(reason_codes, '|') as reason_codes, array_to_string(missing_must_have, '|') as missing_must_have from fit"""),
    "fit_cache_key": (fit_cache_key, f"with {TB}, {NORM} select seq, sha1({CACHE_BODY}) || ':' || sha1({quote(b.PROFILE.to_json())}) as cache_key from norm"),
    "parse_json_list_safe": (parse_json_list_safe, """select doc_id, case when doc_id % 13 = 0 or doc_id % 5 = 0 or doc_id % 7 = 0 then ''
        else array_to_string(['x' || (doc_id + 0), 'x' || (doc_id + 1), 'x' || (doc_id + 2), 'x' || (doc_id + 3), 'x' || (doc_id + 4), 'x' || (doc_id + 5), 'x' || (doc_id + 6), 'x' || (doc_id + 7)], '|') end as shown from labels"""),
    "truthy_coalesce": (truthy_coalesce, f"""with {TB} select seq, coalesce(nullif(case when seq % 3 = 0 then '' else url end, ''), post_date, 'none') as first_text,
        case when seq % 4 = 0 then -1 else seq % 4 end as first_number from tb"""),
    "event_payload_view": (event_payloads, f"""with {EVENT_ROWS} select job_id, id as event_id, event_type, message, run_id, {ts_text('created_at')} as created_at,
        case when id % 7 <> 0 then cast(payload_json->>'$.k' as int) end as k from event_rows"""),
    "list_projection": (list_columns, LIST_SQL),
    "list_projection_provenance": (provenance_columns, PROVENANCE_SQL),
}
