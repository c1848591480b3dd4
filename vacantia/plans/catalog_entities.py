"""Queries of entity resolution and the state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions import keys
from vacantia.operators import entities as en, snapshots, state
from vacantia.operators.runs import finalize_run, run_summary, start_run
from vacantia.plans import bindings as b
from vacantia.plans.catalog_scoring import joined
from vacantia.plans.catalog_text import HASH_BODY
from vacantia.plans.sql_text import BASE, NORM, QUEUED, TB, YEARS, event_id, scored_cte, ts_text
from vacantia.schemas import DEFAULTS, TABLES, evolve_schema as conform, table_schemas
from vacantia.session import work_dir

RUN = 7


def ts(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def keyed_postings(spark, sf_dir) -> DataFrame:
    return keys.fingerprint(keys.posting_keys(keys.normalize_posting(b.postings(spark, sf_dir))))


def old_queue(spark, sf_dir) -> DataFrame:
    """The even half of the postings as an existing queue; the other half is left out before it is scored."""
    return b.queue(spark, sf_dir, b.postings(spark, sf_dir).filter(F.col("seq") % 2 == 0))


def new_batch(spark, sf_dir) -> DataFrame:
    """The odd half as a new batch; with ``old_queue`` it covers every posting."""
    return b.postings(spark, sf_dir).filter(F.col("seq") % 2 == 1)


def evaluated_batch(spark, sf_dir) -> DataFrame:
    return state.evaluate_postings(new_batch(spark, sf_dir), b.RULES, b.PROFILE, b.OPTIONS, b.AS_OF)


def outcome_of_batch(spark, sf_dir) -> DataFrame:
    return state.upsert_outcome(old_queue(spark, sf_dir), evaluated_batch(spark, sf_dir), RUN)


def match_existing(spark, sf_dir):
    batch = keys.fingerprint(keys.posting_keys(keys.normalize_posting(new_batch(spark, sf_dir))))
    return en.match_existing(batch, old_queue(spark, sf_dir))


def latest_wins(spark, sf_dir):
    rows = keyed_postings(spark, sf_dir).withColumn("first_seen", F.col("seq"))
    out = en.latest_wins(rows, "canonical_fingerprint", first_seen="first_seen")
    return out.select("seq", "first_seen", "canonical_fingerprint", "company", "title", "post_date")


def is_first_of_entity(spark, sf_dir):
    rows = en.is_first_of_entity(keyed_postings(spark, sf_dir), "canonical_fingerprint")
    return rows.select("seq", F.col("is_first").cast("int").alias("is_first"))


def dedup_components(spark, sf_dir):
    rows = keyed_postings(spark, sf_dir).withColumn("node_id", F.col("seq").cast("string"))
    return en.resolve_entities(rows, ["seq", "canonical_fingerprint"])


def queue_columns(queue: DataFrame) -> DataFrame:
    return queue.select(
        "id", "company", "title", "location", "post_date", "source", "url", F.length("jd_text").alias("n_text"), "score", "tier", "status",
        joined("hits"), "years_req", "canonical_fingerprint", "dedup_reason", ts("created_at"), ts("updated_at"), ts("first_seen_at"),
        ts("last_seen_at"), "last_run_id", "fit_score", "fit_label", "fit_source", joined("fit_reason_codes"), "quality_bucket",
        F.col("rejected_by_quality").cast("int").alias("rejected_by_quality"), "llm_review_state", "llm_review_error",
    )


def upsert_postings(spark, sf_dir):
    return queue_columns(state.upsert_postings(old_queue(spark, sf_dir), evaluated_batch(spark, sf_dir), RUN, b.AS_OF)[0])


def upsert_outcome(spark, sf_dir):
    outcome = outcome_of_batch(spark, sf_dir)
    return outcome.select("seq", "job_id", "result", "previous_status", F.col("resurfaced").cast("int").alias("resurfaced"), "admission_status")


def append_lineage(spark, sf_dir):
    outcome = outcome_of_batch(spark, sf_dir)
    return state.append_lineage(outcome, RUN, b.AS_OF).withColumn("ingested_at", ts("ingested_at"))


def append_events(spark, sf_dir):
    outcome = outcome_of_batch(spark, sf_dir)
    return state.append_events(outcome, RUN, b.AS_OF).withColumn("created_at", ts("created_at"))


def link3(x: str) -> str:
    return f"concat_ws(chr(31), {x}company, {x}title, coalesce({x}url, ''))"


def post4(x: str) -> str:
    return f"concat_ws(chr(31), {x}company_key, {x}title_key, {x}location_key, {x}post_date_key)"


COMPONENTS = f"""pairs as (select distinct canonical_fingerprint as fp, k from (
    select canonical_fingerprint, 'p' || {post4('')} as k from keyed union all select canonical_fingerprint, 'l' || {link3('')} from keyed)),
  adj as (select distinct x.fp as a, y.fp as b from pairs x join pairs y on x.k = y.k),
  reach(a, b) as (select fp, fp from pairs union select r.a, e.b from reach r join adj e on r.b = e.a),
  comp as (select a as fp, min(sha1('f' || b)) as component from reach group by a)"""

EVALUATED = f"""evaluated as (select g.* replace (case when needs_review then list_append(reason_codes, 'llm_skipped:disabled_or_missing_key') else reason_codes end as reason_codes),
    case when admitted then 'inbox' else 'filtered' end as admission_status, {YEARS} as years_req,
    case when needs_review then 'disabled_or_missing_key' end as skipped_reason from gated g)"""

UPSERT = f"""{QUEUED}, {COMPONENTS}, {EVALUATED},
  old as (select q.*, c.component from queue q join comp c on c.fp = q.canonical_fingerprint where seq % 2 = 0),
  owners as (select component, arg_min(id, (first_seen_at, id)) as owner_id from old group by component),
  batch as (select e.*, c.component, w.owner_id, o.status as owner_status, o.first_seen_at as owner_first, o.created_at as owner_created
    from evaluated e join comp c on c.fp = e.canonical_fingerprint left join owners w using (component) left join old o on o.id = w.owner_id
    where e.seq % 2 = 1),
  placed as (select *, row_number() over (partition by component order by seq) as rn, row_number() over (partition by component order by seq desc) as rd,
    lag(admission_status) over (partition by component order by seq) as lag_status from batch),
  outcome as (select *, coalesce(owner_id, sha1(component || ':{RUN}')) as job_id,
    case when rn > 1 or owner_id is not null then 'deduped' else 'inserted' end as result,
    case when rn = 1 then owner_status when owner_status in ('approved','applied','skipped') then owner_status else lag_status end as previous_status from placed),
  outcomes as (select *, coalesce(result = 'deduped' and previous_status = 'filtered' and admission_status = 'inbox', false) as resurfaced from outcome)"""
UPSERT_ODD = f"with recursive {UPSERT}"

NEXT_QUEUE = f"""next_queue as (
  select id, company, title, location, post_date, source, url, length(jd_text) as n_text, score, tier, status, array_to_string(hits, '|') as hits, years_req,
    canonical_fingerprint, dedup_reason, {ts_text('created_at')} as created_at, {ts_text('updated_at')} as updated_at,
    {ts_text('first_seen_at')} as first_seen_at, {ts_text('last_seen_at')} as last_seen_at, last_run_id, fit_score, fit_label, fit_source,
    array_to_string(fit_reason_codes, '|') as fit_reason_codes, quality_bucket, cast(rejected_by_quality as int) as rejected_by_quality,
    llm_review_state, cast(null as varchar) as llm_review_error from old where id not in (select owner_id from outcomes where owner_id is not null)
  union all
  select job_id, company, title, location, post_date, source, url, length(jd_text), score, tier,
    case when owner_status in ('approved','applied','skipped') then owner_status else admission_status end, array_to_string(hits, '|'), years_req,
    canonical_fingerprint, dedup_reason, coalesce({ts_text('owner_created')}, '2001-08-02 00:00:00'), '2001-08-02 00:00:00',
    coalesce({ts_text('owner_first')}, '2001-08-02 00:00:00'), '2001-08-02 00:00:00', {RUN}, fit_score, fit_label, fit_source,
    array_to_string(reason_codes, '|'), quality_bucket, cast(not admitted as int), 'none', skipped_reason from outcomes where rd = 1)"""

UPSERTED = f"{UPSERT_ODD}, {NEXT_QUEUE} select * from next_queue"

SOURCE_KEY = "source || ':' || coalesce(url, concat_ws('|', company_key, title_key, coalesce(post_date,'')))"


def evolve_schema(spark, sf_dir):
    """Bare postings brought to the full queue schema with defaults."""
    rows = conform(keys.normalize_posting(b.postings(spark, sf_dir)), TABLES["job_queue"], DEFAULTS)
    return rows.select("company", "title", "score", "tier", "status", F.col("is_bigtech").cast("int").alias("is_bigtech"), "fit_score",
                       F.col("rejected_by_quality").cast("int").alias("rejected_by_quality"), "post_date")


def schema_columns(spark, sf_dir):
    """Every column of every state table that is null in all rows of the bare postings, per table."""
    rows = keys.normalize_posting(b.postings(spark, sf_dir))
    parts = []
    for name, schema in table_schemas().items():
        full = conform(rows, schema, DEFAULTS)
        missing = [F.when(F.count(c) == 0, 1).otherwise(0) for c in full.columns]
        total = missing[0]
        for m in missing[1:]:
            total = total + m
        parts.append(full.agg(F.lit(name).alias("name"), F.lit(len(full.columns)).alias("n_columns"), total.alias("n_empty")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SCHEMA_SQL = f"""with {TB}, n as (select count(*) as n from tb) select * from (values ('job_queue', 38, 26), ('ingestion_runs', 7, 6), ('job_sources', 8, 7),
  ('job_events', 7, 7), ('serpapi_usage', 4, 4), ('llm_usage', 5, 5), ('llm_fit_cache', 7, 7), ('llm_batches', 12, 11), ('llm_batch_items', 9, 9)) v(name, n_columns, n_empty)"""


def backfill_keys(spark, sf_dir):
    q = b.queue(spark, sf_dir)
    old = F.substring("id", -1, 1).isin("0", "3", "6", "9")
    blanked = q.withColumns({c: F.when(~old, F.col(c)) for c in ("company_key", "title_key", "location_key", "post_date_key", "first_seen_at", "last_seen_at")})
    filled = state.backfill_keys(blanked)
    return filled.select("id", "company_key", "title_key", "location_key", "post_date_key", ts("first_seen_at"), ts("last_seen_at"))


def _changes(spark, sf_dir) -> DataFrame:
    """Status changes from the events; an error asks for a status that does not exist."""
    e = b.table(spark, sf_dir, "events")
    wanted = {"signup": "inbox", "click": "approved", "view": "skipped", "purchase": "applied"}
    status = F.lit("draft")
    for kind, value in wanted.items():
        status = F.when(F.col("event_type") == kind, value).otherwise(status)
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("j"), F.lpad((F.col("user_id") * 10).cast("string"), 12, "0")).alias("id"), status.alias("status")
    )


CHANGES = """changes as (select event_id as seq, 'j' || lpad(cast(user_id * 10 as varchar), 12, '0') as id,
   case event_type when 'signup' then 'inbox' when 'click' then 'approved' when 'view' then 'skipped' when 'purchase' then 'applied' else 'draft' end as status from events),
  known as (select * from changes where status <> 'draft' and id in (select id from queue)),
  last as (select id, arg_max(status, seq) as next from known group by id)"""


def set_status(spark, sf_dir):
    queue, _ = state.set_status(b.queue(spark, sf_dir), _changes(spark, sf_dir), b.AS_OF)
    return queue.select("id", "status", ts("updated_at"))


def set_status_events(spark, sf_dir):
    _, events = state.set_status(b.queue(spark, sf_dir), _changes(spark, sf_dir), b.AS_OF)
    return events.select("id", "job_id", "event_type", "message", "payload_json")


def sticky_status(spark, sf_dir):
    q = b.queue(spark, sf_dir)
    new = F.when(F.col("score") > 0, "inbox").otherwise("filtered")
    return q.select("id", "status", state.sticky_status(F.col("status"), new).alias("next_status"))


def skip_company(spark, sf_dir):
    queue, _ = state.skip_company(b.queue(spark, sf_dir), "src8", b.AS_OF)
    return queue.select("id", "company", "status", ts("updated_at"))


def skip_company_count(spark, sf_dir):
    return state.skip_company(b.queue(spark, sf_dir), "src8", b.AS_OF)[1]


def check_uniqueness(spark, sf_dir):
    return state.check_uniqueness(b.queue(spark, sf_dir))


def ingest_manual(spark, sf_dir):
    rows = b.postings(spark, sf_dir).withColumn("company", F.when(F.col("seq") % 10 != 0, F.col("company")))
    queue, _ = state.ingest_manual(b.queue(spark, sf_dir), rows, b.RULES, b.AS_OF)
    return queue.select("company", "title", "status", "score", "tier", "company_key", "url", "post_date", "fit_label", ts("created_at"))


def ingest_manual_events(spark, sf_dir):
    _, events = state.ingest_manual(b.queue(spark, sf_dir), b.postings(spark, sf_dir), b.RULES, b.AS_OF)
    return events.select("id", "event_type", "message", "payload_json", ts("created_at"))


def sync_outbox(spark, sf_dir):
    return state.sync_outbox(b.queue(spark, sf_dir).filter("status = 'applied'"), b.AS_OF)


def sync_events(spark, sf_dir):
    box = state.sync_outbox(b.queue(spark, sf_dir).filter("status = 'applied'"), b.AS_OF)
    failed = box.withColumn("error", F.when(F.col("url").isNull(), "no link"))
    return state.sync_events(failed, b.AS_OF).withColumn("created_at", ts("created_at"))


def cleanup_inbox(spark, sf_dir):
    queue, _, _ = state.cleanup_inbox(b.queue(spark, sf_dir), b.PROFILE, b.OPTIONS, RUN, b.AS_OF)
    return queue.select("id", "status", "fit_score", "fit_label", joined("fit_reason_codes"), "quality_bucket", "llm_review_state", "last_run_id", ts("updated_at"))


def cleanup_inbox_events(spark, sf_dir):
    _, events, _ = state.cleanup_inbox(b.queue(spark, sf_dir), b.PROFILE, b.OPTIONS, RUN, b.AS_OF)
    return events.withColumn("created_at", ts("created_at"))


CLEANUP = f"""{QUEUED}, again as (select q.*, g.needs_review, g.admitted, case when g.needs_review then list_append(q.fit_reason_codes, 'llm_skipped:disabled_or_missing_key') else q.fit_reason_codes end as codes
   from queue q join gated g using (seq))"""


def requeue_failed(spark, sf_dir):
    queue = state.requeue_failed(b.queue(spark, sf_dir), b.PROFILE, b.OPTIONS, b.AS_OF)
    return queue.select("id", "llm_review_state", "llm_pending_custom_id", "llm_review_error", ts("llm_review_updated_at"))


def snapshot_roundtrip(spark, sf_dir):
    """A full version, then one that replaces every other bucket with the same rows, read back together."""
    root = work_dir(spark, "snapshots")
    rows = keyed_postings(spark, sf_dir).select("seq", "company", "title", "canonical_fingerprint")
    snapshots.write_snapshot(rows, root, "postings", 1, key="seq", buckets=8)
    half = [0, 2, 4, 6]
    part = snapshots.read_snapshot(spark, root, "postings", half)
    snapshots.write_snapshot(part, root, "postings", 2, key="seq", buckets=8, touched=half, sort_by="company")
    return snapshots.read_snapshot(spark, root, "postings")


def finished_run(spark, sf_dir):
    outcome = outcome_of_batch(spark, sf_dir)
    summary = run_summary(
        RUN, "manual", "core", ["en", "fr"], b.AS_OF, b.AS_OF, new_batch(spark, sf_dir).select("source"), outcome, ["fr: timeout"]
    )
    run = finalize_run(start_run(spark, RUN, "manual", b.AS_OF), summary, b.AS_OF)
    s = F.from_json("summary_json", "totals struct<fetched:bigint,inserted:bigint,deduped:bigint,resurfaced:bigint>, quality struct<filteredOut:bigint>, llm struct<eligible:bigint>, sources map<string,struct<inserted:bigint>>")
    return run.select("id", "status", "error_text", "trigger_type", s.alias("s")).select(
        "id", "status", "error_text", "trigger_type", "s.totals.*", F.col("s.quality.filteredOut").alias("filtered_out"),
        F.col("s.llm.eligible").alias("eligible"), F.coalesce(F.col("s.sources")["fr"]["inserted"], F.lit(0)).alias("fr_inserted"),
    )


CASES = {
    "match_existing": (match_existing, f"""with {QUEUED}, q as (select * from queue where seq % 2 = 0),
        f as (select canonical_fingerprint as k, arg_min(id, (first_seen_at, id)) as id from q group by 1),
        p as (select {post4('')} as k, arg_min(id, (first_seen_at, id)) as id from q group by 1),
        l as (select {link3('')} as k, arg_min(id, (first_seen_at, id)) as id from q group by 1)
        select seq, coalesce(f.id, p.id, l.id) as entity_id, case when f.id is not null then 'fingerprint' when p.id is not null then 'posting' else 'link' end as matched_by
        from keyed left join f on f.k = canonical_fingerprint left join p on p.k = {post4('keyed.')} left join l on l.k = {link3('keyed.')}
        where seq % 2 = 1 and coalesce(f.id, p.id, l.id) is not null"""),
    "latest_wins": (latest_wins, f"""with {BASE}, w as (select canonical_fingerprint, max(seq) as seq, min(seq) as first_seen from keyed group by 1)
        select seq, first_seen, canonical_fingerprint, company, title, post_date from keyed join w using (canonical_fingerprint, seq)"""),
    "is_first_of_entity": (is_first_of_entity, f"with {BASE} select seq, cast(row_number() over (partition by canonical_fingerprint order by seq) = 1 as int) as is_first from keyed"),
    "dedup_components": (dedup_components, f"with recursive {BASE}, {COMPONENTS} select seq, canonical_fingerprint, component from keyed join comp on fp = canonical_fingerprint"),
    "upsert_postings": (upsert_postings, UPSERTED),
    "upsert_outcome": (upsert_outcome, f"{UPSERT_ODD} select seq, job_id, result, previous_status, cast(resurfaced as int) as resurfaced, admission_status from outcomes"),
    "append_lineage": (append_lineage, f"""{UPSERT_ODD} select job_id, {RUN} as run_id, source, {SOURCE_KEY} as source_job_key, post_date as raw_post_date,
        post_date as normalized_post_date, '2001-08-02 00:00:00' as ingested_at, sha1({HASH_BODY}) as payload_hash from outcomes"""),
    "append_events": (append_events, f"""{UPSERT_ODD} select {event_id("case result when 'deduped' then 'deduped' else 'ingested' end", RUN, 'seq')} as id, job_id, {RUN} as run_id,
        case result when 'deduped' then 'deduped' else 'ingested' end as event_type,
        case result when 'deduped' then 'Known posting seen again' else 'New posting' end as message,
        cast(json_object('fingerprint', canonical_fingerprint, 'dedupReason', dedup_reason, 'source', source, 'sourceJobKey', {SOURCE_KEY},
          'qualityBucket', quality_bucket, 'admittedToInbox', admitted, 'llmQueued', false) as varchar) as payload_json, '2001-08-02 00:00:00' as created_at from outcomes
        union all select {event_id("'resurfaced'", RUN, 'seq')}, job_id, {RUN}, 'resurfaced', 'Back in the inbox: a filtered posting was found again',
        cast(json_object('previousStatus', previous_status, 'nextStatus', admission_status, 'qualityBucket', quality_bucket) as varchar), '2001-08-02 00:00:00' from outcomes where resurfaced"""),
    "evolve_schema": (evolve_schema, f"""with {TB}, {NORM} select company, title, 0 as score, 'B' as tier, 'inbox' as status, 0 as is_bigtech, cast(null as int) as fit_score,
        0 as rejected_by_quality, post_date from norm"""),
    "table_schemas": (schema_columns, SCHEMA_SQL),
    "backfill_keys": (backfill_keys, f"""with {QUEUED} select id, company_key, title_key, location_key, post_date_key,
        case when seq % 10 % 3 = 0 then {ts_text('created_at')} else {ts_text('first_seen_at')} end as first_seen_at,
        case when seq % 10 % 3 = 0 then {ts_text('updated_at')} else {ts_text('last_seen_at')} end as last_seen_at from queue"""),
    "set_status": (set_status, f"""with {QUEUED}, {CHANGES} select q.id, coalesce(next, status) as status,
        case when next is null then {ts_text('updated_at')} else '2001-08-02 00:00:00' end as updated_at from queue q left join last l on l.id = q.id"""),
    "set_status_events": (set_status_events, f"""with {QUEUED}, {CHANGES} select {event_id("'status_changed'", 'id', 'seq')} as id, id as job_id, 'status_changed' as event_type,
        'Status is now ' || status as message, cast(json_object('status', status) as varchar) as payload_json from known"""),
    "sticky_status": (sticky_status, f"""with {QUEUED} select id, status, case when status in ('approved','applied','skipped') then status
        when score > 0 then 'inbox' else 'filtered' end as next_status from queue"""),
    "skip_company": (skip_company, f"""with {QUEUED} select id, company, case when company = 'src8' then 'skipped' else status end as status,
        case when company = 'src8' then '2001-08-02 00:00:00' else {ts_text('updated_at')} end as updated_at from queue"""),
    "skip_company_count": (skip_company_count, f"with {QUEUED} select count(*) as updated from queue where company = 'src8'"),
    "check_uniqueness": (check_uniqueness, f"""with {QUEUED} select * from (
        select 'company_title_url' as rule, concat_ws('|', company, title, url) as key, count(*) as n from queue where url is not null group by company, title, url
        union all select 'company_title_location_date', concat_ws('|', company_key, title_key, location_key, post_date_key), count(*) from queue group by company_key, title_key, location_key, post_date_key
        union all select 'fingerprint', canonical_fingerprint, count(*) from queue group by canonical_fingerprint) where n > 1"""),
    "ingest_manual": (ingest_manual, f"""with {QUEUED}, {scored_cte(source="tb", name="manual")} select company, title, status, score, tier, company_key, url, post_date, fit_label, {ts_text('created_at')} as created_at from queue
        union all select company, title, 'inbox', score, tier, null, url, post_date, null, '2001-08-02 00:00:00' from manual where seq % 10 <> 0"""),
    "ingest_manual_events": (ingest_manual_events, f"""with {TB} select {event_id("'ingested'", "'manual'", 'seq')} as id, 'ingested' as event_type, 'Added by hand' as message,
        cast(json_object('source', source) as varchar) as payload_json, '2001-08-02 00:00:00' as created_at from tb"""),
    "sync_outbox": (sync_outbox, f"""with {QUEUED} select company, title as position, 'applied' as status, location, '2001-08-02' as applied_date,
        'Sent by vacantia: tier ' || tier || ', score ' || score || ', source ' || source as notes, url, id as external_id from queue where status = 'applied'"""),
    "sync_events": (sync_events, f"""with {QUEUED} select {event_id("case when url is null then 'sync_failed' else 'synced_pd' end", 'id')} as id, id as job_id, cast(null as bigint) as run_id,
        case when url is null then 'sync_failed' else 'synced_pd' end as event_type,
        case when url is null then 'Delivery to the dashboard failed' else 'Delivered to the dashboard' end as message,
        case when url is null then '{{"error":"no link"}}' end as payload_json, '2001-08-02 00:00:00' as created_at from queue where status = 'applied'"""),
    "cleanup_inbox": (cleanup_inbox, f"""with {CLEANUP} select id, case when status = 'inbox' and not admitted then 'filtered' else status end as status, fit_score, fit_label,
        array_to_string(case when status = 'inbox' then codes else fit_reason_codes end, '|') as fit_reason_codes, quality_bucket, llm_review_state,
        case when status = 'inbox' then {RUN} else last_run_id end as last_run_id,
        case when status = 'inbox' then '2001-08-02 00:00:00' else {ts_text('updated_at')} end as updated_at from again"""),
    "cleanup_inbox_events": (cleanup_inbox_events, f"""with {CLEANUP} select {event_id("case when admitted then 'cleanup_kept' else 'cleanup_filtered' end", RUN, 'id')} as id, id as job_id, {RUN} as run_id, case when admitted then 'cleanup_kept' else 'cleanup_filtered' end as event_type,
        case when admitted then 'Inbox check: stays' else 'Inbox check: filtered' end as message,
        cast(json_object('fitScore', fit_score, 'fitLabel', fit_label, 'fitSource', fit_source, 'qualityBucket', quality_bucket, 'reasonCodes', codes, 'llmUsed', false) as varchar) as payload_json,
        '2001-08-02 00:00:00' as created_at from again where status = 'inbox'"""),
    "requeue_failed": (requeue_failed, f"""with {QUEUED}, c as (select q.id, q.last_run_id from queue q join gated g using (seq) where q.llm_review_state = 'failed' and g.needs_review)
        select q.id, case when c.id is not null then 'pending' else llm_review_state end as llm_review_state,
        case when c.id is not null then 'run_' || q.last_run_id || '_job_' || q.id end as llm_pending_custom_id, cast(null as varchar) as llm_review_error,
        case when c.id is not null then '2001-08-02 00:00:00' end as llm_review_updated_at from queue q left join c on c.id = q.id"""),
    "snapshot_roundtrip": (snapshot_roundtrip, f"with {BASE} select seq, company, title, canonical_fingerprint from keyed"),
    "finalize_run": (finished_run, f"""{UPSERT_ODD} select {RUN} as id, 'partial' as status, 'fr: timeout' as error_text, 'manual' as trigger_type, count(*) as fetched,
        count(*) filter (result = 'inserted') as inserted, count(*) filter (result = 'deduped') as deduped, count(*) filter (resurfaced) as resurfaced,
        count(*) filter (not admitted) as filtered_out, count(*) filter (needs_review) as eligible, count(*) filter (source = 'fr' and result = 'inserted') as fr_inserted from outcomes"""),
}
