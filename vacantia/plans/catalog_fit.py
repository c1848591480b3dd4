"""Queries of the outside review: cache, budget, requests and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.config import GateOptions
from vacantia.functions import keys
from vacantia.operators import fit_review as fr, gate
from vacantia.operators.entities import latest_wins
from vacantia.plans import bindings as b
from vacantia.plans.catalog_scoring import joined
from vacantia.plans.catalog_text import CACHE_BODY, json_value as json_text
from vacantia.plans.sql_text import GATED, NORM, QUEUED, TB, event_id, quote, ts_text
from vacantia.session import cut_lineage, work_dir
from vacantia import fixed_values as fv

PROFILE_HASH = f"sha1({quote(b.PROFILE.to_json())})"
CACHE_KEY = f"(sha1({CACHE_BODY}) || ':' || {PROFILE_HASH})"


def ts(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _keyed(spark, sf_dir) -> DataFrame:
    return keys.fit_cache_key(keys.normalize_posting(b.postings(spark, sf_dir)), b.PROFILE)


def _label_answers(spark, sf_dir) -> DataFrame:
    """Answers by document number, from the labels."""
    lab = b.table(spark, sf_dir, "labels")
    score = (F.lit(40) + F.col("quality") * 50 - F.col("toxic") * 10).cast("int")
    return lab.select(
        F.col("doc_id").alias("seq"), F.when(F.col("quality") == 1, "high").otherwise("medium").alias("fit_label"), score.alias("fit_score"),
        F.lit(0.5).alias("confidence"), F.array(F.lit("label")).alias("reason_codes"), F.array(F.lit("blue")).alias("missing_must_have"),
    )


def _cache(spark, sf_dir) -> DataFrame:
    """One row for each key: of labelled postings alike in every field the last one's answer holds, as in ``upsert_fit_cache``."""
    known = _keyed(spark, sf_dir).select("seq", "cache_key").join(_label_answers(spark, sf_dir), "seq")
    newest = latest_wins(cut_lineage(known), "cache_key")
    return newest.drop("seq").withColumn("updated_at", F.lit("2001-01-01 00:00:00").cast("timestamp"))


def join_fit_cache(spark, sf_dir):
    rows = fr.join_fit_cache(_keyed(spark, sf_dir).select("seq", "cache_key"), _cache(spark, sf_dir))
    return rows.select("seq", "answer.fit_label", "answer.fit_score", "answer.confidence")


def not_already_queued(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    k = F.col("event_id")
    rows = e.select("event_id", F.col("user_id").alias("run_id"), F.concat(F.lit("j"), (k % 30).cast("string")).alias("job_id"))
    items = e.select(F.col("user_id").alias("run_id"), F.concat(F.lit("j"), ((k * 7) % 30).cast("string")).alias("job_id"),
                     F.when(F.col("event_type") == "click", "queued").otherwise("completed").alias("state"))
    return fr.not_already_queued(rows, items)


def results_and_items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Result lines and items from the conversations: assistants answer well, users badly, some lines are cut."""
    c = b.table(spark, sf_dir, "conversations")
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    good = F.concat(F.lit('{"fit_label":"high","fit_score":'), (F.length("text") % 100).cast("string"), F.lit("}"))
    content = F.when(F.col("role") == "assistant", good).when(F.col("role") == "user", "{broken")
    body = F.struct(
        F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"),
        F.struct(F.length("text").alias("prompt_tokens"), F.lit(10).alias("completion_tokens")).alias("usage"),
    )
    line = F.to_json(F.struct(ident.alias("custom_id"), F.struct(body.alias("body")).alias("response")))
    lines = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.when(F.col("conv_id") % 13 == 0, F.substring(line, 1, 30)).otherwise(line).alias("value"))
    items = c.filter(F.col("turn") != 2).select(
        ident.alias("custom_id"), F.col("conv_id").alias("batch_id"), F.concat(F.lit("j"), F.lpad(F.col("conv_id").cast("string"), 12, "0")).alias("job_id"),
        (F.col("conv_id") % 5).alias("run_id"), F.lit("queued").alias("state"), F.lit(None).cast("string").alias("error_text"),
    )
    return lines, items


RESULTS = """res as (select conv_id as batch_id, conv_id * 1000 + turn as seq, conv_id || '-' || turn as custom_id, 'j' || lpad(cast(conv_id as varchar), 12, '0') as job_id, conv_id % 5 as run_id,
    role <> 'user' as good, case when role = 'assistant' then 'high' when role <> 'user' then 'low' end as fit_label,
    case when role = 'assistant' then length(text) % 100 when role <> 'user' then 0 end as fit_score, length(text) as n from conversations where conv_id % 13 <> 0 and turn <> 2)"""


def reconcile_results(spark, sf_dir):
    rows = fr.reconcile_results(*results_and_items(spark, sf_dir))
    return rows.select("seq", "custom_id", "batch_id", "state", "error_text", "answer.fit_label", "answer.fit_score", "tokens_prompt", "tokens_completion")


def batch_outcome(spark, sf_dir):
    return fr.batch_outcome(fr.reconcile_results(*results_and_items(spark, sf_dir)))


def attach_batch_id(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    items = e.select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("custom_id"), F.when(F.col("event_id") % 2 == 0, "old").alias("batch_id"))
    submitted = e.filter("event_type = 'view'").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("custom_id"), F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("new_batch_id"))
    return fr.attach_batch_id(items, submitted)


def llm_budget_cap(spark, sf_dir):
    misses = b.postings(spark, sf_dir).select("seq", F.concat_ws("|", "company", "title").alias("cache_key"))
    rows = fr.llm_budget_cap(misses, 120, 100)
    return rows.select("seq", "cache_key", F.col("allowed").cast("int").alias("allowed"), "skip_reason")


def upsert_fit_cache(spark, sf_dir):
    answers = _label_answers(spark, sf_dir).withColumn("cache_key", F.concat(F.lit("k"), (F.col("seq") % 97).cast("string")))
    cache = _label_answers(spark, sf_dir).groupBy(F.concat(F.lit("k"), (F.col("seq") % 193).cast("string")).alias("cache_key")).agg(
        F.lit("low").alias("fit_label"), F.lit(1).alias("fit_score"), F.lit(0.0).alias("confidence"), F.array(F.lit("x")).alias("reason_codes"), F.array(F.lit("x")).alias("missing_must_have"),
        F.lit("2001-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )
    out = fr.upsert_fit_cache(cache, answers, b.AS_OF)
    return out.select("cache_key", "fit_label", "fit_score", joined("reason_codes"), ts("updated_at"))


def apply_llm_results(spark, sf_dir):
    queue, _ = fr.apply_llm_results(b.queue(spark, sf_dir), fr.reconcile_results(*results_and_items(spark, sf_dir)), 65, b.AS_OF)
    return queue.select("id", "status", "fit_score", "fit_label", "fit_source", "quality_bucket", "llm_review_state", "llm_pending_batch_id", "last_run_id", ts("updated_at"))


def apply_llm_events(spark, sf_dir):
    events = fr.result_events(fr.reconcile_results(*results_and_items(spark, sf_dir)), 65, b.AS_OF)
    return events.withColumn("created_at", ts("created_at"))


APPLIED = f"""{QUEUED}, {RESULTS}, last as (select job_id, arg_max(fit_label, seq) as l, arg_max(fit_score, seq) as s, arg_max(run_id, seq) as r from res where good group by job_id),
   j as (select q.*, l, s, r, l is not null as hit, coalesce(l = 'high' or s >= 65, false) as ok from queue q left join last on job_id = id)"""


def _failing(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batches from the nations, items from the events; every third batch failed, every third expired."""
    n = b.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    none = F.lit(None).cast("timestamp")
    batches = n.select(F.concat(F.lit("b"), k.cast("string")).alias("batch_id"), F.lit("in_progress").alias("status"), F.lit(None).cast("string").alias("error_text"), none.alias("failed_at"), none.alias("updated_at"))
    failures = n.select(F.concat(F.lit("b"), k.cast("string")).alias("batch_id"), F.get(F.array(F.lit("failed"), F.lit("expired"), F.lit("completed")), k % 3).alias("new_status"), F.when(k % 2 == 0, "[]").alias("errors"))
    e = b.table(spark, sf_dir, "events")
    items = e.select(
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("custom_id"), F.concat(F.lit("b"), (F.col("user_id") % 25).cast("string")).alias("batch_id"),
        F.when(F.col("event_type") == "click", "completed").otherwise("queued").alias("state"), F.lit(None).cast("string").alias("error_text"), F.col("ts").alias("updated_at"),
    )
    return fr.fail_batches(batches, items, b.queue(spark, sf_dir), failures, b.AS_OF)


def fail_batches(spark, sf_dir):
    return _failing(spark, sf_dir)[0].select("batch_id", "status", "error_text", ts("failed_at"))


def fail_batch_items(spark, sf_dir):
    return _failing(spark, sf_dir)[1].select("custom_id", "batch_id", "state", "error_text")


def fail_batch_postings(spark, sf_dir):
    return _failing(spark, sf_dir)[2].select("id", "llm_pending_batch_id", "llm_review_state", "llm_review_error", ts("llm_review_updated_at"))


def fit_request_rows(spark, sf_dir):
    rows = keys.normalize_posting(b.postings(spark, sf_dir)).withColumn("custom_id", F.concat(F.lit("c"), F.col("seq").cast("string")))
    return fr.fit_request_rows(rows, b.PROFILE, "fit-classifier").select(F.sha1("value").alias("line_hash"), F.length("value").alias("n"))


PROMPT = (
    quote(f'{{"task":"{fv.REVIEW_TASK}","rules":"{fv.REVIEW_RULES}","profile":{b.PROFILE.to_json()},"job":{{"title":') + f" || {json_text('title')} || ',\"company\":' || {json_text('company')}"
    + f" || ',\"location\":' || {json_text('coalesce(location, ' + chr(39) * 2 + ')')} || ',\"description\":' || {json_text('jd_text')} || "
    + quote(f'}},"output_schema":{fv.REVIEW_OUTPUT_SCHEMA}}}')
)
REQUEST_SQL = f"""with {TB}, {NORM}, p as (select seq, {PROMPT} as prompt from norm),
  l as (select '{{"custom_id":"c' || seq || '","method":"POST","url":"/v1/chat/completions","body":{{"model":"fit-classifier","temperature":0,"response_format":{{"type":"json_object"}},"messages":[{{"role":"system","content":"{fv.REVIEW_SYSTEM_TEXT}"}},{{"role":"user","content":'
    || {json_text('prompt')} || '}}]}}}}' as line from p) select sha1(line) as line_hash, length(line) as n from l"""


def submit_batch(spark, sf_dir):
    """Borderline rows queued for a batch; one item in three is already queued."""
    queue = b.queue(spark, sf_dir)
    options = GateOptions(45, 20, 44, review_mode="batch")
    gated = gate.fit_gate(keys.normalize_posting(queue), b.PROFILE, options).filter("needs_review")
    gated = cut_lineage(gated.select("id", "company", "title", "location", "source", "url", "jd_text"))  # read for the requests and for the items
    pending = gated.withColumn("job_id", F.col("id"))
    items = gated.filter(F.substring("id", -1, 1).isin("0", "3", "6", "9")).select(F.lit(3).cast("bigint").alias("run_id"), F.col("id").alias("job_id"), F.lit("queued").alias("state"))
    marked, new_items, batch, lines = fr.submit_batch(queue, pending, items, b.PROFILE, options, 3, b.AS_OF, work_dir(spark, "requests"), "batch-3")
    waiting = marked.filter(F.col("llm_pending_batch_id") == "batch-3").select("id", "llm_review_state", "llm_review_error")
    return new_items.select(F.col("job_id").alias("id"), "batch_id", "state").join(waiting, "id", "left").withColumn("n_lines", F.lit(lines.count())).withColumn("n_batches", F.lit(batch.count()))


def review_answers(spark, sf_dir):
    """Cache hits from the labels, then the stand-in classifier on the first 40 distinct misses."""
    gated = gate.fit_gate(keys.normalize_posting(b.postings(spark, sf_dir)), b.PROFILE, b.OPTIONS)
    options = GateOptions(45, 20, 44, review_enabled=True, daily_cap=120, run_cap=45)
    answers, _ = fr.review_answers(gated, _cache(spark, sf_dir), b.PROFILE, options, 0, 5)
    return answers.select("seq", "answer.fit_label", "answer.fit_score", F.col("answer_cached").cast("int").alias("answer_cached"), "skip_reason")


ANSWERS_SQL = f"""with {GATED}, r as (select g.seq, g.fit_score, {CACHE_KEY} as key, quality, toxic from gated g left join labels on doc_id = g.seq where needs_review),
  m as (select key, min(seq) as first from r where quality is null group by key order by first limit 40)
  select seq, case when quality is not null then case when quality = 1 then 'high' else 'medium' end when m.key is not null then case when fit_score >= 55 then 'high' when fit_score >= 35 then 'medium' else 'low' end end as fit_label,
   case when quality is not null then 40 + 50 * quality - 10 * toxic when m.key is not null then fit_score end as fit_score, cast(quality is not null as int) as answer_cached,
   case when quality is null and m.key is null then 'run_cap_reached' end as skip_reason from r left join m on m.key = r.key"""

CASES = {
    "join_fit_cache": (join_fit_cache, f"""with {TB}, {NORM} select seq, case when quality = 1 then 'high' when quality is not null then 'medium' end as fit_label, 40 + 50 * quality - 10 * toxic as fit_score,
        case when quality is not null then 0.5 end as confidence from norm left join labels on doc_id = seq"""),
    "not_already_queued": (not_already_queued, """select event_id, user_id as run_id, 'j' || (event_id % 30) as job_id from events e where not exists (
        select 1 from events i where i.event_type = 'click' and i.user_id = e.user_id and (i.event_id * 7) % 30 = e.event_id % 30)"""),
    "reconcile_results": (reconcile_results, f"""with {RESULTS} select seq, custom_id, batch_id, case when good then 'completed' else 'failed' end as state,
        case when not good then 'invalid_batch_response' end as error_text, fit_label, fit_score, case when good then n else 0 end as tokens_prompt, case when good then 10 else 0 end as tokens_completion from res"""),
    "batch_outcome": (batch_outcome, f"""with {RESULTS} select batch_id, count(*) filter (good) as calls, cast(coalesce(sum(n) filter (good), 0) as bigint) as tokens_prompt, count(*) filter (good) * 10 as tokens_completion,
        count(*) filter (good) as completed, count(*) filter (not good) as failed from res group by batch_id"""),
    "attach_batch_id": (attach_batch_id, """select 'c' || event_id as custom_id, case when event_type = 'view' then 'b' || user_id when event_id % 2 = 0 then 'old' end as batch_id from events"""),
    "llm_budget_cap": (llm_budget_cap, f"""with {TB}, m as (select seq, company || '|' || title as cache_key from tb), f as (select cache_key, min(seq) as s from m group by 1 order by s limit 100)
        select seq, cache_key, cast(f.s is not null as int) as allowed, case when f.s is null then 'run_cap_reached' end as skip_reason from m left join f using (cache_key)"""),
    "upsert_fit_cache": (upsert_fit_cache, """with a as (select 'k' || (doc_id % 97) as cache_key, doc_id, quality, toxic from labels), n as (select cache_key, arg_max(quality, doc_id) as q, arg_max(toxic, doc_id) as t from a group by 1)
        select cache_key, case when q = 1 then 'high' else 'medium' end as fit_label, 40 + 50 * q - 10 * t as fit_score, 'label' as reason_codes, '2001-08-02 00:00:00' as updated_at from n
        union all select distinct 'k' || (doc_id % 193), 'low', 1, 'x', '2001-01-01 00:00:00' from labels where 'k' || (doc_id % 193) not in (select cache_key from n)"""),
    "apply_llm_results": (apply_llm_results, f"""with {APPLIED} select id, case when not hit or status in ('approved','applied','skipped') then status when ok then 'inbox' else 'filtered' end as status,
        case when hit then s else fit_score end as fit_score, case when hit then l else fit_label end as fit_label, case when hit then 'llm' else fit_source end as fit_source,
        case when not hit then quality_bucket when ok then 'high' else 'filtered' end as quality_bucket, case when hit then 'completed' else llm_review_state end as llm_review_state,
        case when not hit then llm_pending_batch_id end as llm_pending_batch_id, case when hit then r else last_run_id end as last_run_id,
        case when hit then '2001-08-02 00:00:00' else {ts_text('updated_at')} end as updated_at from j"""),
    "apply_llm_events": (apply_llm_events, f"""with {RESULTS} select {event_id("'llm_batch_completed'", 'custom_id', 'seq')} as id, job_id, run_id, 'llm_batch_completed' as event_type, 'Review result applied: ' || fit_label || ', ' || fit_score as message,
        cast(json_object('fitLabel', fit_label, 'fitScore', fit_score, 'admitted', fit_label = 'high' or fit_score >= 65) as varchar) as payload_json, '2001-08-02 00:00:00' as created_at from res where good"""),
    "fail_batches": (fail_batches, """select 'b' || n_nationkey as batch_id, case n_nationkey % 3 when 0 then 'failed' when 1 then 'expired' else 'in_progress' end as status,
        case when n_nationkey % 3 < 2 and n_nationkey % 2 = 0 then '[]' end as error_text, case when n_nationkey % 3 < 2 then '2001-08-02 00:00:00' end as failed_at from nation"""),
    "fail_batch_items": (fail_batch_items, """with i as (select 'c' || event_id as custom_id, user_id % 25 as n, event_type <> 'click' as queued from events)
        select custom_id, 'b' || n as batch_id, case when not queued then 'completed' when n % 3 < 2 then 'failed' else 'queued' end as state,
        case when queued and n % 3 = 0 then 'failed' when queued and n % 3 = 1 then 'expired' end as error_text from i"""),
    "fail_batch_postings": (fail_batch_postings, f"""with {QUEUED}, q as (select *, cast(substr(llm_pending_batch_id, 2) as int) % 3 as m from queue) select id, llm_pending_batch_id,
        case when m < 2 then 'failed' else llm_review_state end as llm_review_state, case m when 0 then 'failed' when 1 then 'expired' end as llm_review_error,
        case when m < 2 then '2001-08-02 00:00:00' end as llm_review_updated_at from q"""),
    "fit_request_rows": (fit_request_rows, REQUEST_SQL),
    "submit_batch": (submit_batch, f"""with {QUEUED}, n as (select q.id from queue q join gated g using (seq) where g.needs_review and seq % 10 % 3 <> 0)
        select id, 'batch-3' as batch_id, 'queued' as state, 'pending' as llm_review_state, 'batch_queued' as llm_review_error, (select count(*) from n) as n_lines, 1 as n_batches from n"""),
    "review_answers": (review_answers, ANSWERS_SQL),
}
