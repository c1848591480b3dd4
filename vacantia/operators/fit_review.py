"""Review of borderline postings by an outside classifier: cache, budget, request and result files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vacantia import fixed_values as fv
from vacantia.config import GateOptions, Profile
from vacantia.functions.dates import epoch_seconds, instant
from vacantia.functions.keys import fit_cache_key
from vacantia.functions.payloads import json_text, normalize_fit_payload
from vacantia.operators.entities import latest_wins
from vacantia.operators.skew import checked_join, lookup_join
from vacantia.operators.state import event_id, sticky_status
from vacantia.session import cut_lineage

Classifier = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
SMALL_BYTES = 64_000_000
ANSWER_FIELDS = ("fit_label", "fit_score", "confidence", "reason_codes", "missing_must_have")


def join_fit_cache(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``answer`` from the cache by ``cache_key``; null where it is unknown. Only (seq, cache_key) meets the cache; the wide rows
    join back on their unique ``seq``."""
    known = cache.select(
        "cache_key",
        F.struct(
            F.coalesce(F.nullif("fit_label", F.lit("")), F.lit("low")).alias("fit_label"),
            F.coalesce("fit_score", F.lit(0)).alias("fit_score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("reason_codes", "missing_must_have")],
        ).alias("answer"),
    )
    rows = cut_lineage(rows)
    found = lookup_join(rows.select("seq", "cache_key"), known, "cache_key", row_count=rows.count())
    return rows.join(found.drop("cache_key"), "seq")


def llm_budget_cap(misses: DataFrame, day_left: int, run_left: int) -> DataFrame:
    """Add ``allowed`` and ``skip_reason`` to (seq, cache_key, …): the first distinct keys by ``seq`` up to the
    smaller budget may be asked."""
    cap = max(0, min(day_left, run_left))
    reason = "daily_cap_reached" if day_left <= run_left else "run_cap_reached"
    first = misses.groupBy("cache_key").agg(F.min("seq").alias("_seq"))
    chosen = first.orderBy("_seq").limit(cap).select("cache_key", F.lit(True).alias("allowed"))
    marked = checked_join(misses, chosen, "cache_key").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    return marked.withColumn("skip_reason", F.when(~F.col("allowed"), reason))


def rule_answers(rows: DataFrame) -> DataFrame:
    """(cache_key, answer_json) from the gate's score alone, so runs need no model and no network."""
    score = F.col("fit_score")
    label = F.when(score >= fv.MIN_INBOX_SCORE, "high").when(score >= fv.BORDERLINE_MIN, "medium").otherwise("low")
    answer = F.struct(
        label.alias("fit_label"), F.least(F.lit(100), score).cast("int").alias("fit_score"), F.lit(0.5).alias("confidence"),
        F.array(F.lit("rule_based")).alias("reason_codes"), F.array().cast("array<string>").alias("missing_must_have"),
    )
    return rows.select("cache_key", F.to_json(answer).alias("answer_json"))


def classify(misses: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """(cache_key, answer) of one row per allowed key; a classifier of the caller sees Arrow batches of posting rows."""
    wanted = latest_wins(misses.filter("allowed"), "cache_key")
    answered = rule_answers(wanted) if classifier is None else wanted.mapInPandas(classifier, "cache_key string, answer_json string")
    return answered.select("cache_key", normalize_fit_payload("answer_json").alias("answer"))


def review_answers(
    gated: DataFrame, cache: DataFrame, profile: Profile, options: GateOptions, day_used: int, run_used: int,
    classifier: Classifier | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(answers by seq, new cache rows) for the borderline rows of a gated batch: the cache first, then the
    classifier within the budget. In batch mode misses are queued instead of asked."""
    keyed = fit_cache_key(gated.filter("needs_review"), profile)
    looked_up = join_fit_cache(keyed, cache)
    hits = looked_up.filter(F.col("answer").isNotNull())
    misses = looked_up.filter(F.col("answer").isNull()).drop("answer")
    if options.batch_mode:
        waiting = misses.select("seq", F.lit("batch_queued").alias("skip_reason"))
        return _answer_rows(hits.select("seq", "answer"), None, waiting), cache.limit(0)
    if not options.review_enabled:
        waiting = keyed.select("seq", F.lit("disabled_or_missing_key").alias("skip_reason"))
        return _answer_rows(hits.select("seq", "answer").limit(0), None, waiting), cache.limit(0)
    capped = llm_budget_cap(
        misses.select("seq", "cache_key", "title", "company", "location", "jd_text", "fit_score"),
        options.daily_cap - day_used, options.run_cap - run_used,
    )
    fresh = cut_lineage(classify(capped, classifier))
    asked = checked_join(capped.filter("allowed").select("seq", "cache_key"), fresh, "cache_key").select("seq", "answer")
    waiting = capped.filter(~F.col("allowed")).select("seq", "skip_reason")
    new_cache = fresh.select("cache_key", "answer.*")
    return _answer_rows(hits.select("seq", "answer"), asked, waiting), new_cache


def unknown_answers(gated: DataFrame, cache: DataFrame, profile: Profile) -> int:
    """Number of distinct borderline postings that the cache does not know."""
    keys = fit_cache_key(gated.filter("needs_review"), profile).select("cache_key").distinct()
    return keys.join(cache.select("cache_key"), "cache_key", "left_anti").count()


def _answer_rows(hits: DataFrame, asked: DataFrame | None, waiting: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string").alias("skip_reason")
    out = hits.select("seq", "answer", F.lit(True).alias("answer_cached"), none)
    if asked is not None:
        out = out.unionByName(asked.select("seq", "answer", F.lit(False).alias("answer_cached"), none))
    answer_type = out.schema["answer"].dataType
    rest = waiting.select("seq", F.lit(None).cast(answer_type).alias("answer"), F.lit(False).alias("answer_cached"), "skip_reason")
    return out.unionByName(rest)


def upsert_fit_cache(cache: DataFrame, answers: DataFrame, as_of: datetime) -> DataFrame:
    """Insert or replace by cache_key; ``answers`` (seq, cache_key, answer fields), the last ``seq`` wins."""
    newest = latest_wins(answers.filter(F.col("cache_key").isNotNull()), "cache_key")
    fresh = newest.select("cache_key", *ANSWER_FIELDS, instant(as_of).alias("updated_at"))
    return cache.join(fresh.select("cache_key"), "cache_key", "left_anti").unionByName(fresh)


def custom_id(run_id: Column | int, job_id: Column | str, as_of: datetime) -> Column:
    run = F.lit(run_id) if isinstance(run_id, int) else run_id
    stamp = F.struct(F.col("cache_key").alias("cacheKey"), F.lit(epoch_seconds(as_of) * 1000).alias("t"))
    digest = F.substring(F.sha1(F.to_json(stamp)), 1, 10)
    return F.concat(F.lit("run_"), run.cast("string"), F.lit("_job_"), F.col(job_id) if isinstance(job_id, str) else job_id, F.lit("_"), digest)


def fit_request_rows(rows: DataFrame, profile: Profile, model: str) -> DataFrame:
    """(value): one JSON request line per row with ``custom_id``; written as text this is the request file."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    job = F.to_json(
        F.struct(
            text("title").alias("title"), text("company").alias("company"), text("location").alias("location"),
            text("jd_text").alias("description"),
        )
    )
    prompt = F.concat(
        F.lit(f'{{"task":"{fv.REVIEW_TASK}","rules":"{fv.REVIEW_RULES}","profile":{profile.to_json()},"job":'), job,
        F.lit(f',"output_schema":{fv.REVIEW_OUTPUT_SCHEMA}}}'),
    )
    body = F.struct(
        F.lit(model).alias("model"), F.lit(0).alias("temperature"),
        F.struct(F.lit("json_object").alias("type")).alias("response_format"),
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit(fv.REVIEW_SYSTEM_TEXT).alias("content")),
            F.struct(F.lit("user").alias("role"), prompt.alias("content")),
        ).alias("messages"),
    )
    line = F.struct(F.col("custom_id"), F.lit("POST").alias("method"), F.lit(fv.REVIEW_ENDPOINT).alias("url"), body.alias("body"))
    return rows.select(F.to_json(line).alias("value"))


def not_already_queued(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (run_id, job_id, …) without a queued item of the same run and posting."""
    queued = items.filter(F.col("state") == "queued").select("run_id", "job_id").distinct()
    return rows.join(queued, ["run_id", "job_id"], "left_anti")


def submit_batch(
    queue: DataFrame, pending: DataFrame, items: DataFrame, profile: Profile, options: GateOptions, run_id: int,
    as_of: datetime, path: str, batch_id: str, error: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(next queue, new items, batch row, request lines) of a run's queued rows (job_id and posting fields).

    The request lines go to ``path`` as text files. ``error`` is the failure of handing them over: then the
    items fail, no batch row is written and the queue keeps its state.
    """
    spark = queue.sparkSession
    keyed = fit_cache_key(pending, profile).withColumn("run_id", F.lit(run_id).cast("bigint"))
    fresh = cut_lineage(not_already_queued(keyed, items).withColumn("custom_id", custom_id(run_id, "job_id", as_of)))
    lines = fit_request_rows(fresh, profile, options.model)
    lines.write.mode("overwrite").text(path)
    now = instant(as_of)
    new_items = fresh.select(
        "run_id", F.lit(None if error else batch_id).cast("string").alias("batch_id"), "job_id", "cache_key", "custom_id",
        F.lit("failed" if error else "queued").alias("state"), F.lit(error).cast("string").alias("error_text"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    batch = spark.createDataFrame(
        [] if error else [(run_id, batch_id, "validating", options.model, path)],
        "run_id bigint, batch_id string, status string, model string, input_file_id string",
    ).withColumns({"created_at": now, "updated_at": now})
    waiting = new_items.select(F.col("job_id").alias("id"), F.col("custom_id").alias("_custom"))
    hit = F.col("_custom").isNotNull()
    marked = queue.join(waiting, "id", "left").withColumns(
        {
            "llm_review_state": F.when(hit, "pending").otherwise(F.col("llm_review_state")),
            "llm_pending_custom_id": F.when(hit, F.col("_custom")).otherwise(F.col("llm_pending_custom_id")),
            "llm_pending_batch_id": F.when(hit, F.lit(batch_id)).otherwise(F.col("llm_pending_batch_id")),
            "llm_review_error": F.when(hit, "batch_queued").otherwise(F.col("llm_review_error")),
            "llm_review_updated_at": F.when(hit, now).otherwise(F.col("llm_review_updated_at")),
        }
    ).select(*queue.columns)
    return (queue if error else marked), new_items, batch, lines


def attach_batch_id(items: DataFrame, submitted: DataFrame) -> DataFrame:
    """Items get the batch id that (custom_id, new_batch_id) names; others keep theirs."""
    joined = items.join(submitted, "custom_id", "left")
    return joined.withColumn("batch_id", F.coalesce("new_batch_id", "batch_id")).drop("new_batch_id")


def reconcile_results(results: DataFrame, items: DataFrame) -> DataFrame:
    """Result lines (seq, value) matched to their items by custom id. Unknown ids and unparsable lines drop out;
    a content that does not parse fails the item. Adds ``state``, ``error_text``, ``answer`` and the tokens."""
    line = F.try_parse_json("value")
    parsed = results.withColumn("_line", line).filter(F.col("_line").isNotNull())
    content = F.coalesce(F.nullif(json_text("_line", "$.response.body.choices[0].message.content"), F.lit("")), F.lit("{}"))
    fields = parsed.select(
        "seq", json_text("_line", "$.custom_id").alias("custom_id"), content.alias("_content"),
        F.coalesce(F.try_variant_get("_line", "$.response.body.usage.prompt_tokens", "bigint"), F.lit(0)).alias("tokens_prompt"),
        F.coalesce(F.try_variant_get("_line", "$.response.body.usage.completion_tokens", "bigint"), F.lit(0)).alias("tokens_completion"),
    )
    payload = F.try_parse_json("_content")
    good = payload.isNotNull() & ~F.coalesce(F.is_variant_null(payload), F.lit(False))
    matched = fields.join(items.drop("state", "error_text"), "custom_id")
    return matched.withColumns(
        {
            "state": F.when(good, "completed").otherwise("failed"),
            "error_text": F.when(~good, "invalid_batch_response"),
            "answer": F.when(good, normalize_fit_payload("_content")),
            **{t: F.when(good, F.col(t)).otherwise(0) for t in ("tokens_prompt", "tokens_completion")},
        }
    ).drop("_content")


def settle_items(items: DataFrame, matched: DataFrame, as_of: datetime) -> DataFrame:
    """Items with the state and error of their last result."""
    last = F.max(F.struct("seq", "state", "error_text")).alias("_last")
    newest = matched.groupBy("custom_id").agg(last)
    hit = F.col("_last").isNotNull()
    return items.join(newest, "custom_id", "left").withColumns(
        {
            "state": F.when(hit, F.col("_last.state")).otherwise(F.col("state")),
            "error_text": F.when(hit, F.col("_last.error_text")).otherwise(F.col("error_text")),
            "updated_at": F.when(hit, instant(as_of)).otherwise(F.col("updated_at")),
        }
    ).select(*items.columns)


def complete_batches(batches: DataFrame, matched: DataFrame, as_of: datetime) -> DataFrame:
    """Batches that got results are completed."""
    done = matched.groupBy("batch_id").agg(F.lit(True).alias("_done"))
    hit = F.col("_done").isNotNull()
    return batches.join(done, "batch_id", "left").withColumns(
        {
            "status": F.when(hit, "completed").otherwise(F.col("status")),
            "completed_at": F.when(hit, instant(as_of)).otherwise(F.col("completed_at")),
            "updated_at": F.when(hit, instant(as_of)).otherwise(F.col("updated_at")),
        }
    ).select(*batches.columns)


def apply_llm_results(
    queue: DataFrame, results: DataFrame, threshold: int, as_of: datetime
) -> tuple[DataFrame, DataFrame]:
    """(next queue, events) from completed results (seq, custom_id, job_id, run_id, answer); the last of a
    posting by seq, then custom id, wins."""
    done = results.filter(F.col("state") == "completed").select("seq", "custom_id", "job_id", "run_id", "answer")
    last = F.max_by(F.struct("answer", "run_id"), F.struct("seq", "custom_id")).alias("_last")
    newest = done.groupBy(F.col("job_id").alias("id")).agg(last).select(
        "id", F.col("_last.answer").alias("_a"), F.col("_last.run_id").alias("_run")
    )
    newest = cut_lineage(newest)
    size = newest.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    joined = queue.join(F.broadcast(newest) if size <= SMALL_BYTES else newest, "id", "left")  # a counted broadcast leaves the texts where they are
    a, hit, now = F.col("_a"), F.col("_a").isNotNull(), instant(as_of)
    admitted = (a["fit_label"] == "high") | (a["fit_score"] >= threshold)
    new = {
        "fit_score": a["fit_score"], "fit_label": a["fit_label"], "fit_source": F.lit("llm"),
        "fit_reason_codes": a["reason_codes"], "quality_bucket": F.when(admitted, "high").otherwise("filtered"),
        "rejected_by_quality": ~admitted, "llm_confidence": a["confidence"], "llm_missing_must_have": a["missing_must_have"],
        "llm_review_state": F.lit("completed"), "llm_pending_batch_id": F.lit(None).cast("string"),
        "llm_pending_custom_id": F.lit(None).cast("string"), "llm_review_error": F.lit(None).cast("string"),
        "llm_review_updated_at": now, "last_run_id": F.col("_run"), "updated_at": now,
        "status": sticky_status(F.col("status"), F.when(admitted, "inbox").otherwise("filtered")),
    }
    changed = joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in queue.columns])
    return changed, result_events(results, threshold, as_of)


def result_events(results: DataFrame, threshold: int, as_of: datetime) -> DataFrame:
    """One event for each completed result."""
    done = results.filter(F.col("state") == "completed").select("seq", "custom_id", "job_id", "run_id", "answer")
    d = F.col("answer")
    taken = (d["fit_label"] == "high") | (d["fit_score"] >= threshold)
    return done.select(
        event_id(as_of, F.lit("llm_batch_completed"), "custom_id", "seq").alias("id"), "job_id", "run_id", F.lit("llm_batch_completed").alias("event_type"),
        F.format_string("Review result applied: %s, %s", d["fit_label"], d["fit_score"].cast("string")).alias("message"),
        F.to_json(F.struct(d["fit_label"].alias("fitLabel"), d["fit_score"].alias("fitScore"), taken.alias("admitted"))).alias("payload_json"),
        instant(as_of).alias("created_at"),
    )


def fail_batches(
    batches: DataFrame, items: DataFrame, queue: DataFrame, failures: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batches, items, queue) after failures (batch_id, new_status, errors): the batch, its queued items and its
    waiting postings fail. One row per failed batch; most postings wait for none, which a plain join on the batch
    would send to one task."""
    dead = failures.filter(F.col("new_status").isin(*fv.DEAD_BATCH_STATUSES))
    now = instant(as_of)
    hit = F.col("new_status").isNotNull()
    b = batches.join(dead, "batch_id", "left").withColumns(
        {
            "status": F.coalesce("new_status", "status"),
            "error_text": F.when(hit, F.coalesce("errors", "error_text")).otherwise(F.col("error_text")),
            "failed_at": F.when(hit, now).otherwise(F.col("failed_at")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        }
    ).select(*batches.columns)
    stopped = hit & (F.col("state") == "queued")
    i = checked_join(items, dead, "batch_id").withColumns(
        {
            "error_text": F.when(stopped, F.col("new_status")).otherwise(F.col("error_text")),
            "updated_at": F.when(stopped, now).otherwise(F.col("updated_at")),
            "state": F.when(stopped, "failed").otherwise(F.col("state")),
        }
    ).select(*items.columns)
    by_batch = dead.withColumnRenamed("batch_id", "llm_pending_batch_id")
    q = checked_join(queue, by_batch, "llm_pending_batch_id").withColumns(
        {
            "llm_review_state": F.when(hit, "failed").otherwise(F.col("llm_review_state")),
            "llm_review_error": F.when(hit, F.col("new_status")).otherwise(F.col("llm_review_error")),
            "llm_review_updated_at": F.when(hit, now).otherwise(F.col("llm_review_updated_at")),
        }
    ).select(*queue.columns)
    return b, i, q


def batch_outcome(reconciled: DataFrame) -> DataFrame:
    """Per batch: calls, tokens and how many items completed or failed."""
    done = F.col("state") == "completed"
    return reconciled.groupBy("batch_id").agg(
        F.count_if(done).alias("calls"), F.sum("tokens_prompt").alias("tokens_prompt"),
        F.sum("tokens_completion").alias("tokens_completion"), F.count_if(done).alias("completed"),
        F.count_if(~done).alias("failed"),
    )
