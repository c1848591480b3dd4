"""State tables as dataflow: every change takes a snapshot frame and returns the next one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import fixed_values as fv
from vacantia.config import GateOptions, KeywordRules, Profile
from vacantia.functions.dates import epoch_seconds, instant
from vacantia.functions.keys import fingerprint, normalize_posting, payload_hash, posting_keys, source_job_key, text_key
from vacantia.functions.text import years_requirement
from vacantia.operators.entities import resolve_entities
from vacantia.operators.filters import reject_incomplete
from vacantia.operators.gate import admission_status, final_fit, fit_gate, without_answers
from vacantia.operators.review import requeue_candidates
from vacantia.operators.scoring import keyword_score
from vacantia.operators.skew import checked_join, lookup_join, previous_value
from vacantia.schemas import TABLES, evolve_schema
from vacantia.session import cut_lineage

QUEUE = TABLES["job_queue"]
EVENT = TABLES["job_events"]
SMALL_ROWS = 500_000
ENTITY_COLUMNS = ("canonical_fingerprint", "company_key", "title_key", "location_key", "post_date_key", "company", "title", "url")
DETAIL_COLUMNS = (
    "source", "source_job_key", "post_date", "payload_hash", "canonical_fingerprint", "dedup_reason", "quality_bucket", "admitted",
    "admission_status", "reason_codes", "llm_used", "llm_eligible", "llm_attempted", "llm_skipped_reason", "llm_queued",
)

# Messages of the event log.
MESSAGES = {
    "ingested": "New posting",
    "deduped": "Known posting seen again",
    "resurfaced": "Back in the inbox: a filtered posting was found again",
    "manual": "Added by hand",
    "cleanup_kept": "Inbox check: stays",
    "cleanup_filtered": "Inbox check: filtered",
    "synced_pd": "Delivered to the dashboard",
    "sync_failed": "Delivery to the dashboard failed",
}


def backfill_keys(queue: DataFrame) -> DataFrame:
    """Fill null keys and seen times of rows written before those columns existed."""
    return queue.withColumns(
        {
            "company_key": F.coalesce("company_key", text_key("company")),
            "title_key": F.coalesce("title_key", text_key("title")),
            "location_key": F.coalesce("location_key", text_key("location")),
            "post_date_key": F.coalesce("post_date_key", F.coalesce("post_date", F.lit(""))),
            "first_seen_at": F.coalesce("first_seen_at", "created_at"),
            "last_seen_at": F.coalesce("last_seen_at", "updated_at"),
        }
    )


def sticky_status(old: Column, new: Column) -> Column:
    """A user's decision survives; anything else takes the new status."""
    return F.when(old.isin(*fv.STICKY_STATUSES), old).otherwise(new)


def gate_postings(batch: DataFrame, rules: KeywordRules, profile: Profile, options: GateOptions, as_of: datetime) -> DataFrame:
    """Normalize, score and gate a batch (``seq`` plus posting fields) in one narrow stage."""
    kept, _ = reject_incomplete(normalize_posting(batch))
    keyed = payload_hash(source_job_key(fingerprint(posting_keys(kept))))
    scored = keyword_score(keyed.withColumn("years_req", years_requirement("jd_text")), rules, as_of)
    return fit_gate(scored, profile, options)


def settle_postings(gated: DataFrame, options: GateOptions, answers: DataFrame | None = None) -> DataFrame:
    """Final fit and admission of a gated batch; review ``answers`` (seq, answer, answer_cached, skip_reason) join on the unique
    ``seq``."""
    if answers is None:
        settled = without_answers(gated, "disabled_or_missing_key")
    else:
        settled = gated.join(answers, "seq", "left").withColumn("answer_cached", F.coalesce("answer_cached", F.lit(False)))
    return admission_status(final_fit(settled, options))


def evaluate_postings(
    batch: DataFrame, rules: KeywordRules, profile: Profile, options: GateOptions, as_of: datetime,
    answers: DataFrame | None = None,
) -> DataFrame:
    """Normalize, score, gate and settle a batch."""
    return settle_postings(gate_postings(batch, rules, profile, options, as_of), options, answers)


def _queue_row(scored: DataFrame, run_id: int, as_of: datetime) -> DataFrame:
    """Queue columns of evaluated rows that already carry id, status, created_at and first_seen_at."""
    now = instant(as_of)
    touched = F.col("llm_queued") | F.col("llm_used")
    rows = scored.withColumns(
        {
            "fit_reason_codes": F.col("reason_codes"),
            "updated_at": now,
            "last_seen_at": now,
            "last_run_id": F.lit(run_id),
            "llm_pending_batch_id": F.lit(None).cast("string"),
            "llm_pending_custom_id": F.lit(None).cast("string"),
            "llm_review_updated_at": F.when(touched, now),
        }
    )
    return evolve_schema(rows, QUEUE)


def place_batch(queue: DataFrame, scored: DataFrame, run_id: int, **hot: int) -> DataFrame:
    """Outcome of a batch against the queue, one row per batch row: its entity and what the row-by-row order
    would have reported. Only key columns of the queue are read.

    Entities are connected components over the three keys across queue and batch. The earliest existing row
    of an entity owns it; an entity without one gets a new id.
    """
    owner_type = "struct<first_seen_at:timestamp,id:string,status:string,created_at:timestamp>"
    of_batch = scored.select(
        *ENTITY_COLUMNS, "seq", "admission_status", F.lit(None).cast(owner_type).alias("owner"),
        F.concat(F.lit("b"), F.col("seq").cast("string")).alias("node_id"),
    )
    of_queue = queue.select(
        *ENTITY_COLUMNS, F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("admission_status"),
        F.struct("first_seen_at", "id", "status", "created_at").alias("owner"), F.concat(F.lit("q"), F.col("id")).alias("node_id"),
    )
    members = cut_lineage(
        resolve_entities(of_batch.unionByName(of_queue), ["seq", "admission_status", "owner"], **hot)
    )
    batch_rows = members.filter(F.col("seq").isNotNull()).drop("owner")
    n = batch_rows.count()
    spans = batch_rows.groupBy("component").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    owners = members.filter(F.col("seq").isNull()).groupBy("component").agg(F.min("owner").alias("owner"))
    entities = spans.join(owners, "component", "left")
    if n:
        batch_rows = previous_value(batch_rows, "component", "seq", F.col("admission_status"), "_prior")
    else:
        batch_rows = batch_rows.withColumn("_prior", F.lit(None).cast("string"))
    placed = lookup_join(batch_rows, entities, "component", row_count=n, **hot)
    owner = F.col("owner")
    new_id = F.sha1(F.concat(F.col("component"), F.lit(f":{run_id}")))
    is_first = F.col("seq") == F.col("first_seq")
    before = F.when(is_first, owner["status"]).otherwise(
        F.when(owner["status"].isin(*fv.STICKY_STATUSES), owner["status"]).otherwise(F.col("_prior"))
    )
    deduped = ~is_first | owner["id"].isNotNull()
    back = deduped & (before == "filtered") & (F.col("admission_status") == "inbox")
    return cut_lineage(
        placed.select(
            "seq", F.coalesce(owner["id"], new_id).alias("job_id"), F.when(deduped, "deduped").otherwise("inserted").alias("result"),
            before.alias("previous_status"), F.coalesce(back, F.lit(False)).alias("resurfaced"),
            (F.col("seq") == F.col("last_seq")).alias("is_winner"), "owner",
        )
    )


def next_queue(queue: DataFrame, scored: DataFrame, outcome: DataFrame, run_id: int, as_of: datetime) -> DataFrame:
    """Queue after a batch: owners rewritten from the newest batch row of their entity, new entities added,
    other rows as they are. A rewritten row keeps id, created_at, first_seen_at and a sticky status."""
    now = instant(as_of)
    winners = outcome.filter("is_winner").select("seq", F.col("job_id").alias("id"), "owner")
    written = scored.join(winners, "seq").withColumns(
        {
            "status": sticky_status(F.col("owner.status"), F.col("admission_status")),
            "created_at": F.coalesce("owner.created_at", now),
            "first_seen_at": F.when(F.col("owner.id").isNotNull(), F.col("owner.first_seen_at")).otherwise(now),
        }
    )
    rewritten = winners.filter(F.col("owner.id").isNotNull()).select("id")
    if rewritten.count() <= SMALL_ROWS:
        rewritten = F.broadcast(rewritten)
    untouched = evolve_schema(queue, QUEUE).join(rewritten, "id", "left_anti")
    return untouched.unionByName(_queue_row(written, run_id, as_of))


def outcome_detail(scored: DataFrame, outcome: DataFrame) -> DataFrame:
    """Outcome rows with what lineage, events and counters need of the posting; both sides have ``seq`` once."""
    return outcome.drop("owner", "is_winner").join(scored.select("seq", *DETAIL_COLUMNS), "seq")


def upsert_postings(
    queue: DataFrame, scored: DataFrame, run_id: int, as_of: datetime, **hot: int
) -> tuple[DataFrame, DataFrame]:
    """(next queue, outcome detail) of one ingest run; ``scored`` comes from ``evaluate_postings``."""
    scored = cut_lineage(scored)
    outcome = place_batch(queue, scored, run_id, **hot)
    return next_queue(queue, scored, outcome, run_id, as_of), outcome_detail(scored, outcome)


def upsert_outcome(queue: DataFrame, scored: DataFrame, run_id: int, **hot: int) -> DataFrame:
    """The outcome detail of ``upsert_postings`` alone. What only queue rows hold (texts, keyword scores) is neither computed nor written."""
    short = cut_lineage(scored.select("seq", *dict.fromkeys((*ENTITY_COLUMNS, *DETAIL_COLUMNS))))
    return outcome_detail(short, place_batch(queue, short, run_id, **hot))


def append_lineage(outcome: DataFrame, run_id: int, as_of: datetime) -> DataFrame:
    """One lineage row per ingested row, repeats too."""
    return outcome.select(
        "job_id", F.lit(run_id).cast("bigint").alias("run_id"), "source", "source_job_key",
        F.col("post_date").alias("raw_post_date"), F.col("post_date").alias("normalized_post_date"),
        instant(as_of).alias("ingested_at"), "payload_hash",
    )


def event_id(as_of: datetime, event_type: Column, *parts: Column | str) -> Column:
    """60 bits of a digest of time, kind and what tells the event apart from others: a replay gives the same id, another call
    another one. Events are ordered by time, then id."""
    told = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    digest = F.sha1(F.concat_ws("|", F.lit(str(epoch_seconds(as_of))), event_type, *told))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _payload(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def append_events(outcome: DataFrame, run_id: int, as_of: datetime) -> DataFrame:
    """``ingested`` or ``deduped`` for every row, ``resurfaced`` where a filtered posting came back."""
    c = F.col
    kind = F.when(c("result") == "deduped", "deduped").otherwise("ingested")
    message = F.when(c("result") == "deduped", MESSAGES["deduped"]).otherwise(MESSAGES["ingested"])
    stored = _payload(
        fingerprint=c("canonical_fingerprint"), dedupReason=c("dedup_reason"), source=c("source"),
        sourceJobKey=c("source_job_key"), qualityBucket=c("quality_bucket"), admittedToInbox=c("admitted"),
        llmQueued=c("llm_queued"),
    )
    back = _payload(
        previousStatus=c("previous_status"), nextStatus=c("admission_status"), qualityBucket=c("quality_bucket")
    )
    first = F.struct(kind.alias("event_type"), message.alias("message"), stored.alias("payload_json"))
    second = F.struct(
        F.lit("resurfaced").alias("event_type"), F.lit(MESSAGES["resurfaced"]).alias("message"),
        back.alias("payload_json"),
    )
    both = F.when(c("resurfaced"), F.array(first, second)).otherwise(F.array(first))
    rows = outcome.select("seq", "job_id", F.explode(both).alias("e"))
    return rows.select(
        event_id(as_of, c("e.event_type"), F.lit(run_id), "seq").alias("id"), "job_id", F.lit(run_id).cast("bigint").alias("run_id"),
        "e.event_type", "e.message", "e.payload_json", instant(as_of).alias("created_at"),
    )


def set_status(queue: DataFrame, changes: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(next queue, events) for changes (seq, id, status). A change with another status or an unknown id does
    nothing; the last change of an id wins; no transition is forbidden."""
    valid = cut_lineage(changes.filter(F.col("status").isin(*fv.WORKFLOW_STATUSES)))
    ids = queue.select("id", F.lit(True).alias("_known"))
    known = lookup_join(valid, ids, "id", row_count=valid.count()).filter("_known").drop("_known")
    last = known.groupBy("id").agg(F.max_by("status", "seq").alias("_next"))
    changed = queue.join(last, "id", "left").withColumns(
        {
            "status": F.coalesce("_next", "status"),
            "updated_at": F.when(F.col("_next").isNotNull(), instant(as_of)).otherwise(F.col("updated_at")),
        }
    )
    events = known.select(
        event_id(as_of, F.lit("status_changed"), "id", "seq").alias("id"), F.col("id").alias("job_id"), F.lit(None).cast("bigint").alias("run_id"),
        F.lit("status_changed").alias("event_type"), F.concat(F.lit("Status is now "), F.col("status")).alias("message"),
        _payload(status=F.col("status")).alias("payload_json"), instant(as_of).alias("created_at"),
    )
    return changed.select(*queue.columns), events


def skip_company(queue: DataFrame, company: str, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(next queue, updated count): every row of the company, whatever its status; no event."""
    hit = F.coalesce(F.col("company") == company, F.lit(False))
    changed = queue.withColumns(
        {
            "status": F.when(hit, "skipped").otherwise(F.col("status")),
            "updated_at": F.when(hit, instant(as_of)).otherwise(F.col("updated_at")),
        }
    )
    return changed, queue.agg(F.count_if(hit).alias("updated"))


def sync_outbox(applied: DataFrame, as_of: datetime, application: str = "vacantia") -> DataFrame:
    """Outbound rows of newly applied postings; delivering them is the caller's sink."""
    note = F.format_string(
        f"Sent by {application}: tier %s, score %s, source %s",
        F.col("tier"), F.col("score").cast("string"), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")),
    )
    return applied.select(
        "company", F.col("title").alias("position"), F.lit("applied").alias("status"),
        F.nullif(F.col("location"), F.lit("")).alias("location"),
        F.date_format(instant(as_of), "yyyy-MM-dd").alias("applied_date"), note.alias("notes"),
        F.nullif(F.col("url"), F.lit("")).alias("url"), F.col("id").alias("external_id"),
    )


def sync_events(outbox: DataFrame, as_of: datetime) -> DataFrame:
    """One event per outbound row; ``error`` holds the delivery error, null when delivered."""
    ok = F.col("error").isNull()
    kind = F.when(ok, "synced_pd").otherwise("sync_failed")
    return outbox.select(
        event_id(as_of, kind, "external_id").alias("id"), F.col("external_id").alias("job_id"), F.lit(None).cast("bigint").alias("run_id"),
        kind.alias("event_type"),
        F.when(ok, MESSAGES["synced_pd"]).otherwise(MESSAGES["sync_failed"]).alias("message"),
        F.when(~ok, _payload(error=F.col("error"))).alias("payload_json"), instant(as_of).alias("created_at"),
    )


def cleanup_inbox(
    queue: DataFrame, profile: Profile, options: GateOptions, run_id: int, as_of: datetime, answers: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next queue, events, evaluated rows): the gate again over the inbox rows only. Other rows pass through,
    so nothing is shuffled; the review state stays as it is."""
    kept_text = ["company", "title", "location", "post_date", "source", "url", "jd_text"]
    inbox = queue.filter(F.col("status") == "inbox")
    originals = F.struct(*[F.col(c) for c in queue.columns]).alias("_row")
    gated = fit_gate(normalize_posting(inbox.select("id", *kept_text, "is_bigtech", originals)), profile, options)
    if answers is None:
        settled = without_answers(gated, "disabled_or_missing_key")
    else:
        settled = gated.join(answers, "id", "left").withColumn("answer_cached", F.coalesce("answer_cached", F.lit(False)))
    fitted = final_fit(settled, options)
    now = instant(as_of)
    new_values = {
        "status": F.when(F.col("admitted"), "inbox").otherwise("filtered"), "fit_score": F.col("fit_score"),
        "fit_label": F.col("fit_label"), "fit_source": F.col("fit_source"), "fit_reason_codes": F.col("reason_codes"),
        "quality_bucket": F.col("quality_bucket"), "rejected_by_quality": ~F.col("admitted"),
        "llm_confidence": F.col("llm_confidence"), "llm_missing_must_have": F.col("llm_missing_must_have"),
        "last_run_id": F.lit(run_id).cast("bigint"), "updated_at": now,
    }
    evaluated = fitted.select(
        *[(new_values[c] if c in new_values else F.col(f"_row.{c}")).alias(c) for c in queue.columns],
        "admitted", "llm_used", "llm_eligible", "llm_attempted", "llm_queued", F.col("reason_codes").alias("codes"),
    )
    c = F.col
    kind = F.when(c("admitted"), "cleanup_kept").otherwise("cleanup_filtered")
    events = evaluated.select(
        event_id(as_of, kind, F.lit(run_id), "id").alias("id"), c("id").alias("job_id"), F.lit(run_id).cast("bigint").alias("run_id"),
        kind.alias("event_type"),
        F.when(c("admitted"), MESSAGES["cleanup_kept"]).otherwise(MESSAGES["cleanup_filtered"]).alias("message"),
        _payload(
            fitScore=c("fit_score"), fitLabel=c("fit_label"), fitSource=c("fit_source"), qualityBucket=c("quality_bucket"),
            reasonCodes=c("codes"), llmUsed=c("llm_used"),
        ).alias("payload_json"),
        now.alias("created_at"),
    )
    others = queue.filter(~F.coalesce(F.col("status") == "inbox", F.lit(False)))
    return others.unionByName(evaluated.select(*queue.columns)), events, evaluated


def requeue_failed(
    queue: DataFrame, profile: Profile, options: GateOptions, as_of: datetime, limit: int | None = None
) -> DataFrame:
    """Failed reviews that the gate still finds borderline wait again; with a ``limit`` only the newest are tried."""
    tried = requeue_candidates(queue, limit).select("id", "company", "title", "location", "post_date", "source", "url", "jd_text", "is_bigtech", "last_run_id")
    eligible = fit_gate(normalize_posting(tried), profile, options).filter("needs_review")
    custom = F.concat(
        F.lit("run_"), F.coalesce(F.col("last_run_id").cast("string"), F.lit("null")), F.lit("_job_"), F.col("id"),
    )
    joined = checked_join(queue, cut_lineage(eligible.select("id", custom.alias("_custom"))), "id")
    hit = F.col("_custom").isNotNull()
    return joined.withColumns(
        {
            "llm_review_state": F.when(hit, "pending").otherwise(F.col("llm_review_state")),
            "llm_review_error": F.when(~hit, F.col("llm_review_error")),
            "llm_pending_custom_id": F.when(hit, F.col("_custom")).otherwise(F.col("llm_pending_custom_id")),
            "llm_review_updated_at": F.when(hit, instant(as_of)).otherwise(F.col("llm_review_updated_at")),
        }
    ).select(*queue.columns)


def ingest_manual(queue: DataFrame, rows: DataFrame, rules: KeywordRules, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(next queue, events): rows (seq plus posting fields) appended with the keyword score only; no keys, no
    gate, no deduplication. Rows without company or title are refused."""
    kept, _ = reject_incomplete(rows)
    scored = keyword_score(kept, rules, as_of)
    now = instant(as_of)
    added = scored.withColumns(
        {
            "id": F.sha1(F.concat(F.lit("manual:"), F.date_format(now, "yyyyMMddHHmmssSSS"), F.lit(":"), F.col("seq").cast("string"))),
            "status": F.lit("inbox"), "created_at": now, "updated_at": now,
            **{c: F.nullif(F.col(c), F.lit("")) for c in ("location", "post_date", "source", "url", "jd_text")},
        }
    )
    events = added.select(
        event_id(as_of, F.lit("ingested"), F.lit("manual"), "seq").alias("id"), F.col("id").alias("job_id"), F.lit(None).cast("bigint").alias("run_id"),
        F.lit("ingested").alias("event_type"), F.lit(MESSAGES["manual"]).alias("message"),
        _payload(source=F.coalesce("source", F.lit("manual"))).alias("payload_json"), now.alias("created_at"),
    )
    return evolve_schema(queue, QUEUE).unionByName(evolve_schema(added, QUEUE)), events


def check_uniqueness(queue: DataFrame) -> DataFrame:
    """(rule, key, n) of violated unique keys; a null in a key never collides."""
    rules = {
        "company_title_url": ("company", "title", "url"),
        "company_title_location_date": ("company_key", "title_key", "location_key", "post_date_key"),
        "fingerprint": ("canonical_fingerprint",),
    }
    keys = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.when(~F.exists(F.array(*cols), lambda v: v.isNull()), F.concat_ws("|", *cols)).alias("key"),
            )
            for rule, cols in rules.items()
        ]
    )
    pairs = queue.select(F.inline(keys)).filter(F.col("key").isNotNull())
    return pairs.groupBy("rule", "key").agg(F.count("*").alias("n")).filter("n > 1")
