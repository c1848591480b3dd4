"""Row filters of the ingest run and predicates of the review list."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import fixed_values as fv
from vacantia.functions.dates import ISO_DAY, as_utc, instant, parse_date_text
from vacantia.functions.text import trim_blanks


def reject_incomplete(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): a posting needs a company and a title."""
    complete = (F.coalesce("company", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    return postings.filter(complete), postings.filter(~complete)


def freshness_class(hours: int, allow_unknown: bool, as_of: datetime, post_date: str = "post_date") -> Column:
    """``kept``, ``old`` or ``unknown`` for each posting; an unparsable date is old."""
    cutoff = as_utc(as_of) - timedelta(hours=hours)
    day_cutoff = cutoff.replace(hour=0, minute=0, second=0, microsecond=0)
    text = trim_blanks(post_date)
    bound = F.when(text.rlike(ISO_DAY), instant(day_cutoff)).otherwise(instant(cutoff))
    fresh = F.coalesce(parse_date_text(text) >= bound, F.lit(False))
    unknown = F.coalesce(F.col(post_date), F.lit("")) == ""
    return F.when(unknown, "kept" if allow_unknown else "unknown").when(fresh, "kept").otherwise("old")


def freshness_filter(postings: DataFrame, hours: int, allow_unknown: bool, as_of: datetime) -> DataFrame:
    return postings.filter(freshness_class(hours, allow_unknown, as_of) == "kept")


def region_filter(postings: DataFrame, words: Sequence[str] = fv.REGION_WORDS) -> DataFrame:
    """Postings in the region or marked virtual, flagged as big-company rows."""
    place = F.lower(F.coalesce("location", F.lit("")))
    near: Column = F.coalesce(F.col("meta")["is_virtual"] == "true", F.lit(False))
    for word in words:
        near = near | F.contains(place, F.lit(word))
    return postings.filter(near).withColumn("is_bigtech", F.lit(True))


def filter_tier(tier: str | None) -> Column:
    return F.col("tier") == tier if tier else F.lit(True)


def filter_status_default(status: str | None = None, include_filtered: bool = False) -> Column:
    if status:
        return F.col("status") == status
    return F.lit(True) if include_filtered else F.col("status") != "filtered"


def filter_llm_pending(pending_only: bool = False, status: str | None = None) -> Column:
    if pending_only:
        return F.col("llm_review_state") == "pending"
    if status == "inbox":
        return F.coalesce("llm_review_state", F.lit("none")) != "pending"
    return F.lit(True)


def filter_source(source: str | None) -> Column:
    return F.col("source") == source if source else F.lit(True)


def filter_bigtech(only: bool = True) -> Column:
    return F.col("is_bigtech") == F.lit(True) if only else F.lit(True)


def filter_text(q: str | None) -> Column:
    """Title or company contains the text, any case; ``%`` and ``_`` in it stay wildcards."""
    if not q:
        return F.lit(True)
    pattern = "%" + q.replace("\\", "\\\\") + "%"
    return F.col("title").ilike(pattern) | F.col("company").ilike(pattern)


def filter_min_score(minimum: float | None) -> Column:
    return F.col("score") >= minimum if minimum else F.lit(True)


def filter_seen_within(days: float | None, as_of: datetime) -> Column:
    if not days:
        return F.lit(True)
    return F.col("last_seen_at") >= instant(as_utc(as_of) - timedelta(days=max(1, days)))


def filter_inbox() -> Column:
    return F.col("status") == "inbox"


def filter_review_failed() -> Column:
    return F.col("llm_review_state") == "failed"


def filter_active_batches(statuses: Sequence[str] = fv.ACTIVE_BATCH_STATUSES) -> Column:
    return F.col("status").isin(*statuses)
