"""Date expressions. Every function of the current time takes it as an argument."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

from vacantia.fixed_values import BLANK_CLASS, DATE_TEXT_FORMAT, DATE_TEXT_PATTERN
from vacantia.functions.text import col, trim_blanks

DAY = "yyyy-MM-dd"
ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
UNIT_SECONDS = {"hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
MAX_SECONDS = 8_640_000_000_000


def as_utc(as_of: datetime) -> datetime:
    return as_of.replace(tzinfo=timezone.utc) if as_of.tzinfo is None else as_of.astimezone(timezone.utc)


def epoch_seconds(as_of: datetime) -> int:
    return int(as_utc(as_of).timestamp())


def instant(as_of: datetime) -> Column:
    return F.timestamp_micros(F.lit(round(as_utc(as_of).timestamp() * 1_000_000)))


def day_of(ts: Column) -> Column:
    return F.date_format(ts, DAY)


def _parse_written(c: Column) -> Column:
    """Timestamp of a text in one of the written formats; a text of another shape is null."""
    return F.try_to_timestamp(F.regexp_replace(c, DATE_TEXT_PATTERN, "$1 @"), F.lit(DATE_TEXT_FORMAT))


def parse_date_text(c: Column | str) -> Column:
    """Timestamp of a date text in one of the accepted formats, else null."""
    c = col(c)
    return F.when(c.rlike(ISO_DAY + "|" + ISO_INSTANT), c.try_cast("timestamp")).otherwise(_parse_written(c))


def normalize_date(c: Column | str) -> Column:
    """First ten characters of an ISO text, else the UTC day of a parsable text, else null."""
    c = col(c)
    return F.when(c.rlike(ISO_PREFIX), F.substring(c, 1, 10)).otherwise(day_of(_parse_written(c)))


def _relative_parts(c: Column) -> tuple[Column, Column]:
    pattern = rf"(\d+){BLANK_CLASS}*(hour|day|week|month|year)s?{BLANK_CLASS}*ago"
    lowered = F.lower(c)
    return (
        F.nullif(F.regexp_extract(lowered, pattern, 1), F.lit("")),
        F.regexp_extract(lowered, pattern, 2),
    )


def relative_date(c: Column | str, as_of: datetime, otherwise: Column | None = None) -> Column:
    """``today``, ``yesterday`` and ``N units ago`` as a UTC day; an ISO prefix is kept."""
    c = F.nullif(col(c), F.lit(""))
    now = epoch_seconds(as_of)
    lowered = F.lower(c)
    digits, unit = _relative_parts(c)
    count = digits.try_cast("bigint")
    seconds = F.lit(None).cast("bigint")
    for name, size in UNIT_SECONDS.items():
        seconds = F.when((unit == name) & (count <= MAX_SECONDS // size), count * F.lit(size)).otherwise(seconds)
    ago = F.when(seconds > 0, day_of(F.timestamp_seconds(F.lit(now) - seconds)))
    fallback = F.lit(None).cast("string") if otherwise is None else otherwise
    return (
        F.when(c.isNull(), None)
        .when(c.rlike(ISO_PREFIX), F.substring(c, 1, 10))
        .when(F.contains(lowered, F.lit("today")), day_of(F.timestamp_seconds(F.lit(now))))
        .when(F.contains(lowered, F.lit("yesterday")), day_of(F.timestamp_seconds(F.lit(now - 86400))))
        .when(digits.isNotNull(), ago)
        .otherwise(fallback)
    )


def relative_date_or_parse(c: Column | str, as_of: datetime) -> Column:
    return relative_date(c, as_of, otherwise=day_of(_parse_written(col(c))))


def epoch_ms_day(c: Column | str) -> Column:
    c = col(c).cast("bigint")
    return F.when(c != 0, day_of(F.timestamp_millis(c)))


def posted_at_granularity(c: Column | str) -> Column:
    """Struct of timestamp and granularity: ``day``, ``exact``, or null when unparsable."""
    text = trim_blanks(c)
    ts = parse_date_text(text)
    return F.struct(
        ts.alias("ts"),
        F.when(ts.isNull(), None).when(text.rlike(ISO_DAY), "day").otherwise("exact").alias("granularity"),
    )
