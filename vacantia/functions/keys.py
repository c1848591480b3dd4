"""Posting normalization, keys, fingerprints and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.config import Profile
from vacantia.functions.links import url_key
from vacantia.functions.text import LIST_SEPARATOR, col, trim_blanks, truthy_coalesce

POSTING_FIELDS = ("company", "title", "location", "post_date", "source", "url", "jd_text", "is_bigtech", "meta")
META_TYPE = "map<string,string>"


def text_key(c: Column | str) -> Column:
    return F.lower(trim_blanks(F.coalesce(col(c), F.lit(""))))


def _blank_to_null(c: str) -> Column:
    return F.nullif(trim_blanks(c), F.lit(""))


def with_missing_fields(df: DataFrame) -> DataFrame:
    missing = {f: F.lit(None).cast("string") for f in POSTING_FIELDS if f not in df.columns}
    if "is_bigtech" in missing:
        missing["is_bigtech"] = F.lit(False)
    if "meta" in missing:
        missing["meta"] = F.lit(None).cast(META_TYPE)
    return df.withColumns(missing) if missing else df


def normalize_posting(df: DataFrame) -> DataFrame:
    """Trim every field, default company and source, blank to null; other columns pass through."""
    df = with_missing_fields(df)
    return df.withColumns(
        {
            "company": trim_blanks(F.coalesce(F.nullif(F.col("company"), F.lit("")), F.lit("Unknown"))),
            "title": trim_blanks(F.coalesce(F.col("title"), F.lit(""))),
            "location": _blank_to_null("location"),
            "post_date": _blank_to_null("post_date"),
            "source": F.lower(trim_blanks(F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")))),
            "url": _blank_to_null("url"),
            "jd_text": _blank_to_null("jd_text"),
            "is_bigtech": F.coalesce(F.col("is_bigtech"), F.lit(False)),
        }
    )


def posting_keys(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "company_key": text_key("company"),
            "title_key": text_key("title"),
            "location_key": text_key("location"),
            "post_date_key": F.coalesce(F.col("post_date"), F.lit("")),
        }
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Add ``canonical_fingerprint`` and ``dedup_reason``."""
    key = url_key("url")
    day = F.substring(F.coalesce(F.col("post_date"), F.lit("")), 1, 10)
    composite = F.concat_ws("|", text_key("company"), text_key("title"), text_key("location"), day)
    return df.withColumns(
        {
            "canonical_fingerprint": F.when(key.isNotNull(), F.concat(F.lit("url:"), key)).otherwise(
                F.concat(F.lit("composite:"), composite)
            ),
            "dedup_reason": F.when(key.isNotNull(), "url").otherwise("company+title+location+post_date"),
        }
    )


def source_job_key(df: DataFrame) -> DataFrame:
    by_text = F.concat_ws("|", text_key("company"), text_key("title"), F.coalesce("post_date", F.lit("")))
    return df.withColumn(
        "source_job_key",
        F.concat(F.col("source"), F.lit(":"), F.coalesce(truthy_coalesce("url"), by_text)),
    )


def payload_hash(df: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(*[F.col(f) for f in POSTING_FIELDS]), {"ignoreNullFields": "false"})
    return df.withColumn("payload_hash", F.sha1(body))


def fit_cache_key(df: DataFrame, profile: Profile) -> DataFrame:
    def text(c: Column | str) -> Column:
        return F.coalesce(col(c), F.lit(""))

    posting = F.to_json(
        F.struct(
            text("title").alias("title"),
            text("location").alias("location"),
            text("jd_text").alias("jdText"),
            text("source").alias("source"),
            text("url").alias("url"),
        )
    )
    profile_key = F.sha1(F.lit(profile.to_json()))
    return df.withColumn("cache_key", F.concat(F.sha1(posting), F.lit(":"), profile_key))


def entity_keys(df: DataFrame) -> DataFrame:
    """The three match keys as fixed-width digests; a null part means the key never matches."""
    four = F.concat(
        F.col("company_key"), F.lit(LIST_SEPARATOR), F.col("title_key"), F.lit(LIST_SEPARATOR),
        F.col("location_key"), F.lit(LIST_SEPARATOR), F.col("post_date_key"),
    )
    three = F.concat(
        F.col("company"), F.lit(LIST_SEPARATOR), F.col("title"), F.lit(LIST_SEPARATOR),
        F.coalesce(F.col("url"), F.lit("")),
    )
    return df.withColumns(
        {
            "key_fingerprint": F.sha1(F.concat(F.lit("f"), F.col("canonical_fingerprint"))),
            "key_posting": F.sha1(F.concat(F.lit("p"), four)),
            "key_link": F.sha1(F.concat(F.lit("l"), three)),
        }
    )
