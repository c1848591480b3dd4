"""Schemas of the state tables, with the defaults of columns added later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_S, _L, _I, _B, _D, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType(),
)
_LIST = T.ArrayType(T.StringType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TABLES: dict[str, T.StructType] = {
    "job_queue": _schema(
        id=_S, company=_S, title=_S, location=_S, post_date=_S, source=_S, url=_S, jd_text=_S, score=_L, tier=_S,
        status=_S, created_at=_TS, updated_at=_TS, company_key=_S, title_key=_S, location_key=_S, post_date_key=_S,
        hits=_LIST, years_req=_S, is_bigtech=_B, canonical_fingerprint=_S, first_seen_at=_TS, last_seen_at=_TS,
        last_run_id=_L, dedup_reason=_S, fit_score=_I, fit_label=_S, fit_source=_S, fit_reason_codes=_LIST,
        quality_bucket=_S, rejected_by_quality=_B, llm_confidence=_D, llm_missing_must_have=_LIST, llm_review_state=_S,
        llm_pending_batch_id=_S, llm_pending_custom_id=_S, llm_review_updated_at=_TS, llm_review_error=_S,
    ),
    "ingestion_runs": _schema(
        id=_L, started_at=_TS, finished_at=_TS, trigger_type=_S, status=_S, summary_json=_S, error_text=_S
    ),
    "job_sources": _schema(
        job_id=_S, run_id=_L, source=_S, source_job_key=_S, raw_post_date=_S, normalized_post_date=_S,
        ingested_at=_TS, payload_hash=_S,
    ),
    "job_events": _schema(
        id=_L, job_id=_S, run_id=_L, event_type=_S, message=_S, payload_json=_S, created_at=_TS
    ),
    "serpapi_usage": _schema(run_id=_L, queries_used=_L, notes=_S, created_at=_TS),
    "llm_usage": _schema(run_id=_L, calls=_L, tokens_prompt=_L, tokens_completion=_L, created_at=_TS),
    "llm_fit_cache": _schema(
        cache_key=_S, fit_label=_S, fit_score=_I, confidence=_D, reason_codes=_LIST, missing_must_have=_LIST, updated_at=_TS
    ),
    "llm_batches": _schema(
        run_id=_L, batch_id=_S, status=_S, model=_S, input_file_id=_S, output_file_id=_S, error_file_id=_S, error_text=_S,
        created_at=_TS, updated_at=_TS, completed_at=_TS, failed_at=_TS,
    ),
    "llm_batch_items": _schema(
        run_id=_L, batch_id=_S, job_id=_S, cache_key=_S, custom_id=_S, state=_S, error_text=_S, created_at=_TS, updated_at=_TS
    ),
}

DEFAULTS: dict[str, object] = {"score": 0, "tier": "B", "status": "inbox", "is_bigtech": False, "rejected_by_quality": False}


def table_schemas() -> dict[str, T.StructType]:
    return dict(TABLES)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def evolve_schema(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """The frame with exactly the schema's columns; a missing one is added with its default."""
    values = DEFAULTS if defaults is None else defaults
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
