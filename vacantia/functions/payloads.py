"""JSON payload expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacantia.fixed_values import FIT_LABELS
from vacantia.functions.text import col


def json_text(variant: Column | str, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")


def json_list(variant: Column | str, path: str) -> Column:
    return F.try_variant_get(variant, path, "array<variant>")


def json_truthy(variant: Column | str, path: str) -> Column:
    """Text of a field, null when it is missing, empty, zero or false."""
    text = F.nullif(json_text(variant, path), F.lit(""))
    is_text = F.schema_of_variant(F.try_variant_get(variant, path, "variant")) == "STRING"
    return F.when(~text.isin("0", "0.0", "false") | is_text, text)


def parse_json_list_safe(c: Column | str) -> Column:
    """String array of a JSON list; anything else is an empty array."""
    values = F.try_variant_get(F.try_parse_json(col(c)), "$", "array<string>")
    return F.coalesce(values, F.array().cast("array<string>"))


def shown_codes(codes: Column | str, most: int | None = None) -> Column:
    """All codes, or the first ``most`` for a narrow view."""
    return col(codes) if most is None else F.slice(col(codes), 1, most)


def leading_int(text: Column) -> Column:
    """Integer at the start of a text, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint")


def normalize_fit_payload(c: Column | str) -> Column:
    """Classifier answer as a struct of checked values; see ``FIT_LABELS``."""
    v = F.try_parse_json(col(c))
    label = F.lower(json_text(v, "$.fit_label"))
    score = F.coalesce(leading_int(json_text(v, "$.fit_score")), F.lit(0).cast("bigint"))
    confidence = F.coalesce(json_text(v, "$.confidence").try_cast("double"), F.lit(0.0))
    confidence = F.when(F.isnan(confidence), F.lit(0.0)).otherwise(confidence)
    empty = F.array().cast("array<string>")
    codes = F.coalesce(F.try_variant_get(v, "$.reason_codes", "array<string>"), empty)
    missing = F.coalesce(F.try_variant_get(v, "$.missing_must_have", "array<string>"), empty)
    return F.struct(
        F.when(label.isin(*FIT_LABELS), label).otherwise("low").alias("fit_label"),
        F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("fit_score"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"),
        codes.alias("reason_codes"),
        missing.alias("missing_must_have"),
    )
