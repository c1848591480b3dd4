"""Profile gate: deterministic fit, the reviewed verdict on borderline rows, admission."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import fixed_values as fv
from vacantia.config import GateOptions, Profile
from vacantia.functions.keywords import MANY, rules_present
from vacantia.functions.text import compact_list, has_word, min_years_pattern, sql_text
from vacantia.session import hold_filters

GATE_COLUMNS = ("fit_score", "fit_label", "fit_source", "quality_bucket", "admitted", "needs_review", "reason_codes")
ANSWER_SCHEMA = (
    "fit_label string, fit_score int, confidence double, reason_codes array<string>, missing_must_have array<string>"
)


def min_years_of(keyword: str) -> int | None:
    """The number in an exclusion of the form ``N+ years``."""
    found = re.fullmatch(r"(\d+)\s*\+\s*(?:years?|yrs?)", keyword.lower().strip())
    return int(found.group(1)) if found else None


def _excluded(text: str, keyword: str) -> str:
    years = min_years_of(keyword)
    return has_word(text, keyword) if years is None else f"rlike({text}, {sql_text(min_years_pattern(years))})"


POINTS = {"role_match": fv.ROLE_POINTS, "must_skill": fv.MUST_SKILL_POINTS, "nice_skill": fv.NICE_SKILL_POINTS}


def _tested_one_by_one(rows: DataFrame, words: list[tuple[str, str]], profile: Profile) -> DataFrame:
    """Add ``_points``, ``_rejected`` and ``reason_codes``, every entry tested in a column of its own."""
    tests = {
        f"_w{i}": F.expr(_excluded("_text", k) if kind == "hard_exclusion" else has_word("_text", k))
        for i, (kind, k) in enumerate(words)
    }

    def any_of(kind: str) -> str:
        return "(" + (" or ".join(f"_w{i}" for i, (k, _) in enumerate(words) if k == kind) or "false") + ")"

    parts = [f"if(_w{i}, {POINTS[kind]}, 0)" for i, (kind, _) in enumerate(words) if kind in POINTS]
    parts.append(f"if(not {any_of('role_match')}, {fv.NO_ROLE_POINTS}, 0)")
    codes = [f"if(_w{i}, {sql_text(f'{kind}:{k}')}, null)" for i, (kind, k) in enumerate(words)]
    codes += ["concat('location:', _near)", f"if(not {any_of('role_match')}, 'role:no_match', null)"]
    if profile.must_have_skills:
        codes.append(f"if(not {any_of('must_skill')}, 'must_skill:none', null)")
    return rows.withColumns(tests).withColumns(
        {"_points": F.expr(" + ".join(parts)), "_rejected": F.expr(any_of("hard_exclusion")), "reason_codes": compact_list(codes)}
    ).drop(*tests)


def _tested_at_once(rows: DataFrame, words: list[tuple[str, str]], profile: Profile) -> DataFrame:
    """The same from one search for all words; entries of the form ``N+ years`` are patterns of their own, at most one for each N."""
    years = {i: min_years_of(k) for i, (kind, k) in enumerate(words) if kind == "hard_exclusion" and min_years_of(k) is not None}
    fields = [{"kind": kind, "keyword": k, "points": POINTS.get(kind, 0)} for kind, k in words]
    found = rules_present(F.col("_text"), [("" if i in years else k.lower(), fields[i]) for i, (_, k) in enumerate(words)], bounded=True)
    for n in sorted(set(years.values())):
        own = [F.struct(F.lit(i).cast("bigint").alias("place"), *[F.lit(fields[i][c]).cast(t).alias(c) for c, t in (("kind", "string"), ("keyword", "string"), ("points", "bigint"))]) for i in years if years[i] == n]
        found = F.concat(found, F.when(F.expr(f"rlike(_text, {sql_text(min_years_pattern(n))})"), F.array(*own)).otherwise(F.array(*own[:0]).cast("array<struct<place: bigint, kind: string, keyword: string, points: bigint>>")))
    listed = rows.withColumn("_found", F.array_sort(found))

    def any_of(kind: str) -> Column:
        return F.exists("_found", lambda r: r["kind"] == kind)

    codes = [F.concat(F.lit("location:"), F.col("_near")), F.when(~any_of("role_match"), "role:no_match")]
    if profile.must_have_skills:
        codes.append(F.when(~any_of("must_skill"), "must_skill:none"))
    points = F.aggregate("_found", F.lit(0).cast("bigint"), lambda a, r: a + r["points"]) + F.when(~any_of("role_match"), fv.NO_ROLE_POINTS).otherwise(0)
    told = F.transform("_found", lambda r: F.concat(r["kind"], F.lit(":"), r["keyword"]))
    return listed.withColumns(
        {"_points": points.cast("int"), "_rejected": any_of("hard_exclusion"), "reason_codes": F.concat(told, F.array_compact(F.array(*codes)))}
    ).drop("_found")


def fit_gate(postings: DataFrame, profile: Profile, options: GateOptions) -> DataFrame:
    """Add the gate columns (``GATE_COLUMNS``). One narrow stage: every list entry is a literal test with a
    column of its own, so the score and the reason codes read it instead of searching again. More than ``MANY`` entries are
    searched in one pass instead."""
    words = (
        [("hard_exclusion", k) for k in profile.hard_exclusions]
        + [("role_match", k) for k in profile.target_roles]
        + [("must_skill", k) for k in profile.must_have_skills]
        + [("nice_skill", k) for k in profile.nice_to_have_skills]
    )
    lowered = postings.withColumns(
        {
            "_text": F.expr("lower(concat(coalesce(title, ''), '\n', coalesce(jd_text, '')))"),
            "_place": F.expr("lower(coalesce(location, ''))"),
        }
    )
    wanted = " or ".join(f"contains(_place, {sql_text(p)})" for p in profile.location_preferences) or "false"
    unknown = f"_place = '' and {str(options.allow_unknown_location).lower()}"
    place = f"case when {unknown} then 'unknown_allowed' when {wanted} then 'preferred' when _place <> '' then 'mismatch' end"
    tested = (_tested_at_once if len(words) > MANY else _tested_one_by_one)(lowered.withColumn("_near", F.expr(place)), words, profile)
    low, high = options.borderline
    location = F.expr(
        f"case _near when 'unknown_allowed' then {fv.UNKNOWN_LOCATION_POINTS} when 'preferred' then {fv.PREFERRED_LOCATION_POINTS}"
        f" when 'mismatch' then {fv.MISMATCH_LOCATION_POINTS} else 0 end"
    )
    scored = tested.withColumn("_score", F.col("_points") + location)
    s, rejected = F.col("_score"), F.col("_rejected")
    admitted = ~rejected & (s >= options.inbox_floor)
    borderline = ~rejected & ~admitted & s.between(low, high)
    gated = scored.withColumns(
        {
            "fit_score": F.when(rejected, F.greatest(F.lit(0), s + fv.HARD_EXCLUSION_POINTS))
            .when(admitted | borderline, s).otherwise(F.greatest(F.lit(0), s)).cast("int"),
            "fit_label": F.when(admitted, "high").when(borderline, "medium").otherwise("low"),
            "fit_source": F.lit("rules"),
            "quality_bucket": F.when(admitted, "high").when(borderline, "borderline").otherwise("filtered"),
            "admitted": admitted,
            "needs_review": borderline,
        }
    )
    return hold_filters(gated.drop("_text", "_place", "_near", "_points", "_score", "_rejected"))


def without_answers(gated: DataFrame, skip_reason: str) -> DataFrame:
    """Borderline rows all skipped for one reason, as when review is switched off."""
    return gated.withColumns(
        {
            "answer": F.lit(None).cast(f"struct<{ANSWER_SCHEMA.replace(' ', ':').replace(',:', ',')}>"),
            "answer_cached": F.lit(False),
            "skip_reason": F.when(F.col("needs_review"), skip_reason),
        }
    )


def final_fit(gated: DataFrame, options: GateOptions) -> DataFrame:
    """Settle the fit from the gate and the review ``answer``, ``answer_cached`` and ``skip_reason`` columns.

    Rows that need no review keep the gate's verdict. An answer admits by label or threshold. Without an
    answer the gate's verdict stands with the skip reason; in batch mode a queued row waits as admitted.
    """
    eligible = F.col("needs_review")
    answer = F.col("answer")
    used = eligible & answer.isNotNull()
    skip = F.coalesce("skip_reason", F.lit("unknown"))
    queued = eligible & ~used & F.lit(options.batch_mode) & (skip == "batch_queued")
    admitted = (answer["fit_label"] == "high") | (answer["fit_score"] >= options.admit_floor)
    source = F.when(F.col("answer_cached") & F.lit(options.batch_mode), "llm_cache").otherwise("llm")
    empty = F.array().cast("array<string>")
    answer_codes = F.transform(F.coalesce(answer["reason_codes"], empty), lambda c: F.concat(F.lit("llm:"), c))
    skipped_code = F.array(F.concat(F.lit("llm_skipped:"), skip))
    codes = F.when(used, F.concat("reason_codes", answer_codes))
    if not options.batch_mode:
        codes = codes.when(eligible, F.concat("reason_codes", skipped_code))
    return gated.withColumns(
        {
            "fit_score": F.when(used, answer["fit_score"]).otherwise(F.col("fit_score")),
            "fit_label": F.when(used, answer["fit_label"]).otherwise(F.col("fit_label")),
            "fit_source": F.when(used, source).otherwise(F.col("fit_source")),
            "quality_bucket": F.when(used, F.when(admitted, "high").otherwise("filtered"))
            .when(queued, "pending_llm").otherwise(F.col("quality_bucket")),
            "admitted": F.when(used, admitted).when(queued, True).otherwise(F.col("admitted")),
            "reason_codes": codes.otherwise(F.col("reason_codes")),
            "llm_confidence": F.when(used, answer["confidence"]),
            "llm_missing_must_have": F.when(used, F.coalesce(answer["missing_must_have"], empty)).otherwise(empty),
            "llm_used": used,
            "llm_eligible": eligible,
            "llm_attempted": eligible,
            "llm_skipped_reason": F.when(eligible & ~used, skip),
            "llm_queued": queued,
        }
    ).drop("answer", "answer_cached", "skip_reason")


def admission_status(fitted: DataFrame) -> DataFrame:
    """Add ``admission_status``, the rejection flag and the review columns."""
    in_inbox = F.col("admitted") | F.col("llm_queued")
    return fitted.withColumns(
        {
            "admission_status": F.when(in_inbox, "inbox").otherwise("filtered"),
            "rejected_by_quality": ~F.col("admitted"),
            "llm_review_state": F.when(F.col("llm_queued"), "pending").when(F.col("llm_used"), "completed").otherwise("none"),
            "llm_review_error": F.col("llm_skipped_reason"),
        }
    )
