"""Queries of scoring, the gate, the final fit and the ingest filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.config import GateOptions, KeywordRules
from vacantia.functions import keys
from vacantia.operators import filters as flt, gate
from vacantia.operators.metrics import freshness_stats as source_freshness
from vacantia.operators.scoring import keyword_score as score_rows
from vacantia.plans import bindings as b
from vacantia.plans.sql_text import BASE, GATED, NORM, SCORED, TB, gate_cte, scored_cte

BATCH_OPTIONS = GateOptions(min_inbox_score=45, borderline_min=20, borderline_max=44, review_mode="batch")


def joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


def keyword_score(spark, sf_dir):
    rows = score_rows(keys.normalize_posting(b.postings(spark, sf_dir)), b.RULES, b.AS_OF)
    return rows.select("seq", "score", "tier", joined("hits"))


def keyword_score_shipped(spark, sf_dir):
    rows = score_rows(_told(spark, sf_dir), KeywordRules(), b.AS_OF)
    return rows.select("seq", "score", "tier", joined("hits"))


def _told(spark, sf_dir) -> DataFrame:
    """Postings whose text also names real keywords, so that the shipped rules apply."""
    words = ["Junior Backend engineer", "Senior lead", "new grad systems C++ role", "5+ years QA contract", "intern"]
    told = F.get(F.array(*[F.lit(w) for w in words]), (F.col("seq") % 5).cast("int"))
    rows = keys.normalize_posting(b.postings(spark, sf_dir))
    return rows.withColumns({"jd_text": F.concat_ws(". ", told, told, "jd_text"), "title": F.concat_ws(" ", "title", told)})


TOLD = """told as (select * replace (concat_ws('. ', w, w, jd_text) as jd_text, concat_ws(' ', title, w) as title) from (
   select *, ['Junior Backend engineer', 'Senior lead', 'new grad systems C++ role', '5+ years QA contract', 'intern'][(seq % 5) + 1] as w from norm))"""


def gate_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "seq", "fit_score", "fit_label", "fit_source", "quality_bucket", F.col("admitted").cast("int").alias("admitted"),
        F.col("needs_review").cast("int").alias("needs_review"), joined("reason_codes"),
    )


def fit_gate(spark, sf_dir):
    return gate_columns(gate.fit_gate(keys.normalize_posting(b.postings(spark, sf_dir)), b.PROFILE, b.OPTIONS))


GATE_SELECT = """select seq, fit_score, fit_label, fit_source, quality_bucket, cast(admitted as int) as admitted,
  cast(needs_review as int) as needs_review, array_to_string(reason_codes, '|') as reason_codes from gated"""


def fit_gate_no_location(spark, sf_dir):
    """Every third posting has no location and unknown locations are allowed."""
    rows = keys.normalize_posting(b.postings(spark, sf_dir)).withColumn("location", F.when(F.col("seq") % 3 != 0, F.col("location")))
    options = GateOptions(45, 20, 44, allow_unknown_location=True)
    return gate_columns(gate.fit_gate(rows, b.PROFILE, options))


def _settled(spark, sf_dir, options: GateOptions) -> DataFrame:
    """Borderline rows with an answer from the labels, a queued mark or another skip reason."""
    gated = gate.fit_gate(keys.normalize_posting(b.postings(spark, sf_dir)), b.PROFILE, options)
    labels = b.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "quality", "toxic")
    both = gated.join(labels, "seq", "left")
    answer = F.struct(
        F.when(F.col("quality") == 1, "high").otherwise("medium").alias("fit_label"),
        (F.lit(40) + F.col("quality") * 50 - F.col("toxic") * 10).cast("int").alias("fit_score"), F.lit(0.5).alias("confidence"),
        F.array(F.lit("label")).alias("reason_codes"), F.array(F.lit("blue")).alias("missing_must_have"),
    )
    known = F.col("quality").isNotNull() & F.col("needs_review")
    reason = F.when(F.col("seq") % 2 == 0, "batch_queued").otherwise("daily_cap_reached")
    return both.withColumns(
        {
            "answer": F.when(known, answer), "answer_cached": F.coalesce(known & (F.col("seq") % 2 == 0), F.lit(False)),
            "skip_reason": F.when(F.col("needs_review") & ~known, reason),
        }
    )


def _fit_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "seq", "fit_score", "fit_label", "fit_source", "quality_bucket", F.col("admitted").cast("int").alias("admitted"),
        joined("reason_codes"), "llm_confidence", joined("llm_missing_must_have"), F.col("llm_used").cast("int").alias("llm_used"),
        F.col("llm_eligible").cast("int").alias("llm_eligible"), "llm_skipped_reason", F.col("llm_queued").cast("int").alias("llm_queued"),
    )


def final_fit(spark, sf_dir):
    return _fit_columns(gate.final_fit(_settled(spark, sf_dir, b.OPTIONS), b.OPTIONS))


def final_fit_batch(spark, sf_dir):
    return _fit_columns(gate.final_fit(_settled(spark, sf_dir, BATCH_OPTIONS), BATCH_OPTIONS))


def final_fit_cte(batch: bool) -> str:
    cached = "'llm_cache'" if batch else "'llm'"
    queued = "(needs_review and not used and skip = 'batch_queued')" if batch else "false"
    skipped = "reason_codes" if batch else "case when needs_review and not used then list_append(reason_codes, 'llm_skipped:' || skip) else reason_codes end"
    return f"""settled as (select g.*, quality, toxic, needs_review and quality is not null as used,
      case when g.seq % 2 = 0 then 'batch_queued' else 'daily_cap_reached' end as skip,
      40 + 50 * quality - 10 * toxic as a_score, case when quality = 1 then 'high' else 'medium' end as a_label
     from gated g left join labels l on l.doc_id = g.seq),
    fitted as (select seq, cast(case when used then a_score else fit_score end as int) as fit_score,
      case when used then a_label else fit_label end as fit_label,
      case when used then case when seq % 2 = 0 then {cached} else 'llm' end else fit_source end as fit_source,
      case when used then case when a_label = 'high' or a_score >= 65 then 'high' else 'filtered' end when {queued} then 'pending_llm' else quality_bucket end as quality_bucket,
      case when used then a_label = 'high' or a_score >= 65 when {queued} then true else admitted end as admitted,
      case when used then list_append(reason_codes, 'llm:label') else {skipped} end as reason_codes,
      case when used then 0.5 end as llm_confidence, case when used then 'blue' else '' end as llm_missing_must_have,
      used as llm_used, needs_review as llm_eligible, case when needs_review and not used then skip end as llm_skipped_reason,
      {queued} as llm_queued from settled)"""


FIT_SELECT = """select seq, fit_score, fit_label, fit_source, quality_bucket, cast(admitted as int) as admitted,
  array_to_string(reason_codes, '|') as reason_codes, llm_confidence, llm_missing_must_have, cast(llm_used as int) as llm_used,
  cast(llm_eligible as int) as llm_eligible, llm_skipped_reason, cast(llm_queued as int) as llm_queued from fitted"""


def admission_status(spark, sf_dir):
    rows = gate.admission_status(gate.final_fit(_settled(spark, sf_dir, BATCH_OPTIONS), BATCH_OPTIONS))
    return rows.select(
        "seq", "admission_status", F.col("rejected_by_quality").cast("int").alias("rejected_by_quality"), "llm_review_state", "llm_review_error"
    )


def reject_incomplete(spark, sf_dir):
    rows = b.postings(spark, sf_dir).withColumn("title", F.when(F.col("seq") % 8 == 0, " ").otherwise(F.col("title")))
    kept, rejected = flt.reject_incomplete(keys.normalize_posting(rows))
    return kept.select("seq", F.lit("kept").alias("part")).unionByName(rejected.select("seq", F.lit("rejected").alias("part")))


def freshness_filter(spark, sf_dir):
    both = [
        flt.freshness_filter(b.postings(spark, sf_dir), b.FRESH_HOURS, allow, b.AS_OF).select("seq", "post_date", F.lit(int(allow)).alias("allow_unknown"))
        for allow in (True, False)
    ]
    return both[0].unionByName(both[1])


FRESH_DAY = "1999-08-03"


def region_filter(spark, sf_dir):
    meta = F.create_map(F.lit("is_virtual"), F.when(F.col("seq") % 10 == 0, "true").otherwise("false"))
    rows = keys.with_missing_fields(b.postings(spark, sf_dir)).withColumn("meta", meta)
    out = flt.region_filter(rows, ("nation_1", "nation_7"))
    return out.select("seq", "location", F.col("is_bigtech").cast("int").alias("is_bigtech"))


def freshness_stats(spark, sf_dir):
    return source_freshness(b.postings(spark, sf_dir), b.FRESH_HOURS, False, b.AS_OF)


CASES = {
    "keyword_score": (keyword_score, f"with {SCORED} select seq, score, tier, array_to_string(hits, '|') as hits from scored"),
    "keyword_score_shipped_rules": (keyword_score_shipped, f"""with {TB}, {NORM}, {TOLD}, {scored_cte(KeywordRules(), "told")}
        select seq, score, tier, array_to_string(hits, '|') as hits from scored"""),
    "fit_gate": (fit_gate, f"with {GATED} {GATE_SELECT}"),
    "fit_gate_unknown_location": (fit_gate_no_location, f"""with {BASE}, some_place as (select * replace (case when seq % 3 <> 0 then location end as location) from keyed),
        {gate_cte(options=GateOptions(45, 20, 44, allow_unknown_location=True), source="some_place")} {GATE_SELECT}"""),
    "final_fit": (final_fit, f"with {GATED}, {final_fit_cte(False)} {FIT_SELECT}"),
    "final_fit_batch": (final_fit_batch, f"with {GATED}, {final_fit_cte(True)} {FIT_SELECT}"),
    "admission_status": (admission_status, f"""with {GATED}, {final_fit_cte(True)} select seq,
        case when admitted or llm_queued then 'inbox' else 'filtered' end as admission_status, cast(not admitted as int) as rejected_by_quality,
        case when llm_queued then 'pending' when llm_used then 'completed' else 'none' end as llm_review_state,
        llm_skipped_reason as llm_review_error from fitted"""),
    "reject_incomplete": (reject_incomplete, f"with {TB} select seq, case when seq % 8 = 0 then 'rejected' else 'kept' end as part from tb"),
    "freshness_filter": (freshness_filter, f"""with {TB} select seq, post_date, a as allow_unknown from tb, (values (0), (1)) v(a)
        where (post_date is null and a = 1) or post_date >= '{FRESH_DAY}'"""),
    "region_filter": (region_filter, f"""with {TB} select seq, location, 1 as is_bigtech from tb
        where lower(location) like '%nation_1%' or lower(location) like '%nation_7%' or seq % 10 = 0"""),
    "freshness_stats": (freshness_stats, f"""with {TB} select source, count(*) as raw_fetched, count(*) filter (post_date >= '{FRESH_DAY}') as kept_fresh,
        count(*) filter (post_date < '{FRESH_DAY}') as dropped_old, count(*) filter (post_date is null) as dropped_unknown_date from tb group by source"""),
}
