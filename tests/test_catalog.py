"""The registry: every operator is there, and a sample of queries equals its SQL on the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of
from vacantia.plans import catalog

SF = "/root/testdata/sf0.001"
EXPECTED = """scan_landed_payloads valid_json_responses resolve_targets first_success_endpoint stitch_pages normalize_greenhouse
normalize_lever normalize_ashby normalize_workday normalize_smartrecruiters normalize_workable normalize_recruitee normalize_bamboohr
normalize_jobvite normalize_amazon normalize_serpapi extract_jsonld_postings jsonld_location generate_search_queries query_location_grid
load_keyword_rules load_profile snapshot_roundtrip sync_outbox normalize_posting posting_keys strip_html_spaced strip_tags_tight cut_text
normalize_date relative_date relative_date_or_parse epoch_ms_day url_key fingerprint source_job_key payload_hash resolve_best_link join_parts
years_requirement count_substring count_word min_years_hit posted_at_granularity normalize_fit_payload fit_cache_key fit_request_rows
parse_json_list_safe truthy_coalesce event_payload_view list_projection keyword_score fit_gate final_fit admission_status reject_incomplete
freshness_filter region_filter filter_tier filter_status_default filter_llm_pending filter_source filter_bigtech filter_text filter_min_score
filter_seen_within filter_inbox filter_review_failed filter_active_batches match_existing join_fit_cache not_already_queued reconcile_results
provenance with_sync_errors attach_batch_id freshness_stats url_quality_stats search_stats run_totals run_totals_by_source quality_stats llm_stats
run_status run_warnings usage_in_window search_budget stage_counts list_total batch_outcome error_text latest_wins is_first_of_entity
llm_budget_cap latest_events_per_job run_progress llm_progress sort_postings page_of recent_runs take_budgeted_queries requeue_candidates
active_batches job_source_history union_sources distinct_queries target_aliases table_schemas evolve_schema backfill_keys upsert_postings
sticky_status append_lineage append_events set_status skip_company upsert_fit_cache apply_llm_results fail_batches submit_batch cleanup_inbox
requeue_failed finalize_run check_uniqueness ingest_manual run_detail stream_ingest stream_dedup late_rows usage_windows seen_state
stream_llm_results transform_hook source_registry review_answers dedup_components landed_postings""".split()
SAMPLE = ("top_postings", "normalize_lever", "normalize_page", "resolve_best_link", "final_fit_batch", "stage_counts", "provenance", "run_progress", "reconcile_results", "late_rows")


def test_every_operator_is_registered_with_sql():
    names, sql = entry.queries(), entry.oracle_sql()
    assert [n for n in EXPECTED if n not in names] == []
    assert [n for n in catalog.cases() if n not in sql] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())
