from __future__ import annotations

from datetime import datetime, timezone

import pytest

from vacantia.config import GateOptions, KeywordRules, Profile
from vacantia.operators import filters, gate
from vacantia.operators.metrics import freshness_stats, remaining_run_slots, search_budget
from vacantia.operators.scoring import keyword_score
from vacantia.sources import adapters as ad, landing

NOW = datetime(2026, 2, 9, 20, tzinfo=timezone.utc)
PROFILE = Profile(
    target_roles=("software engineer", "backend engineer", "new grad"), must_have_skills=("node", "sql"), nice_to_have_skills=("react",),
    location_preferences=("toronto", "canada", "remote"), hard_exclusions=("senior", "staff", "principal", "manager"),
)
POSTING = "title string, location string, jd_text string"


def fit(spark, posting, options=GateOptions(), profile=PROFILE):
    return gate.fit_gate(spark.createDataFrame([posting], POSTING), profile, options).first()


def test_senior_role_is_filtered(spark):
    r = fit(spark, ("Senior Software Engineer", "Toronto, ON, Canada", "We need a senior engineer with 8+ years experience"))
    assert (r["admitted"], r["quality_bucket"], r["fit_label"]) == (False, "filtered", "low")


def test_strong_entry_level_match_is_admitted(spark):
    r = fit(spark, ("Backend Software Engineer, New Grad", "Toronto, ON, Canada", "Looking for new grad backend engineer with node and sql skills"))
    assert (r["admitted"], r["fit_label"], r["fit_score"]) == (True, "high", 88)


def test_borderline_needs_review(spark):
    r = fit(spark, ("Software Engineer", "Canada", "Software engineer role working on Node APIs with collaborative product teams"), GateOptions(70, 30, 69))
    assert (r["quality_bucket"], r["needs_review"]) == ("borderline", True)


def test_missing_must_skill_is_only_a_code(spark):
    r = fit(spark, ("Software Engineer", "Toronto, ON, Canada", "Software engineer role building APIs and internal tools"), GateOptions(70, 20, 69))
    assert r["quality_bucket"] == "borderline" and "must_skill:none" in r["reason_codes"]


def test_years_exclusion_matches_larger_numbers(spark):
    profile = Profile(PROFILE.target_roles, PROFILE.must_have_skills, PROFILE.nice_to_have_skills, PROFILE.location_preferences, hard_exclusions=(*PROFILE.hard_exclusions, "8+ years"))
    r = fit(spark, ("Software Engineer", "Toronto, ON, Canada", "Candidates need at least 9 years of experience building distributed systems"), profile=profile)
    assert r["quality_bucket"] == "filtered" and "hard_exclusion:8+ years" in r["reason_codes"] and r["fit_score"] == 0


def test_zero_settings_mean_the_default():
    assert GateOptions(0, 0, 0).inbox_floor == 55 and GateOptions(0, 0, 0).borderline == (35, 54)


def test_review_off_keeps_the_rules_and_says_why(spark):
    gated = gate.fit_gate(spark.createDataFrame([("Software Engineer", "Canada", "Software engineer with node")], POSTING), PROFILE, GateOptions(70, 30, 69))
    r = gate.admission_status(gate.final_fit(gate.without_answers(gated, "disabled_or_missing_key"), GateOptions())).first()
    assert r["llm_eligible"] and r["llm_attempted"] and not r["llm_used"]
    assert r["reason_codes"][-1] == "llm_skipped:disabled_or_missing_key" and r["admission_status"] == "filtered"


def test_batch_mode_without_key_is_not_queued(spark):
    gated = gate.fit_gate(spark.createDataFrame([("Software Engineer", "Canada", "Software engineer with node")], POSTING), PROFILE, GateOptions(70, 30, 69))
    r = gate.final_fit(gate.without_answers(gated, "disabled_or_missing_key"), GateOptions(review_mode="batch")).first()
    assert not r["llm_queued"] and r["llm_skipped_reason"] == "disabled_or_missing_key" and r["quality_bucket"] == "borderline"


SCORE_CASES = [
    (("Junior dev", "junior junior role", "2026-02-09"), 20 * 2 + 40 + 20, "A", ["+A:juniorx2", "+fresh:24h"]),
    (("Lead", "leading teams", "2026-02-04"), -(50 + 100) + 10, "B", ["-:leadx1", "+fresh:7d"]),
    (("x", "a lead", "2020-01-01"), -50 - 100, "C", ["-:leadx1", "hard:senior"]),
    (("x", "backend", None), 15 + 4, "A", ["+A:backendx1", "+B:backendx1"]),
    (("x", "c++ " * 9, "someday"), 50, "A", ["+A:c++x9"]),
]


@pytest.mark.parametrize("posting,score,tier,hits", SCORE_CASES)
def test_keyword_score(spark, posting, score, tier, hits):
    r = keyword_score(spark.createDataFrame([posting], "title string, jd_text string, post_date string"), KeywordRules(), NOW).first()
    assert (r["score"], r["tier"], r["hits"]) == (score, tier, hits)


def test_freshness(spark):
    df = spark.createDataFrame([("s", "2026-02-09"), ("s", "2026-02-01"), ("s", None), ("s", "2026-02-08"), ("s", "2026-02-07")], "source string, post_date string")
    r = freshness_stats(df, 24, False, NOW).first()
    assert (r["raw_fetched"], r["kept_fresh"], r["dropped_old"], r["dropped_unknown_date"]) == (5, 2, 2, 1)
    assert {x["post_date"] for x in filters.freshness_filter(df, 24, True, NOW).collect()} == {"2026-02-09", "2026-02-08", None}


def test_exact_times_are_compared_exactly(spark):
    df = spark.createDataFrame([("2026-02-08T19:59:59Z",), ("2026-02-08T20:00:00Z",), ("garbage",)], "post_date string")
    assert [r[0] for r in df.select(filters.freshness_class(24, False, NOW)).collect()] == ["old", "kept", "old"]


def test_budget(spark):
    usage = spark.createDataFrame([(50, datetime(2026, 2, 1)), (900, datetime(2026, 1, 31, 23))], "queries_used bigint, created_at timestamp")
    r = search_budget(usage, datetime(2026, 2, 10, tzinfo=timezone.utc), 250, 0, 1440).first()
    assert (r["used_this_month"], r["reserve"], r["remaining_run_slots"], r["per_run_limit"]) == (50, 10, 19, 10)
    assert remaining_run_slots(datetime(2026, 2, 28, 23, 59, tzinfo=timezone.utc)) == 1


TARGETS = [
    ("greenhouse", "https://boards.greenhouse.io/Some-Co/jobs", "Some-Co", None), ("lever", "https://jobs.lever.co/Some-Co", "Some-Co", None),
    ("ashby", "notion", "notion", None), ("ashby", "https://jobs.ashbyhq.com/notion", "notion", None),
    ("workday", "https://nvidia.wd5.myworkdayjobs.com/en-US/NVIDIAExternalCareerSite", "nvidia", "https://nvidia.wd5.myworkdayjobs.com/wday/cxs/nvidia/NVIDIAExternalCareerSite/jobs"),
    ("smartrecruiters", "https://jobs.smartrecruiters.com/Stripe", "Stripe", None), ("workable", "https://apply.workable.com/notion/", "notion", None),
    ("recruitee", "https://acme.recruitee.com/", "acme", None), ("bamboohr", "https://acme.bamboohr.com/careers", "acme", None),
    ("jobvite", "https://jobs.jobvite.com/acme/jobs", "acme", None), ("ashby", "https://other.com/notion", None, None), ("workday", "nonsense", None, None),
]


@pytest.mark.parametrize("source,target,slug,api", TARGETS)
def test_targets(spark, source, target, slug, api):
    r = landing.resolve_targets(spark.createDataFrame([(source, target)], "source string, target string")).first()
    assert r["slug"] == slug
    if api:
        assert r["api_url"] == api


def test_team_payload_flattens(spark):
    body = '{"data":{"jobBoardWithTeams":{"teams":[{"jobs":[{"id":"1","title":"Software Engineer"}]},{"jobs":[{"id":"2","title":"Backend Engineer"}]},{}]}}}'
    df = spark.createDataFrame([("ashby", "notion", body), ("ashby", "none", "{}"), ("ashby", "bad", "{")], "source string, slug string, body string")
    assert sorted(r["title"] for r in ad.normalize_ashby(df, NOW).collect()) == ["Backend Engineer", "Software Engineer"]


def test_falsy_payload_fields_fall_through(spark):
    body = '[{"id":0,"title":"T","city":"","location":"Here","country":false,"created_at":0,"published_at":"2026-02-01T01:00:00Z","url":""}]'
    r = ad.normalize_recruitee(spark.createDataFrame([("recruitee", "acme", body)], "source string, slug string, body string"), NOW).first()
    assert (r["location"], r["post_date"], r["url"], r["meta"]["recruitee_id"]) == ("Here", "2026-02-01", None, None)


def many_words(n, seed):
    """Random words over few letters, so that they overlap, begin one another and repeat themselves; some with marks, blanks and capitals."""
    import random

    random_ = random.Random(seed)
    words = {"".join(random_.choice("ab+ .A") for _ in range(random_.randrange(1, 6))).strip() for _ in range(n)}
    return sorted(w for w in words if w) + ["c++", ".net", "node", "node.js", "aa", "aba", "é", "don't", "\\d", "a|b", "x'y"]


def scored_both_ways(spark, monkeypatch, rows, schema, work, module):
    df = spark.createDataFrame(rows, schema)
    out = []
    for many in (0, 10**9):
        monkeypatch.setattr(module, "MANY", many)
        out.append([tuple(r) for r in work(df).collect()])
    return out


def texts(words, n=60):
    import random

    random_ = random.Random(5)
    return [" ".join(random_.choice(words) + random_.choice(["", ",", "a", "B", " 9 years", " 3+ yrs"]) for _ in range(random_.randrange(0, 30))) for _ in range(n)] + [None, "", "aaaaa abababa"]


def test_many_keywords_in_one_pass_score_the_same(spark, monkeypatch):
    from vacantia.operators import scoring

    words = many_words(400, 1)
    rules = KeywordRules(tuple((w, i % 7) for i, w in enumerate(words[:150])), tuple((w, 2) for w in words[100:]), (("aa", 3), ("", 5), *((w, 1) for w in words[::9])))
    rows = [(t[:40] if t else None, t, d) for t, d in zip(texts(words), ["2026-02-09", None, "2026-02-04"] * 30)]
    a, b = scored_both_ways(spark, monkeypatch, rows, "title string, jd_text string, post_date string", lambda df: keyword_score(df, rules, NOW), scoring)
    assert a == b and any(len(r[-1]) > 20 for r in a)


def test_many_profile_entries_in_one_pass_gate_the_same(spark, monkeypatch):
    words = many_words(400, 2)
    profile = Profile(tuple(words[:90]), tuple(words[60:200]), tuple(words[150:]), ("toronto",), hard_exclusions=("9+ years", "aab", "3+ years", "node.js", "3+ yrs"))
    rows = [(t[:30] if t else None, p, t) for t, p in zip(texts(words), ["Toronto", "", "Ottawa", None] * 20)]
    a, b = scored_both_ways(spark, monkeypatch, rows, POSTING, lambda df: gate.fit_gate(df, profile, GateOptions()), gate)
    assert a == b and any("hard_exclusion:3+ yrs" in str(r) for r in a)


def test_two_thousand_rules_plan_and_run(spark):
    rules = KeywordRules(tuple((f"word{i}", 1) for i in range(2000)), (), ())
    profile = Profile(tuple(f"word{i}" for i in range(2000)), (), (), ("toronto",), hard_exclusions=())
    df = spark.createDataFrame([("t", "Toronto", "word7 word77 word777 word1999", None)] * 50, POSTING + ", post_date string")
    r = gate.fit_gate(keyword_score(df, rules, NOW), profile, GateOptions()).first()
    assert r["hits"] == ["+A:word1x1", "+A:word7x3", "+A:word19x1", "+A:word77x2", "+A:word199x1", "+A:word777x1", "+A:word1999x1"] and r["score"] == 10
    assert r["reason_codes"][:4] == ["role_match:word7", "role_match:word77", "role_match:word777", "role_match:word1999"]
