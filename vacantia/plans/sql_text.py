"""SQL equivalents of the bindings and shared operators, for comparing results in another engine."""

from __future__ import annotations

from vacantia.config import GateOptions, KeywordRules, Profile
from vacantia.fixed_values import BLANK_CHARS, BLANK_CLASS
from vacantia.functions.text import escape_pattern
from vacantia.operators.gate import min_years_of
from vacantia.plans.bindings import AS_OF, OPTIONS, PROFILE, RULES

LINK = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"trim({x}, {quote(BLANK_CHARS)})"


def spaced(x: str) -> str:
    return trimmed(f"regexp_replace(regexp_replace(coalesce({x},''), '<[^>]*>', ' ', 'g'), '{BLANK_CLASS}+', ' ', 'g')")


def cut(x: str, n: int) -> str:
    return f"nullif(substr({x}, 1, {n}), '')"


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '{LINK}', 1))"


def link_key(x: str) -> str:
    h = f"nullif(regexp_replace({host(x)}, '^www\\.', ''), '')"
    p = f"nullif(regexp_replace(regexp_extract({x}, '{LINK}', 2), '/+$', ''), '')"
    return f"({h} || {p})"


def count_of(text: str, keyword: str) -> str:
    k = keyword.lower()
    return f"((length({text}) - length(replace({text}, {quote(k)}, ''))) // {len(k)})"


def word_in(text: str, keyword: str) -> str:
    return f"regexp_matches({text}, {quote(chr(92) + 'b' + escape_pattern(keyword.lower()) + chr(92) + 'b')})"


def excluded(text: str, keyword: str) -> str:
    years = min_years_of(keyword)
    if years is None:
        return word_in(text, keyword)
    pattern = rf"\b(\d{{1,2}})\s*\+?\s*(?:years?|yrs?)\b"
    return f"len(list_filter(regexp_extract_all({text}, '{pattern}', 1), lambda x: cast(x as int) >= {years})) > 0"


TB = """tb as (
  select d.doc_id as seq, d.source as company, p.p_name as title, n.n_name as location,
    case when d.doc_id % 11 = 0 then null else strftime(o.o_orderdate, '%Y-%m-%d') end as post_date,
    d.lang as source, case when d.doc_id % 5 = 0 then null else g.url end as url,
    concat(d.text, ' Needs ', cast(p.p_size as varchar), '+ years. ', p.p_name) as jd_text
  from documents d join part p on p.p_partkey = d.doc_id join nation n on n.n_nationkey = d.doc_id % 25
    join orders o on o.o_orderkey = d.doc_id join pages g on g.page_id = d.doc_id // 4)"""

NORM = f"""norm as (
  select seq, {trimmed("company")} as company, {trimmed("title")} as title, nullif({trimmed("location")}, '') as location,
    post_date, lower({trimmed("source")}) as source, nullif({trimmed("url")}, '') as url,
    nullif({trimmed("jd_text")}, '') as jd_text
  from tb)"""

KEYED = f"""keyed as (
  select *, lower({trimmed("company")}) as company_key, lower({trimmed("title")}) as title_key,
    lower({trimmed("coalesce(location,'')")}) as location_key, coalesce(post_date, '') as post_date_key,
    case when {link_key("url")} is not null then 'url:' || {link_key("url")}
      else 'composite:' || concat_ws('|', lower({trimmed("company")}), lower({trimmed("title")}),
        lower({trimmed("coalesce(location,'')")}), substr(coalesce(post_date,''), 1, 10)) end as canonical_fingerprint,
    case when {link_key("url")} is not null then 'url' else 'company+title+location+post_date' end as dedup_reason
  from norm)"""


def scored_cte(rules: KeywordRules = RULES, source: str = "keyed", name: str = "scored") -> str:
    text, title = "lower(coalesce(jd_text,''))", "lower(title)"
    listed = (
        [("+A:", k, w) for k, w in rules.tier_a] + [("+B:", k, w) for k, w in rules.tier_b] + [("-:", k, -w) for k, w in rules.negative]
    )
    counts = ", ".join(f"{count_of(text, k)} as c{i}" for i, (_, k, _) in enumerate(listed))
    points = " + ".join(
        f"case when c{i} > 0 then least(c{i}, {rules.hit_cap}) * ({w}) + case when contains({title}, {quote(k)}) then {w * rules.boost} else 0 end else 0 end"
        for i, (_, k, w) in enumerate(listed)
    )
    any_a = " or ".join(f"c{i} > 0" for i in range(len(rules.tier_a))) or "false"
    hits = ", ".join(f"case when c{i} > 0 then {quote(label + k + 'x')} || c{i} end" for i, (label, k, _) in enumerate(listed))
    hard = "|".join(rules.hard_words)
    at = AS_OF.strftime("%Y-%m-%d %H:%M:%S")
    return f"""{name} as (
  select * exclude (hit_list), list_filter(hit_list, lambda x: x is not null) as hits from (
   select *, cast({points} + case when age <= 24 then {rules.fresh_day} when age <= 168 then {rules.fresh_week} else 0 end
      - case when is_hard then 100 else 0 end as bigint) as score,
    case when is_hard then 'C' when {any_a} then 'A' else 'B' end as tier,
    [{hits}, case when age <= 24 then '+fresh:24h' when age <= 168 then '+fresh:7d' end, case when is_hard then 'hard:senior' end] as hit_list
   from (select *, {counts}, regexp_matches({text}, '\\b({hard})\\b') as is_hard,
      date_diff('second', try_cast(post_date as timestamp), timestamp '{at}') / 3600.0 as age from {source})))"""


def gate_cte(profile: Profile = PROFILE, options: GateOptions = OPTIONS, source: str = "scored", name: str = "gated") -> str:
    text, place = "lower(title || chr(10) || coalesce(jd_text,''))", "lower(coalesce(location,''))"
    words = (
        [("hard_exclusion", k) for k in profile.hard_exclusions] + [("role_match", k) for k in profile.target_roles]
        + [("must_skill", k) for k in profile.must_have_skills] + [("nice_skill", k) for k in profile.nice_to_have_skills]
    )
    tests = ", ".join(
        f"{excluded(text, k) if kind == 'hard_exclusion' else word_in(text, k)} as w{i}" for i, (kind, k) in enumerate(words)
    )
    points = {"role_match": 18, "must_skill": 12, "nice_skill": 5}

    def any_of(kind: str) -> str:
        return "(" + (" or ".join(f"w{i}" for i, (k, _) in enumerate(words) if k == kind) or "false") + ")"

    total = " + ".join(f"case when w{i} then {points[kind]} else 0 end" for i, (kind, _) in enumerate(words) if kind in points)
    preferred = "(" + " or ".join(f"contains({place}, {quote(p)})" for p in profile.location_preferences) + ")"
    unknown = f"({place} = '' and {str(options.allow_unknown_location).lower()})"
    codes = ", ".join(f"case when w{i} then {quote(kind + ':' + k)} end" for i, (kind, k) in enumerate(words))
    must = f"case when not {any_of('must_skill')} then 'must_skill:none' end" if profile.must_have_skills else "null"
    low, high = options.borderline
    floor = options.inbox_floor
    return f"""{name} as (
  select * exclude (raw, rejected, code_list), list_filter(code_list, lambda x: x is not null) as reason_codes,
    cast(case when rejected then greatest(0, raw - 80) when raw >= {floor} or raw between {low} and {high} then raw else greatest(0, raw) end as int) as fit_score,
    case when rejected then 'low' when raw >= {floor} then 'high' when raw between {low} and {high} then 'medium' else 'low' end as fit_label,
    'rules' as fit_source,
    case when rejected then 'filtered' when raw >= {floor} then 'high' when raw between {low} and {high} then 'borderline' else 'filtered' end as quality_bucket,
    (not rejected and raw >= {floor}) as admitted,
    (not rejected and raw < {floor} and raw between {low} and {high}) as needs_review
  from (select *, {any_of("hard_exclusion")} as rejected,
     {total} + case when {unknown} then 4 when {preferred} then 10 when {place} <> '' then -10 else 0 end
       + case when not {any_of("role_match")} then -15 else 0 end as raw,
     [{codes}, case when {unknown} then 'location:unknown_allowed' when {preferred} then 'location:preferred'
        when {place} <> '' then 'location:mismatch' end,
      case when not {any_of("role_match")} then 'role:no_match' end, {must}] as code_list
   from (select *, {tests} from {source})))"""


YEARS = f"(nullif(regexp_extract(lower(jd_text), '(\\d+){BLANK_CLASS}*\\+?{BLANK_CLASS}*years?', 1), '') || '+ years')"

QUEUE = f"""queue as (
  select 'j' || lpad(cast(seq as varchar), 12, '0') as id, seq, company, title, location, post_date, source, url, jd_text, score, tier,
    ['inbox','approved','skipped','applied','filtered','inbox'][(seq % 6) + 1] as status,
    timestamp '2001-01-01' + to_minutes(seq) as created_at, timestamp '2001-01-01' + to_minutes(seq) as updated_at,
    company_key, title_key, location_key, post_date_key, hits, {YEARS} as years_req, seq % 4 = 0 as is_bigtech,
    canonical_fingerprint, timestamp '2001-01-01' + to_minutes(seq) as first_seen_at,
    timestamp '2001-07-01' + to_minutes(seq * 40) as last_seen_at, seq % 9 as last_run_id, cast(null as varchar) as dedup_reason_unused,
    dedup_reason, fit_score, fit_label, fit_source, reason_codes as fit_reason_codes, quality_bucket,
    not admitted as rejected_by_quality,
    case when seq % 6 = 5 then 'pending' when seq % 6 = 4 then 'failed' when seq % 6 <> 3 then 'none' end as llm_review_state,
    case when seq % 6 = 5 then 'b' || cast(seq % 7 as varchar) end as llm_pending_batch_id
  from gated)"""

EVENT_ROWS = """event_rows as (
  select event_id as id, 'j' || lpad(cast(user_id as varchar), 12, '0') as job_id, user_id as run_id,
    case when event_type = 'error' then 'sync_failed' else event_type end as event_type, 'seen ' || event_type as message,
    case when event_id % 7 = 0 then substr(props, 1, 3) else props end as payload_json, ts as created_at from events)"""

BASE = ",\n".join([TB, NORM, KEYED])
SCORED = BASE + ",\n" + scored_cte()
GATED = SCORED + ",\n" + gate_cte()
QUEUED = GATED + ",\n" + QUEUE


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def event_id(kind: str, *parts: object) -> str:
    """SQL of an event's id at the fixed time of the queries (2001-08-02 UTC)."""
    told = ", ".join(f"coalesce(cast({p} as varchar), '')" for p in parts)
    return f"('0x' || substr(sha1(concat_ws('|', '996710400', {kind}, {told})), 1, 15))::bigint"
