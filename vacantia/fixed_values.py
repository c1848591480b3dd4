"""Word lists, weights, limits and formats that decide results."""

from __future__ import annotations

# Characters that count as blank when text is trimmed or collapsed.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
BLANK_CLASS = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)

# Keyword rules: (keyword, weight) in the order in which hits are reported.
TIER_A_KEYWORDS = (
    ("junior", 20),
    ("entry level", 20),
    ("new grad", 20),
    ("0-2 years", 15),
    ("backend", 15),
    ("systems", 12),
    ("distributed", 12),
    ("database", 10),
    ("security", 10),
    ("infra", 8),
    ("c++", 10),
    ("concurrency", 8),
    ("performance", 8),
    ("linux", 6),
)
TIER_B_KEYWORDS = (
    ("software engineer", 6),
    ("full stack", 5),
    ("sde", 5),
    ("backend", 4),
    ("intern", 6),
    ("graduate", 6),
)
NEGATIVE_KEYWORDS = (
    ("qa", 10),
    ("test automation", 8),
    ("data pipeline", 8),
    ("etl", 8),
    ("contract", 6),
    ("senior", 50),
    ("lead", 50),
    ("staff", 50),
    ("principal", 50),
    ("manager", 40),
    ("5+ years", 40),
    ("8+ years", 50),
    ("10+ years", 60),
)
HARD_WORDS = ("senior", "lead", "staff", "principal", "manager")
FRESH_DAY_BONUS = 20
FRESH_WEEK_BONUS = 10
TITLE_BOOST = 2
MAX_KEYWORD_HITS = 5
HARD_WORD_PENALTY = 100

# Profile used where a list is missing or empty.
DEFAULT_TARGET_ROLES = (
    "software engineer", "backend engineer", "full stack engineer", "new grad", "entry level",
)
DEFAULT_LOCATION_PREFERENCES = ("toronto", "ontario", "canada", "remote")
DEFAULT_HARD_EXCLUSIONS = ("senior", "staff", "principal", "manager", "director")
DEFAULT_REMOTE_POLICY = "hybrid_or_remote"

# Gate points and thresholds.
ROLE_POINTS = 18
MUST_SKILL_POINTS = 12
NICE_SKILL_POINTS = 5
UNKNOWN_LOCATION_POINTS = 4
PREFERRED_LOCATION_POINTS = 10
MISMATCH_LOCATION_POINTS = -10
NO_ROLE_POINTS = -15
HARD_EXCLUSION_POINTS = -80
MIN_INBOX_SCORE = 55
BORDERLINE_MIN = 35
BORDERLINE_MAX = 54
REVIEW_ADMIT_THRESHOLD = 65
REVIEW_DAILY_CAP = 120
REVIEW_RUN_CAP = 30

# Search budget.
MONTHLY_QUERY_CAP = 250
BUDGET_RESERVE = 10
SEARCH_INTERVAL_MINUTES = 1440

# Statuses and states.
WORKFLOW_STATUSES = ("inbox", "approved", "skipped", "applied")
STICKY_STATUSES = ("approved", "applied", "skipped")
FIT_LABELS = ("high", "medium", "low")
ACTIVE_BATCH_STATUSES = ("validating", "in_progress", "finalizing", "submitted")
DEAD_BATCH_STATUSES = ("failed", "expired", "cancelled")
STAGE_STATUS = (
    ("inbox", "inbox"),
    ("pending_llm", "inbox"),
    ("approved", "approved"),
    ("applied", "applied"),
    ("archive", "skipped"),
    ("filtered", "filtered"),
)

# Words that keep a posting in the big-company run.
REGION_WORDS = ("toronto", "gta", "ontario", "canada", "remote", "hybrid")

# Page limits.
REVIEW_PAGE_SIZE = 50
REVIEW_PAGE_MAX = 200
RUN_LIST_SIZE = 20
RUN_LIST_MAX = 100
EVENTS_PER_POSTING = 100

# Date texts accepted besides ISO; the group holds the date, the format has one optional part per shape
# and a mark that only a matching text gets.
DATE_TEXT_PATTERN = (
    r"^(?:[A-Z][a-z]{2}, )?"
    r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}|[A-Z][a-z]{2,8} \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{4})"
    r"(?: GMT)?$"
)
DATE_TEXT_FORMAT = "[d MMM yyyy HH:mm:ss][MMMM d, yyyy][MMM d, yyyy][M/d/yyyy]' @'"

# Order of the sources within a run.
SOURCE_ORDER = (
    "greenhouse", "lever", "ashby", "workday", "smartrecruiters", "workable",
    "recruitee", "bamboohr", "jobvite", "serpapi",
)
BIG_COMPANY_SOURCE_ORDER = ("greenhouse", "lever", "amazon")

# Request texts of a batched review.
REVIEW_TASK = "Classify job fit for candidate profile"
REVIEW_RULES = "Return strict JSON only"
REVIEW_SYSTEM_TEXT = "You are a strict JSON classifier for job fit. Output JSON only."
REVIEW_OUTPUT_SCHEMA = (
    '{"fit_label":"high|medium|low","fit_score":"integer 0-100","confidence":"float 0-1",'
    '"reason_codes":["short_code"],"missing_must_have":["skill"]}'
)
REVIEW_ENDPOINT = "/v1/chat/completions"

# Sources that answer in pages: (path of the rows, rows of a full page).
PAGED_SOURCES = {
    "smartrecruiters": ("$.content", 100),
    "workday": ("$.jobPostings", 20),
}
