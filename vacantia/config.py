"""Rules, profile and thresholds. They are small and become literals in the plan."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from vacantia import fixed_values as fv

Weights = tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class KeywordRules:
    tier_a: Weights = fv.TIER_A_KEYWORDS
    tier_b: Weights = fv.TIER_B_KEYWORDS
    negative: Weights = fv.NEGATIVE_KEYWORDS
    hard_words: tuple[str, ...] = fv.HARD_WORDS
    fresh_day: int = fv.FRESH_DAY_BONUS
    fresh_week: int = fv.FRESH_WEEK_BONUS
    title_boost: int = fv.TITLE_BOOST
    max_hits: int = fv.MAX_KEYWORD_HITS

    @property
    def boost(self) -> int:
        return self.title_boost or fv.TITLE_BOOST

    @property
    def hit_cap(self) -> int:
        return self.max_hits or fv.MAX_KEYWORD_HITS


def clean_list(values: Sequence[str] | None) -> tuple[str, ...]:
    cleaned = (str(v or "").strip().lower() for v in values or ())
    return tuple(v for v in cleaned if v)


@dataclass(frozen=True)
class Profile:
    target_roles: tuple[str, ...] = fv.DEFAULT_TARGET_ROLES
    must_have_skills: tuple[str, ...] = ()
    nice_to_have_skills: tuple[str, ...] = ()
    location_preferences: tuple[str, ...] = fv.DEFAULT_LOCATION_PREFERENCES
    remote_policy: str = fv.DEFAULT_REMOTE_POLICY
    hard_exclusions: tuple[str, ...] = fv.DEFAULT_HARD_EXCLUSIONS

    def to_json(self) -> str:
        """Compact JSON with the lists in their fixed order; the cache key hashes it."""
        fields = {
            "target_roles": list(self.target_roles),
            "must_have_skills": list(self.must_have_skills),
            "nice_to_have_skills": list(self.nice_to_have_skills),
            "location_preferences": list(self.location_preferences),
            "remote_policy": self.remote_policy,
            "hard_exclusions": list(self.hard_exclusions),
        }
        return json.dumps(fields, ensure_ascii=False, separators=(",", ":"))


def _at_least_one(value: int | None, default: int) -> int:
    """Zero and null mean the default; smaller values become one."""
    return max(1, int(value or default))


@dataclass(frozen=True)
class GateOptions:
    min_inbox_score: int = fv.MIN_INBOX_SCORE
    borderline_min: int = fv.BORDERLINE_MIN
    borderline_max: int = fv.BORDERLINE_MAX
    admit_threshold: int = fv.REVIEW_ADMIT_THRESHOLD
    allow_unknown_location: bool = False
    review_enabled: bool = False
    review_mode: str = "realtime"
    daily_cap: int = fv.REVIEW_DAILY_CAP
    run_cap: int = fv.REVIEW_RUN_CAP
    model: str = field(default="fit-classifier")

    @property
    def inbox_floor(self) -> int:
        return _at_least_one(self.min_inbox_score, fv.MIN_INBOX_SCORE)

    @property
    def borderline(self) -> tuple[int, int]:
        low = _at_least_one(self.borderline_min, fv.BORDERLINE_MIN)
        return low, max(low, int(self.borderline_max or fv.BORDERLINE_MAX))

    @property
    def admit_floor(self) -> int:
        return _at_least_one(self.admit_threshold, fv.REVIEW_ADMIT_THRESHOLD)

    @property
    def batch_mode(self) -> bool:
        return self.review_mode.lower() == "batch"
