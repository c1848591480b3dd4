"""Weighted keyword score of a posting."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.config import KeywordRules
from vacantia.fixed_values import HARD_WORD_PENALTY
from vacantia.functions.dates import epoch_seconds, posted_at_granularity
from vacantia.functions.keywords import MANY, rules_present
from vacantia.functions.text import compact_list, escape_pattern, has_free_word, sql_text
from vacantia.session import hold_filters


def _keyword_list(rules: KeywordRules) -> list[tuple[str, str, int]]:
    """(hit label, keyword, signed weight) in reporting order."""
    return (
        [("+A:", k, w) for k, w in rules.tier_a]
        + [("+B:", k, w) for k, w in rules.tier_b]
        + [("-:", k, -w) for k, w in rules.negative]
    )


def _count(keyword: str) -> str:
    word = keyword.lower()
    if not word:
        return "0"
    return f"if(contains(_text, {sql_text(word)}), (length(_text) - length(replace(_text, {sql_text(word)}, ''))) div {len(word)}, 0)"


def _score_many(lowered: DataFrame, keywords: list[tuple[str, str, int]], rules: KeywordRules, hard: str, now: float) -> DataFrame:
    """The same score from the keywords that one search finds."""
    present = rules_present(F.col("_text"), [(k.lower(), {"label": label, "keyword": k, "weight": w}) for label, k, w in keywords])

    def counted(r: Column) -> Column:
        word = F.lower(r["keyword"])
        removed = F.length("_text") - F.length(F.replace(F.col("_text"), word, F.lit("")))
        return F.struct(*[r[n].alias(n) for n in ("place", "label", "keyword", "weight")], F.floor(removed / F.length(word)).alias("n"))

    found = lowered.withColumns({"_present": present, "_hard": F.expr(hard), "_age": F.expr(f"({now} - unix_micros(_posted) / 1000000) / 3600")})
    found = found.withColumn("_found", F.transform("_present", counted))

    def points(r: Column) -> Column:
        boost = F.when(F.contains(F.col("_title"), r["keyword"]), r["weight"] * rules.boost).otherwise(0)
        return F.least(r["n"], F.lit(rules.hit_cap).cast("bigint")) * r["weight"] + boost

    fresh = F.expr(f"case when _age <= 24 then {rules.fresh_day} when _age <= 168 then {rules.fresh_week} else 0 end")
    penalty = F.when(F.col("_hard"), HARD_WORD_PENALTY).otherwise(0)
    marks = ["case when _age <= 24 then '+fresh:24h' when _age <= 168 then '+fresh:7d' end", "if(_hard, 'hard:senior', null)"]
    of_a = F.exists("_found", lambda r: r["place"] < len(rules.tier_a))
    scored = found.withColumns(
        {
            "score": (F.aggregate("_found", F.lit(0).cast("bigint"), lambda a, r: a + points(r)) + fresh - penalty).cast("bigint"),
            "tier": F.when(F.col("_hard"), "C").when(of_a, "A").otherwise("B"),
            "hits": F.concat(F.transform("_found", lambda r: F.concat(r["label"], r["keyword"], F.lit("x"), r["n"].cast("string"))), compact_list(marks)),
        }
    )
    return hold_filters(scored.drop("_text", "_title", "_posted", "_hard", "_age", "_present", "_found"))


def keyword_score(postings: DataFrame, rules: KeywordRules, as_of: datetime) -> DataFrame:
    """Add ``score``, ``tier`` and ordered ``hits``.

    The rules become literals. Text is lowered once and every keyword counted once, one column each, which
    the optimizer keeps apart from the next projection because each is read several times. All of it is one
    narrow stage of generated code. More than ``MANY`` keywords are searched in one pass, and only those found are counted.
    """
    keywords = _keyword_list(rules)
    words = "|".join(escape_pattern(w) for w in rules.hard_words)
    hard = f"rlike(_text, {sql_text(rf'(?<!\w)(?:{words})(?!\w)')})" if words else "false"
    if words and len(rules.hard_words) <= MANY:
        hard = has_free_word("_text", rules.hard_words)
    now = epoch_seconds(as_of)
    lowered = postings.withColumns(
        {
            "_text": F.lower(F.coalesce("jd_text", F.lit(""))),
            "_title": F.lower(F.coalesce("title", F.lit(""))),
            "_posted": posted_at_granularity("post_date")["ts"],
        }
    )
    if len(keywords) > MANY:
        return _score_many(lowered, keywords, rules, hard, now)
    counts = {f"_c{i}": F.expr(_count(k)) for i, (_, k, _) in enumerate(keywords)}
    counted = lowered.withColumns(
        {**counts, "_hard": F.expr(hard), "_age": F.expr(f"({now} - unix_micros(_posted) / 1000000) / 3600")}
    )
    points = [
        f"if(_c{i} > 0, least(_c{i}, {rules.hit_cap}) * {w} + if(contains(_title, {sql_text(k)}), {w * rules.boost}, 0), 0)"
        for i, (_, k, w) in enumerate(keywords)
    ]
    fresh = f"case when _age <= 24 then {rules.fresh_day} when _age <= 168 then {rules.fresh_week} else 0 end"
    penalty = f"if(_hard, {HARD_WORD_PENALTY}, 0)"
    any_a = " or ".join(f"_c{i} > 0" for i in range(len(rules.tier_a))) or "false"
    hits = [f"if(_c{i} > 0, concat({sql_text(label + k + 'x')}, _c{i}), null)" for i, (label, k, _) in enumerate(keywords)]
    hits += ["case when _age <= 24 then '+fresh:24h' when _age <= 168 then '+fresh:7d' end", "if(_hard, 'hard:senior', null)"]
    scored = counted.withColumns(
        {
            "score": F.expr(f"cast({' + '.join([*points, fresh])} - {penalty} as bigint)"),
            "tier": F.expr(f"case when _hard then 'C' when {any_a} then 'A' else 'B' end"),
            "hits": compact_list(hits),
        }
    )
    return hold_filters(scored.drop("_text", "_title", "_posted", "_hard", "_age", *counts))
