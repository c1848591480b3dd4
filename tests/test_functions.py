"""Column expressions against literal cases."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from vacantia.functions import dates, keys, links, payloads, text

NOW = datetime(2026, 2, 9, 20, tzinfo=timezone.utc)


def one(spark, rows, expr, kind="v string"):
    df = spark.createDataFrame([(r,) for r in rows], kind)
    return [r[0] for r in df.select(expr).collect()]


def test_years_requirement_takes_the_last_number_of_a_range(spark):
    rows = ["Needs 2-4 years", "3+ years of", "5years", "no number", None, "10 + year"]
    assert one(spark, rows, text.years_requirement("v")) == ["4+ years", "3+ years", "5+ years", None, None, "10+ years"]


@pytest.mark.parametrize("k,hits", [(8, [True, False, True, False]), (5, [True, True, True, False]), (12, [False, False, False, False])])
def test_min_years_hit(spark, k, hits):
    rows = ["at least 9 years", "5 yrs", "10+ years", "100 years"]
    assert one(spark, rows, text.min_years_hit("v", k)) == hits


@pytest.mark.parametrize("k", range(0, 101))
def test_at_least_pattern_covers_exactly_the_larger_numbers(k):
    import re

    pattern = re.compile(text.at_least_pattern(k))
    found = {s for n in range(100) for s in {str(n), f"{n:02d}"} if pattern.fullmatch(s)}
    assert found == {s for n in range(100) for s in {str(n), f"{n:02d}"} if n >= k}


def test_count_word_uses_ascii_boundaries(spark):
    rows = ["node énode node.js", "c++ developer", "c++x"]
    assert one(spark, rows, text.count_word("v", "node")) == [3, 0, 0]
    assert one(spark, rows, text.count_word("v", "c++")) == [0, 0, 1]


def test_count_substring_does_not_overlap(spark):
    assert one(spark, ["aaaa", "Leading LEAD", None], text.count_substring("v", "aa")) == [2, 0, 0]
    assert one(spark, ["aaaa", "Leading LEAD", None], text.count_substring("v", "lead")) == [0, 2, 0]


def test_strip_and_trim(spark):
    assert one(spark, ["<p>a</p>\n <b>b</b> "], text.strip_html_spaced("v")) == ["a b"]
    assert one(spark, ["<p>a</p><b>b</b>"], text.strip_tags_tight("v")) == ["ab"]
    assert one(spark, [" \t x﻿"], text.trim_blanks("v")) == ["x"]
    assert one(spark, ["", None, "abc"], text.cut_text("v", 2)) == [None, None, "ab"]


def test_compact_list_keeps_order_and_repeats(spark):
    row = spark.range(1).select(text.compact_list(["'b'", "null", "'a'", "'b'"]).alias("x"), text.compact_list(["null"]).alias("y")).first()
    assert row["x"] == ["b", "a", "b"] and row["y"] == []


def test_normalize_date(spark):
    rows = ["2026-02-01T10:00:00Z", "2026-99-99", "March 5, 2026", "Tue, 3 Feb 2026 08:00:00 GMT", "2/14/2026", "soon", "", None]
    assert one(spark, rows, dates.normalize_date("v")) == ["2026-02-01", "2026-99-99", "2026-03-05", "2026-02-03", "2026-02-14", None, None, None]


def test_relative_date(spark):
    rows = ["2026-02-01", "Today", "yesterday", "3 days ago", "1 month ago", "0 days ago", "30+ whenever", "", None, "99999999999999999999 years ago"]
    expected = ["2026-02-01", "2026-02-09", "2026-02-08", "2026-02-06", "2026-01-10", None, None, None, None, None]
    assert one(spark, rows, dates.relative_date("v", NOW)) == expected
    assert one(spark, ["Feb 3, 2026", "2 weeks ago"], dates.relative_date_or_parse("v", NOW)) == ["2026-02-03", "2026-01-26"]


def test_epoch_ms_day(spark):
    assert one(spark, [1769904000000, 0, None], dates.epoch_ms_day("v"), "v bigint") == ["2026-02-01", None, None]


def test_url_key(spark):
    rows = [
        "https://www.example.com/jobs/123?utm_source=test", "https://Example.com:8443/Jobs/1///", "https://example.com/", "https://example.com",
        "not a link", None, "https://user@www.example.com/a b#c",
    ]
    assert one(spark, rows, links.url_key("v")) == ["example.com/jobs/123", "example.com/Jobs/1", None, None, None, None, "example.com/a b"]


LINK_CASES = [
    ((["https://www.google.com/search?q=job", "https://jobs.example.com/role/123"], [], None), ("https://jobs.example.com/role/123", "direct", "apply_options")),
    (([], ["https://www.google.com/url?q=https%3A%2F%2Fcareers.example.com%2Fjobs%2F789&sa=D"], None), ("https://careers.example.com/jobs/789", "decoded_redirect", "related_links")),
    ((["https://www.google.com/search?q=test"], ["https://www.google.ca/search?q=test2"], "https://www.google.com/jobs/results/abc"), (None, "unavailable", "none")),
    ((["https://www.google.ca/apply?id=123", "https://company.ca/jobs/1"], [], None), ("https://company.ca/jobs/1", "direct", "apply_options")),
    (([], ["https://company.com/careers/2"], None), ("https://company.com/careers/2", "direct", "related_links")),
    (([None, ""], [], "https://www.google.com/url?q=https%253A%252F%252Fa.example.com%252Fx%252By"), ("https://a.example.com/x+y", "decoded_redirect", "share_link")),
    ((["https://www.google.com/url?q=https%3A%2F%2Fwww.google.com%2Fx"], [], "mailto"), ("mailto", "direct", "share_link")),
]


@pytest.mark.parametrize("case,expected", LINK_CASES)
def test_resolve_best_link(spark, case, expected):
    df = spark.createDataFrame([case], "a array<string>, r array<string>, s string")
    best = df.select(links.resolve_best_link("a", "r", "s").alias("b")).select("b.*").first()
    assert tuple(best) == expected


def test_fingerprint(spark):
    rows = [("Acme", "Software Engineer", "Toronto", "2026-02-01", "https://www.example.com/jobs/123?utm_source=test"), ("Acme", "Software Engineer", "Toronto", "2026-02-01", None)]
    df = spark.createDataFrame(rows, "company string, title string, location string, post_date string, url string")
    out = keys.fingerprint(keys.normalize_posting(df)).select("canonical_fingerprint").collect()
    assert [r[0] for r in out] == ["url:example.com/jobs/123", "composite:acme|software engineer|toronto|2026-02-01"]


def test_payload_hash_is_the_digest_of_compact_json(spark):
    import hashlib
    import json

    df = spark.createDataFrame([("Acme", 'Eng "x"\n', "Zürich/CH", None, "https://e.com/a", None)], "company string, title string, location string, post_date string, url string, source string")
    got = keys.payload_hash(keys.normalize_posting(df)).first()["payload_hash"]
    body = {"company": "Acme", "title": 'Eng "x"', "location": "Zürich/CH", "post_date": None, "source": "unknown", "url": "https://e.com/a", "jd_text": None, "is_bigtech": False, "meta": None}
    assert got == hashlib.sha1(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_normalize_fit_payload(spark):
    rows = ['{"fit_label":"HIGH","fit_score":"87.9","confidence":"0.7","reason_codes":["a",1]}', '{"fit_label":"great","fit_score":900,"confidence":7}', "broken", '{"fit_score":"12abc","confidence":"x","reason_codes":"a"}']
    out = one(spark, rows, payloads.normalize_fit_payload("v"))
    assert [(r["fit_label"], r["fit_score"], r["confidence"], r["reason_codes"]) for r in out] == [
        ("high", 87, 0.7, ["a", "1"]), ("low", 100, 1.0, []), ("low", 0, 0.0, []), ("low", 12, 0.0, []),
    ]


def test_join_parts(spark):
    df = spark.createDataFrame([("a", "", "c"), ("", None, None)], "x string, y string, z string")
    assert [r[0] for r in df.select(text.join_parts("x", "y", "z", fallback=F.lit("remote"))).collect()] == ["a, c", "remote"]


def test_words_are_found_before_their_boundaries_are_looked_at(spark):
    """The patterns begin with the word, which the engine finds fast, and find what boundaries in front find."""
    words = ["ring", "c++", "+x", "a.b", "r", "naïve"]
    texts = ["", "ring", "a ring.", "rings", "string", "ring ring", "ringring ring", "c++", "c++x", "xc++ ", "y+x", "y+xz", "y+x c++a", "a.b", "axb", "_ring", "éring", "ringé", "naïve", "r r_r", "1r 2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for word in words:
        pattern = text.word_pattern(word)
        assert pattern.startswith(text.escape_pattern(word))
        is_word = [ch.isascii() and (ch.isalnum() or ch == "_") for ch in word]
        plain = (r"(?<!\w)" if is_word[0] else r"(?<=\w)") + text.escape_pattern(word) + (r"(?!\w)" if is_word[-1] else r"(?=\w)")
        found = rows.select(F.regexp_count("t", F.lit(pattern)).alias("new"), F.regexp_count("t", F.lit(plain)).alias("old"))
        assert [r["new"] for r in found.collect()] == [r["old"] for r in found.collect()]
    free = ["ring", "c++", ""]
    for chosen in (free, free[:2], free[:1]):
        plain = r"(?<!\w)(?:" + "|".join(text.escape_pattern(w) for w in chosen) + r")(?!\w)"
        found = rows.select(F.expr(text.has_free_word("t", chosen)).alias("new"), F.col("t").rlike(plain).alias("old"))
        assert all(r["new"] == r["old"] for r in found.collect())
    years = rows.select(F.lit("x40 years, 07 yrs, 39+ years, 4 0 years 140 years").alias("t")).limit(1)
    assert [years.select(text.min_years_hit("t", k).alias("h")).first()["h"] for k in (0, 7, 39, 40, 100)] == [True, True, True, False, False]
