"""Link expressions. One pattern splits a link, so every engine sees the same host and path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacantia.functions.text import col

LINK_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)"
REDIRECT_PARAMS = ("q", "url", "adurl")


def link_host(link: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(link), LINK_PATTERN, 1))


def link_path(link: Column | str) -> Column:
    return F.regexp_extract(col(link), LINK_PATTERN, 2)


def path_segment(link: Column | str, n: int) -> Column:
    """The n-th (from 1) non-empty path segment, else null."""
    pattern = "^/*" + "[^/]+/+" * (n - 1) + "([^/]+)"
    return F.nullif(F.regexp_extract(link_path(link), pattern, 1), F.lit(""))


def url_key(link: Column | str) -> Column:
    host = F.nullif(F.regexp_replace(link_host(link), r"^www\.", ""), F.lit(""))
    path = F.nullif(F.regexp_replace(link_path(link), "/+$", ""), F.lit(""))
    return F.concat(host, path)


def is_search_engine(link: Column | str) -> Column:
    host = link_host(link)
    return F.coalesce(
        host.endswith("google.com") | host.endswith("google.ca") | host.endswith("google.co.uk")
        | F.contains(host, F.lit(".google.")),
        F.lit(False),
    )


def decode_redirect(link: Column | str) -> Column:
    """Target of a search-engine redirect when it is an outside http link, else null."""
    link = col(link)
    query = F.regexp_extract(link, r"^[^?#]*\?([^#]*)", 1)
    values = [
        F.nullif(F.try_url_decode(F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)), F.lit(""))
        for name in REDIRECT_PARAMS
    ]
    once = F.coalesce(*values)
    twice = F.when(F.contains(once, F.lit("%")), F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B")))).otherwise(once)
    outside = twice.rlike("(?i)^https?://") & ~is_search_engine(twice)
    return F.when(is_search_engine(link) & outside, twice)


def _best_in_list(links: Column, label: str) -> Column:
    usable = F.filter(links, lambda x: F.nullif(x, F.lit("")).isNotNull())
    direct = F.get(F.filter(usable, lambda x: ~is_search_engine(x)), F.lit(0))
    decoded = F.get(F.filter(F.transform(usable, decode_redirect), lambda x: x.isNotNull()), F.lit(0))
    url = F.coalesce(direct, decoded)
    return F.when(
        url.isNotNull(),
        F.struct(
            url.alias("url"),
            F.when(direct.isNotNull(), "direct").otherwise("decoded_redirect").alias("resolution"),
            F.lit(label).alias("source"),
        ),
    )


def resolve_best_link(apply_links: Column | str, related_links: Column | str, share_link: Column | str) -> Column:
    """Struct (url, resolution, source): apply links first, then related links, then the share link."""
    missing = F.struct(
        F.lit(None).cast("string").alias("url"), F.lit("unavailable").alias("resolution"), F.lit("none").alias("source")
    )
    return F.coalesce(
        _best_in_list(col(apply_links), "apply_options"),
        _best_in_list(col(related_links), "related_links"),
        _best_in_list(F.array(col(share_link)), "share_link"),
        missing,
    )
