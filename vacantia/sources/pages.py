"""Postings embedded in HTML pages as linked-data script blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.payloads import json_list, json_text, json_truthy
from vacantia.functions.text import col, join_parts
from vacantia.session import cut_lineage

BLOCK_PATTERN = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"

#: Nesting levels flattened in one plan.
LEVELS = 4


def _as_nodes(v: Column) -> Column:
    """One level of flattening: the array itself, the graph of an object, or the object alone."""
    return F.coalesce(json_list(v, "$"), json_list(v, "$['@graph']"), F.array(v))


def _is_list(v: Column) -> Column:
    """An array, or an object with a graph."""
    return F.coalesce(json_list(v, "$"), json_list(v, "$['@graph']")).isNotNull()


def _one_level(nodes: DataFrame, first: bool = False) -> DataFrame:
    """Every array and graph replaced by its elements, which add their position to the path; other nodes stay, but for the ``first`` level, whose nodes all
    have a position."""
    others = [c for c in nodes.columns if c not in ("posting", "node")]
    grows = F.lit(True) if first else _is_list(F.col("posting"))
    nodes = nodes.select(*others, F.col("node").alias("_path"), grows.alias("_grows"), F.posexplode(_as_nodes(F.col("posting"))).alias("_pos", "posting"))
    path = F.concat_ws(".", F.nullif(F.col("_path"), F.lit("")), F.lpad(F.col("_pos").cast("string"), 6, "0"))
    return nodes.withColumn("node", F.when(F.col("_grows"), path).otherwise(F.col("_path"))).drop("_path", "_pos", "_grows")


def extract_jsonld_postings(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per job posting node: the input columns, ``block``, ``node`` (path text) and ``posting``.

    Arrays and graphs are flattened ``LEVELS`` levels at a time in one plan, which is all that nearly every page has; what is deeper goes on in further
    rounds, until nothing is left.
    """
    blocks = pages.select(
        "*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(BLOCK_PATTERN), F.lit(1))).alias("block", "_raw")
    ).drop(html)
    open_nodes = _one_level(blocks.withColumn("posting", F.try_parse_json("_raw")).drop("_raw").withColumn("node", F.lit("")), first=True)
    settled: DataFrame | None = None
    while True:
        for _ in range(LEVELS - (settled is None)):
            open_nodes = _one_level(open_nodes)
        open_nodes = cut_lineage(open_nodes.withColumn("_more", _is_list(F.col("posting"))))
        done = open_nodes.filter(~F.col("_more")).drop("_more")
        settled = done if settled is None else settled.unionByName(done)
        open_nodes = open_nodes.filter("_more").drop("_more")
        if not open_nodes.limit(1).count():
            break
    nodes = settled
    types = F.coalesce(
        F.try_variant_get("posting", "$['@type']", "array<string>"),
        F.array(json_text(F.col("posting"), "$['@type']")),
    )
    names = F.concat(F.lit("\n"), F.lower(F.array_join(types, "\n")), F.lit("\n"))
    return nodes.filter(F.contains(names, F.lit("\njobposting\n")))


def jsonld_location(posting: Column | str) -> Column:
    """Locality, region and country of the first job location that has any of them."""
    v = col(posting)
    places = F.coalesce(json_list(v, "$.jobLocation"), F.array(F.try_variant_get(v, "$.jobLocation", "variant")))
    joined = F.transform(
        places,
        lambda p: join_parts(
            json_text(p, "$.address.addressLocality"),
            json_text(p, "$.address.addressRegion"),
            json_text(p, "$.address.addressCountry"),
        ),
    )
    return F.get(F.filter(joined, lambda x: x.isNotNull()), F.lit(0))


def jsonld_identifier(posting: Column | str) -> Column:
    return F.coalesce(json_truthy(col(posting), "$.identifier.value"), json_truthy(col(posting), "$.identifier"))
