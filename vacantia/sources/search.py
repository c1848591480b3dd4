"""Search queries: generation, explicit plus generated lists, location grid, budgeted head."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.text import col, trim_blanks


def generate_search_queries(
    base: DataFrame, locations: Sequence[str] = (), levels: Sequence[str] = (), flags: Sequence[str] = (),
    negatives: Sequence[str] = (),
) -> DataFrame:
    """(seq, loc_seq, query) for base (seq, query) at every configured location; blank parts are skipped."""
    grid = query_location_grid(base, locations)
    level_text = " ".join(levels)
    flag_text = " ".join(f for f in flags if f)
    negative_text = " ".join(f"-{n}" for n in negatives)
    parts = [F.col("query"), F.lit(level_text), F.col("location"), F.lit(flag_text), F.lit(negative_text)]
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return grid.select("seq", "loc_seq", trim_blanks(joined).alias("query"))


def query_location_grid(queries: DataFrame, locations: Sequence[str]) -> DataFrame:
    """Every query (seq, query) at every configured location, one blank standing for an empty list.

    The locations are configuration, so they are literals and the product is a narrow explode.
    """
    places = F.array(*[F.lit(place) for place in (locations or ("",))])
    nothing = queries.agg(F.count("*").alias("_n")).filter("_n = 0")
    blank = nothing.select(F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("query"))
    asked = queries.select(F.col("seq").cast("bigint").alias("seq"), "query").unionByName(blank)
    return asked.select("seq", "query", F.posexplode(places).alias("loc_seq", "location"))


def distinct_queries(explicit: DataFrame, generated: DataFrame) -> DataFrame:
    """Explicit then generated queries, trimmed, blanks dropped, first occurrence kept."""
    both = explicit.select(F.struct(F.lit(0).alias("list"), F.col("seq").cast("bigint").alias("seq")).alias("at"), "query").unionByName(
        generated.select(F.struct(F.lit(1).alias("list"), F.col("seq").cast("bigint").alias("seq")).alias("at"), "query")
    )
    trimmed = both.withColumn("query", trim_blanks("query")).filter(F.col("query") != "")
    return trimmed.groupBy("query").agg(F.min("at").alias("at")).select("query", "at.list", "at.seq")


def target_aliases(slug: Column | str) -> Column:
    """The slug and the slug without hyphens."""
    slug = col(slug)
    return F.filter(F.array_distinct(F.array(slug, F.replace(slug, F.lit("-"), F.lit("")))), lambda s: s != "")


def take_budgeted_queries(queries: DataFrame, k: int, *order: str) -> DataFrame:
    return queries.orderBy(*(order or ("seq",))).limit(k)
