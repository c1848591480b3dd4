"""Registry of the queries: name to (DataFrame function, SQL with the same result or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacantia.functions.keys import fingerprint, normalize_posting, posting_keys
from vacantia.operators.entities import latest_wins
from vacantia.operators.scoring import keyword_score
from vacantia.plans import bindings as b
from vacantia.plans.sql_text import SCORED

Case = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def top_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest posting of each fingerprint, the 20 best scores first."""
    rows = fingerprint(posting_keys(normalize_posting(b.postings(spark, sf_dir))))
    best = keyword_score(latest_wins(rows, "canonical_fingerprint"), b.RULES, b.AS_OF)
    return best.orderBy(F.desc("score"), F.desc_nulls_last("post_date"), F.asc("seq")).limit(20).select(
        "seq", "company", "title", "location", "post_date", "score", "tier", F.array_join("hits", "|").alias("hits")
    )


TOP_SQL = f"""with {SCORED}, last as (select canonical_fingerprint, max(seq) as seq from scored group by 1)
select seq, company, title, location, post_date, score, tier, array_to_string(hits, '|') as hits
from scored join last using (canonical_fingerprint, seq)
order by score desc, post_date desc nulls last, seq limit 20"""


def cases() -> dict[str, Case]:
    from vacantia.plans import (
        catalog_entities, catalog_fit, catalog_metrics, catalog_review, catalog_scoring, catalog_sources, catalog_streams,
        catalog_text,
    )

    out: dict[str, Case] = {"top_postings": (top_postings, TOP_SQL)}
    for module in (
        catalog_sources, catalog_text, catalog_scoring, catalog_review, catalog_entities, catalog_metrics, catalog_fit, catalog_streams,
    ):
        out.update(module.CASES)
    return {name: (_in_utc(fn), sql) for name, (fn, sql) in out.items()}


def _in_utc(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run
