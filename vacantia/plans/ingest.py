"""Whole jobs: from landed payloads to the state tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from vacantia.config import GateOptions, KeywordRules, Profile
from vacantia.fixed_values import PAGED_SOURCES
from vacantia.functions.payloads import json_list
from vacantia.operators.filters import freshness_filter
from vacantia.operators.state import append_events, append_lineage, evaluate_postings, upsert_postings
from vacantia.session import cut_lineage
from vacantia.sources.adapters import ADAPTERS, normalize_page
from vacantia.sources.landing import classify_payloads, first_success_endpoint, stitch_pages

FRESHNESS_EXEMPT = ("greenhouse", "lever", "amazon")


def union_sources(frames: Sequence[DataFrame], order: Sequence[str] = ("batch_seq", "row")) -> DataFrame:
    """All source frames as one, with ``source_rank``: the order is source, then position in the source."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(frames)]
    out = ranked[0]
    for df in ranked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def landed_postings(payloads: DataFrame, source: str, as_of: datetime) -> DataFrame:
    """Postings of one source from everything that landed for it (``target``, ``slug``, ``priority`` and the
    response): per target the first usable JSON response, else the first HTML page with embedded postings. A source
    that answers in pages (``page`` from 0) gives its pages up to the first one that is not full.
    """
    marked = classify_payloads(payloads.filter(F.col("source") == source))
    if source in PAGED_SOURCES:
        path, page_size = PAGED_SOURCES[source]
        listed = json_list(F.try_parse_json("body"), path)
        sized = marked.withColumn("n_rows", F.coalesce(F.size(listed), F.lit(0)))
        return ADAPTERS[source](stitch_pages(sized, page_size), as_of)
    embedded = cut_lineage(normalize_page(marked.filter((F.col("kind") == "html") & F.col("usable")), source))
    counts = embedded.groupBy("target", "priority").agg(F.count("*").alias("n_postings"))
    counted = marked.join(counts, ["target", "priority"], "left").withColumn("n_postings", F.coalesce("n_postings", F.lit(0)))
    winners = first_success_endpoint(counted)
    from_json = ADAPTERS[source](winners.filter(F.col("kind") == "json"), as_of)
    chosen_pages = winners.filter(F.col("kind") == "html").select("target", "priority")
    from_pages = embedded.join(chosen_pages, ["target", "priority"], "left_semi")
    return from_json.drop("n_postings").unionByName(from_pages, allowMissingColumns=True)


@dataclass(frozen=True)
class IngestResult:
    queue: DataFrame
    outcome: DataFrame
    lineage: DataFrame
    events: DataFrame
    fetched: DataFrame


def fetch_sources(
    payloads: DataFrame, names: Sequence[str], as_of: datetime, hours: int | None = 24, allow_unknown: bool = False,
    transform: Callable[[DataFrame], DataFrame] | None = None, landed: bool = True,
) -> DataFrame:
    """Postings of the named sources in task order, stale ones dropped unless ``hours`` is None, then the caller's ``transform``.

    Failed, repeated and lower-priority responses are left out first; ``landed=False`` says that ``payloads`` are already
    the chosen ones.
    """
    frames = []
    for name in names:
        found = landed_postings(payloads, name, as_of) if landed else ADAPTERS[name](payloads.filter(F.col("source") == name), as_of)
        exempt = hours is None or name in FRESHNESS_EXEMPT
        frames.append(found if exempt else freshness_filter(found, hours, allow_unknown, as_of))
    united = union_sources(frames)
    return united.transform(transform) if transform else united


def ingest_run(
    queue: DataFrame, postings: DataFrame, rules: KeywordRules, profile: Profile, options: GateOptions, run_id: int,
    as_of: datetime, answers: DataFrame | None = None,
) -> IngestResult:
    """One run over postings with a unique ``seq``: next queue, outcome rows, lineage and events."""
    scored = evaluate_postings(postings, rules, profile, options, as_of, answers)
    following, outcome = upsert_postings(queue, scored, run_id, as_of)
    return IngestResult(
        following, outcome, append_lineage(outcome, run_id, as_of), append_events(outcome, run_id, as_of), postings.select("source")
    )
