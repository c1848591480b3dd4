"""Rules and profile documents as dimension rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacantia import fixed_values as fv
from vacantia.config import KeywordRules, Profile
from vacantia.functions.text import trim_blanks

RULE_SCHEMA = (
    "tiers struct<A:struct<keywords:map<string,int>>,B:struct<keywords:map<string,int>>>, negative map<string,int>, "
    "freshness struct<hours24:int,days7:int>, titleBoost int, maxKeywordHits int"
)
PROFILE_LISTS = ("target_roles", "must_have_skills", "nice_to_have_skills", "location_preferences", "hard_exclusions")
PROFILE_DEFAULTS = {
    "target_roles": fv.DEFAULT_TARGET_ROLES,
    "must_have_skills": (),
    "nice_to_have_skills": (),
    "location_preferences": fv.DEFAULT_LOCATION_PREFERENCES,
    "hard_exclusions": fv.DEFAULT_HARD_EXCLUSIONS,
}


def keyword_rows(documents: DataFrame, body: str = "body") -> DataFrame:
    """(…, class, position, keyword, weight) of rule documents, in document order."""
    parsed = documents.withColumn("_r", F.from_json(body, RULE_SCHEMA)).drop(body)
    keep = [c for c in parsed.columns if c != "_r"]
    classes = {"A": "_r.tiers.A.keywords", "B": "_r.tiers.B.keywords", "negative": "_r.negative"}
    def entries_of(name: str, path: str) -> Column:
        entries = F.coalesce(F.map_entries(F.col(path)), F.array().cast("array<struct<key:string,value:int>>"))
        return F.transform(
            entries,
            lambda e, i: F.struct(F.lit(name).alias("class"), i.alias("position"), e["key"].alias("keyword"), e["value"].alias("weight")),
        )

    entries = F.concat(*[entries_of(name, path) for name, path in classes.items()])
    return parsed.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.*")


def _clean(values: Column) -> Column:
    """Trimmed, lowercased, without blanks."""
    lowered = F.transform(values, lambda v: F.lower(trim_blanks(F.coalesce(v, F.lit("")))))
    return F.filter(lowered, lambda v: v != "")


def profile_rows(documents: DataFrame, body: str = "body") -> DataFrame:
    """Profile documents as cleaned list columns; empty role, place and exclusion lists get the defaults."""
    v = F.col("_v")
    parsed = documents.withColumn("_v", F.try_parse_json(body)).drop(body)
    columns: dict[str, Column] = {}
    for name in PROFILE_LISTS:
        values = _clean(F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>")))
        default = F.array(*[F.lit(d) for d in PROFILE_DEFAULTS[name]]).cast("array<string>")
        columns[name] = F.when(F.size(values) > 0, values).otherwise(default)
    policy = F.nullif(F.try_variant_get(v, "$.remote_policy", "string"), F.lit(""))
    columns["remote_policy"] = F.lower(F.coalesce(policy, F.lit(fv.DEFAULT_REMOTE_POLICY)))
    return parsed.withColumns(columns).drop("_v")


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("body"))


def load_keyword_rules(spark: SparkSession, path: str, hard_words: Sequence[str] = fv.HARD_WORDS) -> KeywordRules:
    """One rules file; it is configuration, so its few rows are read into the plan as literals."""
    document = _whole_files(spark, path)
    rows = keyword_rows(document).orderBy("class", "position").collect()
    bonus = document.select(F.from_json("body", RULE_SCHEMA).alias("r")).select(
        "r.freshness.hours24", "r.freshness.days7", "r.titleBoost", "r.maxKeywordHits"
    ).first()

    def of(name: str) -> tuple[tuple[str, int], ...]:
        return tuple((r["keyword"], r["weight"]) for r in rows if r["class"] == name)

    return KeywordRules(
        of("A"), of("B"), of("negative"), tuple(hard_words), bonus["hours24"] or 0, bonus["days7"] or 0,
        bonus["titleBoost"] or 0, bonus["maxKeywordHits"] or 0,
    )


def load_profile(spark: SparkSession, path: str) -> Profile:
    row = profile_rows(_whole_files(spark, path)).first()
    lists = {name: tuple(row[name]) for name in PROFILE_LISTS}
    return Profile(remote_policy=row["remote_policy"], **lists)
