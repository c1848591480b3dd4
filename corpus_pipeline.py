"""The corpus pipeline: documents go through five stages, each written as Parquet and read by the next.

The stages set how many rows the session sends to a Python worker at once (``ARROW_ROWS``): whole texts in Spark's default of 10,000 rows fill tens of MB in the
executor and in the worker.

Defined results: a null or empty text has a quality score, is near nothing and holds no benchmark words; as it has no words, the mix does not take it. Rows
that are repeated in all columns, or share doc_id and text, become one by the near-duplicate stage. A null doc_id stays null and sorts first in the token
files. Extra columns are carried up to the mix, whatever their names. No documents give no rows; without labels every document is kept, without benchmark none is
contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from vacantia.llm import decontaminate, line_quality, minhash_dedup, source_mix, token_files
from vacantia.llm.common import cut_lineage, table

ARROW_ROWS = 1000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return line_quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return minhash_dedup.deduplicated(docs, size=5, percent=80, bands=24)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    path = token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    return token_files.token_table(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
