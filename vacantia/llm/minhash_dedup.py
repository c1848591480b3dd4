"""Near-dedup by min-max hashing.

Each text becomes the set of its distinct word shingles. One random permutation gives two signature values, the
minimum and the maximum over the set, so ``2 * permutations`` values cost ``permutations`` hash evaluations. A band takes both values of
two permutations. At similarity 0.85 a band agrees with probability 0.52, and a pair misses all 20 bands with less than 10^-6.

Texts with equal sets form one class first, so copies cost nothing further. Classes that share a band are compared on full sets
(48 bits of each shingle's hash), as ``similar`` describes, and components are taken over all links.

Defined results: null, empty or blank text has no shingles and is linked with nothing; copies with one doc_id are one class; a null
doc_id takes the smallest known doc_id of its component, or stays null; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacantia.llm import similar
from vacantia.llm.common import cut_lineage, free_name, lean, likely, slices, small_batches
from vacantia.llm.shingles import shingle_sets
from vacantia.operators.skew import lookup_join

SHINGLE = 3
#: A link: 100 * intersection >= 85 * union.
PERCENT = 85
BANDS = 20


def signatures(documents: DataFrame, size: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, node, bands) for each row; node names the class of equal sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            counts, nodes, hashes = [], [], []
            for values in shingle_sets(batch.column(1).to_pylist(), size):
                counts.append(len(values))
                nodes.append(similar.class_of(values))
                hashes.append(similar.band_hashes(values, bands) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.string()), pa.array(hashes, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "node", "bands"],
            )

    rows = documents.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(lean(sign), "doc_id bigint, n_shingles bigint, node string, bands array<bigint>")


def node_of(size: int):
    """Column function: the class of a text."""

    @F.arrow_udf("string")
    def named(texts: pa.Array) -> pa.Array:
        return pa.array((similar.class_of(v) for v in shingle_sets(texts.to_pylist(), size)), pa.string())

    return named


def _texts_of(documents: DataFrame, classes: DataFrame, size: int) -> similar.Fetch:
    """Reads the texts of the classes in question again, one document for each class; texts of classes without any doc_id are found by the class."""
    unnamed = classes.where("doc_id is null").limit(1).count()
    texts = documents.select(F.col("doc_id").cast("bigint"), "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            nodes, partners = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield from similar.sent_sets(partners, nodes, shingle_sets(batch.column(0).to_pylist(), size))

    def fetch(wanted: DataFrame) -> DataFrame:
        every = cut_lineage(wanted.join(classes.select("node", "doc_id"), "node"))
        asked = every.where("doc_id is not null")
        found = likely(texts, "doc_id", asked).join(asked, "doc_id").select("text", "node", "partners")
        if unnamed:
            asked = every.where("doc_id is null").select("node", "partners")
            named = likely(texts.where("doc_id is null").select("text", node_of(size)("text").alias("node")), "node", asked)
            found = found.unionByName(named.groupBy("node").agg(F.min("text").alias("text")).join(asked, "node").select("text", "node", "partners"))
        return found.mapInArrow(lean(sets), similar.SENT)

    return fetch


def _components(documents: DataFrame, size: int, percent: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (node, component, component_id) of their classes."""
    with small_batches(documents.sparkSession):
        signed = cut_lineage(signatures(documents, size, bands))
    classes = signed.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = cut_lineage(classes)
    labels = similar.link_classes(classes, _texts_of(documents, classes, size), percent)
    owners = classes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    owners = cut_lineage(owners)
    least = owners.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return signed, owners.join(least, "component").select("node", "component", "component_id")


def _labelled(signed: DataFrame, lookup: DataFrame) -> DataFrame:
    slim = signed.select("doc_id", "n_shingles", "node")
    rows = lookup_join(slim, lookup.select("node", "component_id"), "node", row_count=slim.count())
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(
    documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents."""
    return _labelled(*_components(documents, size, percent, bands))


def deduplicated(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all columns. Rows with one doc_id are kept or dropped together,
    but for repeated rows, of which one stays. Rows without doc_id are judged one by one: they go if their component has a doc_id, else one
    of the component stays; rows without doc_id and words count as repeated when their texts are equal."""
    signed, lookup = _components(documents, size, percent, bands)
    lookup = cut_lineage(lookup)
    key = free_name(documents, "kept_id")
    kept = _labelled(signed, lookup).where("kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    rows = documents.join(kept, documents["doc_id"].cast("bigint") == F.col(key), "left_semi").dropDuplicates(["doc_id", "text"])
    without = documents.where(F.col("doc_id").cast("bigint").isNull()).withColumn(key, node_of(size)("text"))
    blank = without.where(F.col(key).isNull()).drop(key).dropDuplicates(["doc_id", "text"])
    own = lookup.where("component_id is null").groupBy("component").agg(F.min("node").alias(key)).select(key)
    return rows.unionByName(blank).unionByName(without.join(own, key, "left_semi").dropDuplicates([key]).drop(key))
