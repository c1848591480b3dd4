"""Links between classes of equal shingle sets: banded candidates, exact confirmation, components without all pairs of a bucket.

Classes that share a band are candidates:

1. each class of a bucket against the bucket's centre, all compared on full sets; components of the links; the same again among the classes
   that stayed outside their star's largest component, then without the components of the centres tried, as long as that joins many;
2. around centres that still hold several components, each class outside the largest against those classes of other components that share
   enough of its first tokens (a prefix and position filter: it passes every linked pair), again compared on full sets.

A pair of one bucket is skipped only when its classes are already in one component or cannot be linked, so the components are those of all
links between candidates. Joins on a class meet it once on one side; a hot class or bucket on the other side goes through ``lookup_join`` or is split by
Spark's skew join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from vacantia.llm.common import cut_lineage, lean, likely, small_batches
from vacantia.operators.entities import dedup_components
from vacantia.operators.skew import lookup_join

PERMUTATIONS_PER_BAND = 2
#: Further stars are tried while at least one pair in so many is a link between components; what they leave goes to the exact step.
STILL_WORTH = 10
_RANDOM = np.random.Generator(np.random.PCG64(71))
_FACTORS = _RANDOM.integers(0, 1 << 64, 1024, np.uint64) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 64, 1024, np.uint64)
_SET_BYTES = 6
#: Bytes of sets in one batch that leaves a worker; a larger set is a batch alone.
BATCH_BYTES = 4 << 20
#: Fetches the full sets: from (node, partners) to (a, b, data), a row for each node b and each of its partners a.
Fetch = Callable[[DataFrame], DataFrame]


def permuted(values: np.ndarray, i: int) -> np.ndarray:
    """The values under permutation ``i``."""
    return _FACTORS[i] * values + _SHIFTS[i]


def min_max(values: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each permutation x -> a*x + b modulo 2^64."""
    low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(permutations, np.uint64)
    for at in range(0, len(values), 2048):
        hashed = np.multiply.outer(_FACTORS[:permutations], values[at : at + 2048])
        hashed += _SHIFTS[:permutations, None]
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    return low, high


def band_hashes(values: np.ndarray, bands: int, permutations: int = PERMUTATIONS_PER_BAND) -> list[int]:
    """One hash for each band, of the minima and maxima of its permutations."""
    low, high = min_max(values, bands * permutations)
    rows = np.stack([low, high], axis=1).reshape(bands, -1)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(rows)]


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, 8 - _SET_BYTES :].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // _SET_BYTES, 8), np.uint8)
    wide[:, :_SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _SET_BYTES)
    return wide.view("<u8").ravel()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def class_of(values: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(values.tobytes()) if len(values) else None


def sent_sets(batch_nodes: Iterable[list[str]], nodes: Iterable[str], sets: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches of (a, b, data) for nodes with their partners, of about BATCH_BYTES each; a text whose set is not the node's is passed
    over."""
    a, b, data, held = [], [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(data, pa.binary())], ["a", "b", "data"])

    for node, partners, values in zip(nodes, batch_nodes, sets, strict=True):
        if class_of(values) != node:
            continue
        own = packed(values)
        for partner in partners:
            a.append(partner)
            b.append(node)
            data.append(own)
            held += len(own) + 64
            if held >= BATCH_BYTES:
                yield batch()
                a, b, data, held = [], [], [], 0
    yield batch()


SENT = "a string, b string, data binary"


_COMPARED = "a string, b string, linked boolean, n bigint, outside array<bigint>, inside array<bigint>"


def needed(n: int, percent: int) -> int:
    """How many first tokens, in any common order, a linked set must share one of."""
    return n + percent * n // -100 + 1


def around(own: np.ndarray, centre: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens outside the centre, as many of those inside as fill up the needed first tokens)."""
    inside = np.isin(own, centre, assume_unique=True)
    outside = own[~inside]
    return outside, own[inside][: max(0, needed(len(own), percent) - len(outside))]


def _once(sent: DataFrame) -> DataFrame:
    """One row for each (a, b): a document that stands in several rows sends its set from each of them."""
    repeated = sent.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1").limit(1).count()
    return cut_lineage(sent.dropDuplicates(["a", "b"])) if repeated else sent


def compared(pairs: DataFrame, fetch: Fetch, percent: int) -> DataFrame:
    """Every pair with whether its full sets are linked, the size of b's set and its tokens around a; each set travels once for
    each of its partners ``a``."""
    wanted = pairs.select(F.col("b").alias("node"), "a").unionByName(pairs.select(F.col("a").alias("node"), "a").distinct())

    types = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [c.split()[0] for c in _COMPARED.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        held, name, centre = 0, None, np.zeros(0, np.uint64)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

        for batch in batches:
            places = {c: batch.schema.get_field_index(c) for c in ("a", "b", "data", "other")}
            for i in range(len(batch)):
                row = {c: batch.column(k)[i] for c, k in places.items()}
                a, own = row["a"].as_py(), unpacked(row["data"].as_py())
                if a != name:
                    name, centre = a, unpacked(row["other"].as_py())
                values = (a, row["b"].as_py(), linked(centre, own, percent), len(own), *(x.astype(np.int64) for x in around(own, centre, percent)))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                held += 128 + 8 * (len(values[4]) + len(values[5]))
                if held >= BATCH_BYTES:
                    yield batch_of()
                    out, held = [[] for _ in names], 0
        yield batch_of()

    with small_batches(pairs.sparkSession):
        sent = _once(cut_lineage(fetch(wanted.groupBy("node").agg(F.collect_set("a").alias("partners")))))
    own = sent.where("a = b").dropDuplicates(["a"]).select("a", F.col("data").alias("other"))
    met = sent.where("a <> b").join(own, "a")
    with small_batches(pairs.sparkSession):
        return cut_lineage(met.mapInArrow(lean(compare), _COMPARED))


def components_of(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in links (a, b)."""
    shared = F.lit(None).cast("string").alias("key_link")
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("key_posting"), shared)
    return dedup_components(ends)


def members_of(classes: DataFrame) -> DataFrame:
    """(bucket, node) of the buckets that hold several classes; input (node, bands)."""
    entries = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = cut_lineage(entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    entries = cut_lineage(likely(entries, "bucket", shared))
    found = lookup_join(entries, shared, "bucket", row_count=entries.count())
    return cut_lineage(found.where("members is not null").select("bucket", "node"))


def centres_of(members: DataFrame) -> DataFrame:
    """(bucket, a): the centre of each bucket, the class whose buckets hold most classes in all."""
    n = members.count()
    sizes = members.groupBy("bucket").agg(F.count("*").alias("members"))
    weights = lookup_join(members, sizes, "bucket", row_count=n).groupBy("node").agg(F.sum("members").alias("weight"))
    centres = members.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("centre"))
    return cut_lineage(centres.select("bucket", F.col("centre.node").alias("a")))


def stars(members: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b): each class of a bucket against the bucket's centre."""
    pairs = lookup_join(members, centres, "bucket", row_count=members.count())
    return cut_lineage(pairs.where("a <> node").select("a", F.col("node").alias("b")).distinct())


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("component").alias(f"label_{end}"))
        pairs = pairs.join(named, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    return pairs.where("label_a <> label_b").select("a", "b")


def _beyond(members: DataFrame, centres: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the buckets without the component of the bucket's centre."""
    placed = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    own = centres.join(labels.withColumnRenamed("node", "a"), "a", "left").select("bucket", F.coalesce("component", "a").alias("own"))
    placed = cut_lineage(placed)
    return cut_lineage(lookup_join(placed, own, "bucket", row_count=placed.count()).where("label <> own").select("bucket", "node"))


def _placed(star: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the stars that hold several components, with the component of b and the star's largest one."""
    placed = star.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("component", "b"))
    centre = star.select("a").distinct().join(labels.withColumnRenamed("node", "a"), "a", "left")
    centre = centre.select("a", F.coalesce("component", "a").alias("label"))
    by_label = placed.select("a", "label").unionByName(centre).groupBy("a", "label").agg(F.count("*").alias("members"))
    split = by_label.groupBy("a").agg(F.count("*").alias("labels"), F.max(F.struct("members", "label")).alias("top")).where("labels > 1")
    return placed.drop("component").join(split.select("a", F.col("top.label").alias("top")), "a")


def _first_tokens(placed: DataFrame, percent: int) -> DataFrame:
    """(key, node, label, top, n, rest) of the first tokens of each class: those outside the centre from rare to frequent among the classes of
    the star, then those inside. ``key`` names star and token; ``rest`` counts the tokens from this one on."""
    own = [F.col("b").alias("node"), "a", "label", "top", "n"]
    outside = placed.select(*own, F.explode("outside").alias("token")).withColumn("key", F.xxhash64("a", "token"))
    outside = cut_lineage(outside)
    counts = outside.groupBy("key").agg(F.count("*").alias("classes"))
    order = Window.partitionBy("a", "node").orderBy("classes", "token")
    ranked = outside.join(counts, "key").withColumn("place", F.row_number().over(order) - 1)
    ranked = ranked.where((F.col("classes") > 1) & (F.col("place") < F.col("n") - F.ceil(percent * F.col("n") / 100) + 1))
    inside = placed.select(*own, F.size("outside").alias("before"), F.posexplode("inside").alias("at", "token"))
    inside = inside.withColumns({"key": F.xxhash64("a", "token"), "place": F.col("before") + F.col("at")})
    columns = ["key", "node", "label", "top", "n", (F.col("n") - F.col("place")).alias("rest")]
    return ranked.select(*columns).unionByName(inside.select(*columns))


def _open_pairs(star: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs around one centre that are in different components and may still be linked.

    Two linked sets x and y share one of their first tokens, and from the first shared one on both hold at least the intersection. Tokens that no
    other class of the star has come first, so a class far from the others meets nobody.
    """
    tokens = cut_lineage(_first_tokens(_placed(star, labels), percent))
    minor = tokens.where("label <> top").select("key", *(F.col(c).alias(f"{c}_x") for c in ("node", "label", "n", "rest")))
    enough = (100 + percent) * F.least("rest", "rest_x") >= percent * (F.col("n") + F.col("n_x"))
    once = (F.col("label") == F.col("top")) | (F.col("node_x") < F.col("node"))
    met = minor.join(tokens, "key").where((F.col("label_x") != F.col("label")) & enough & once)
    return cut_lineage(met.select(F.least("node_x", "node").alias("a"), F.greatest("node_x", "node").alias("b")).distinct())


def link_classes(classes: DataFrame, fetch: Fetch, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with another one; input (node, bands)."""
    members = members_of(classes)
    star = compared(stars(members, centres_of(members)), fetch, percent)
    links = star.where("linked").select("a", "b")
    labels = cut_lineage(components_of(links))
    left = _placed(star.select("a", "b"), labels).where("label <> top").select(F.col("b").alias("node")).distinct()
    rest = cut_lineage(members.join(left, "node").select("bucket", "node"))
    while True:  # smaller clusters around a centre: stars among the classes that are left, as long as they join components
        centres = centres_of(rest)
        again = stars(rest, centres)
        tried = again.count()
        found = compared(cut_lineage(between(again, labels)), fetch, percent).where("linked").select("a", "b")
        gained = found.count()
        links = links.unionByName(found)
        if gained * STILL_WORTH < tried or not tried:
            break  # the few new links are joined with the last ones below
        labels = cut_lineage(components_of(links))
        rest = _beyond(rest, centres, labels)  # loses every bucket's centre at least, so the rounds end
    more = _open_pairs(star, labels, percent)
    opened = more.limit(1).count()
    if opened:
        links = links.unionByName(compared(more, fetch, percent).where("linked").select("a", "b"))
    return cut_lineage(components_of(links)) if opened or gained else labels
