"""Line dedup over a sharded minimal perfect hash of line hashes.

A line's key is the line stripped of ASCII white space at both ends, with A-Z lower-cased. Keys of at least 40 code
points that at least 5 documents hold lose their lines in all documents but the one with the largest doc_id.

Counting shuffles only (128-bit key hash, doc_id), combined before the shuffle. The hashes that reach the limit are
dealt into shards; each shard is a minimal perfect hash (levels of bit arrays, ranks by bit count) that indexes three
compact arrays: 64-bit fingerprint, document count, largest doc_id. A hash that is not in the index meets another key's
fingerprint with probability 2^-64. Documents probe the arrays; lines are never joined.

The index is broadcast when its measured size is below ``broadcast_bytes``. Otherwise documents send their hashes, packed in one row for
each batch and shard, to the shards, and the answers come back as one row for each document; the result is the same.

Defined results: null or empty text is one empty line; rows with one doc_id are one document for the count and all keep
their lines if that doc_id is the largest; a null doc_id counts as one document smaller than all others; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vacantia.llm.common import BLANKS, cut_lineage, free_name

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 50_000
BROADCAST_BYTES = 64 << 20
NO_ID = -(1 << 63)
_GAMMA = 2
_MASK = (1 << 64) - 1


def key_of(line: str) -> bytes:
    return line.strip(BLANKS).encode("utf-8", "surrogatepass").lower()


def line_hash(line: str, min_chars: int) -> int | None:
    """128-bit hash of the line's key; None for short keys."""
    key = line.strip(BLANKS)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_keys(documents: DataFrame, min_chars: int) -> DataFrame:
    """(high, low, doc_id): distinct keys of each row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, ids = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for h in {line_hash(line, min_chars) for line in (text or "").split("\n")} - {None}:
                    high.append(_signed(h >> 64))
                    low.append(_signed(h & _MASK))
                    ids.append(NO_ID if doc_id is None else doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (high, low, ids)], ["high", "low", "doc_id"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(keys, "high bigint, low bigint, doc_id bigint")


def frequent_keys(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(high, low, n_docs, keeper) of the keys held by at least ``min_docs`` documents."""
    keys = line_keys(documents, min_chars)
    once = keys.groupBy("high", "low", "doc_id").agg(F.lit(1).alias("one"))
    counted = once.groupBy("high", "low").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n_docs") >= min_docs)


# The minimal perfect hash of one shard -----------------------------------------------------------------------------


def _mixed(low: np.ndarray, level: int) -> np.ndarray:
    x = low ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_mph(low: np.ndarray) -> list[np.ndarray]:
    """Levels of bits (as bytes 0/1) over distinct 64-bit values: a value's slot is set in the first level where no other value meets it."""
    levels: list[np.ndarray] = []
    while len(low):
        slots = (_mixed(low, len(levels)) % np.uint64(_GAMMA * len(low))).astype(np.int64)
        alone = np.bincount(slots, minlength=_GAMMA * len(low)) == 1
        levels.append(alone)
        low = low[~alone[slots]]
    return levels


class ShardIndex:
    """Bits, ranks and the arrays of one shard."""

    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, keepers: bytes):
        self.sizes = np.frombuffer(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(self.starts[-1])).astype(bool)
        self.rank = np.concatenate([[0], np.cumsum(self.bits)])
        self.prints, self.counts = np.frombuffer(prints, np.int64), np.frombuffer(counts, np.int64)
        self.keepers = np.frombuffer(keepers, np.int64)

    def slot(self, low: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where no level has its bit."""
        found, left = np.full(len(low), -1), np.arange(len(low))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (_mixed(low[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            found[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return found

    def keeper(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is in the index, largest doc_id holding the key)."""
        slot = self.slot(low)
        known = (slot >= 0) & (self.prints[slot] == high) if len(self.prints) else np.zeros(len(low), bool)
        return known, self.keepers[np.where(known, slot, 0)] if len(self.prints) else np.zeros(len(low), np.int64)


def _pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    # two hashes may share their lower half: then the later ones move to a shard of their own kind, listed by "twin"
    low = rows["low"].to_numpy(np.int64).view(np.uint64)
    levels = build_mph(low)
    index = ShardIndex(
        np.array([len(x) for x in levels], np.int64).tobytes(),
        np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool)).tobytes(), b"", b"", b"",
    )
    order = np.argsort(index.slot(low))
    arrays = [rows[c].to_numpy(np.int64)[order].tobytes() for c in ("high", "n_docs", "keeper")]
    sizes, bits = index.sizes.tobytes(), np.packbits(index.bits).tobytes()
    return pd.DataFrame([(int(rows["shard"].iloc[0]), int(rows["twin"].iloc[0]), sizes, bits, *arrays)], columns=_INDEX.names)


_INDEX_TYPES = "shard bigint, twin int, sizes binary, bits binary, prints binary, counts binary, keepers binary"


class _INDEX:
    names = [x.split()[0] for x in _INDEX_TYPES.split(", ")]


def build_index(frequent: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The index table, a row for each shard, and the number of shards. The few keys that share the lower 64 bits with another
    key are numbered by ``twin``, so each row has distinct values."""
    frequent = cut_lineage(frequent)
    shards = int(frequent.count() // shard_keys) + 1
    dealt = frequent.withColumn("shard", F.pmod("low", F.lit(shards)))
    twins = dealt.groupBy("low").agg(F.count("*").alias("n"), F.min("high").alias("first")).where("n > 1").drop("n")
    ranked = dealt.join(twins, "low", "left").withColumn(
        "twin", F.when(F.col("first").isNull() | (F.col("first") == F.col("high")), 0).otherwise(F.pmod(F.hash("high"), F.lit(1 << 20)) + 1)
    )
    packed = ranked.groupBy("shard", "twin").applyInPandas(_pack_shard, _INDEX_TYPES)
    return cut_lineage(packed), shards


# Probing -------------------------------------------------------------------------------------------------------------


_CLEAN = "text string, n_lines bigint, n_dropped bigint"


def _probe_broadcast(documents: DataFrame, index: DataFrame, shards: int, min_chars: int, name: str) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in index.collect()])

    @F.pandas_udf(_CLEAN)
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tables: dict[int, list[ShardIndex]] = {}
        for shard, _, *arrays in held.value:
            tables.setdefault(shard, []).append(ShardIndex(*map(bytes, arrays)))
        for ids, texts in batches:
            split = [(t or "").split("\n") for t in texts.tolist()]
            hashes = [line_hash(line, min_chars) for lines in split for line in lines]
            owners = np.repeat(np.array([NO_ID if pd.isna(i) else int(i) for i in ids.tolist()], np.int64), [len(x) for x in split])
            gone = _gone(hashes, owners, tables, shards)
            out, at = [], 0
            for lines in split:
                kept = [line for line, g in zip(lines, gone[at : at + len(lines)], strict=True) if not g]
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
                at += len(lines)
            yield pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return documents.withColumn(name, probe(F.col("doc_id").cast("bigint").cast("string"), F.col("text")))


def _gone(hashes: list[int | None], owners: np.ndarray, tables: dict[int, list[ShardIndex]], shards: int) -> list[bool]:
    gone = np.zeros(len(hashes), bool)
    at = np.array([i for i, h in enumerate(hashes) if h is not None], np.int64)
    if len(at):
        low = np.array([hashes[i] & _MASK for i in at], np.uint64)
        high = np.array([hashes[i] >> 64 for i in at], np.uint64).view(np.int64)
        shard = low.view(np.int64) % shards
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            for index in tables.get(int(s), ()):
                known, keeper = index.keeper(high[mine], low[mine])
                gone[at[mine[known]]] = owners[at[mine[known]]] != keeper[known]
    return gone.tolist()


def _probe_shards(documents: DataFrame, index: DataFrame, shards: int, min_chars: int, name: str) -> DataFrame:
    """The other way for an index of any size: hashes travel to the shards in packed rows, bounded by the batch."""

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked: dict[int, list[tuple[int, int, int]]] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                owner = NO_ID if doc_id is None else doc_id
                for h in {line_hash(line, min_chars) for line in (text or "").split("\n")} - {None}:
                    low = _signed(h & _MASK)
                    asked.setdefault(low % shards, []).append((_signed(h >> 64), low, owner))
            columns = [[np.array(v, np.int64)[:, k].tobytes() for v in asked.values()] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(asked), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["shard", "high", "low", "owner"]
            )

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, high_out, low_out = [], [], []
            for row in batch.to_pylist():
                index = ShardIndex(*(row[c] for c in _INDEX.names[2:]))
                high, low = np.frombuffer(row["high"], np.int64), np.frombuffer(row["low"], np.int64)
                owner = np.frombuffer(row["owner"], np.int64)
                known, keeper = index.keeper(high, low.view(np.uint64))
                lost = known & (owner != keeper)
                ids += owner[lost].tolist()
                high_out += high[lost].tolist()
                low_out += low[lost].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, high_out, low_out)], ["doc_id", "high", "low"])

    asked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        requests, "shard bigint, high binary, low binary, owner binary"
    )
    lost = asked.join(index, "shard").mapInArrow(answers, "doc_id bigint, high bigint, low bigint")
    own, lists = free_name(documents, "owner"), free_name(documents, "lost")
    per_doc = lost.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("high", "low")).alias(lists))

    @F.pandas_udf(_CLEAN)
    def drop(texts: pd.Series, highs: pd.Series, lows: pd.Series) -> pd.DataFrame:
        out = []
        for text, hi, lo in zip(texts, highs, lows, strict=True):
            lines, gone = (text or "").split("\n"), set()
            if hi is not None:
                gone = {((int(a) & _MASK) << 64) | (int(b) & _MASK) for a, b in zip(hi, lo, strict=True)}
            kept = [line for line in lines if line_hash(line, min_chars) not in gone]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    rows = documents.withColumn(own, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).join(per_doc, own, "left")
    return rows.withColumn(name, drop("text", F.col(f"{lists}.high"), F.col(f"{lists}.low"))).drop(own, lists)


def drop_repeated_lines(
    documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, name: str = "lines",
    broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """Documents with a struct column ``name``: text (kept lines joined by newline), n_lines, n_dropped."""
    index, shards = build_index(frequent_keys(documents, min_chars, min_docs), shard_keys)
    size = sum(F.octet_length(c) for c in _INDEX.names[2:])
    if (index.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes:
        return _probe_broadcast(documents, index, shards, min_chars, name)
    return _probe_shards(documents, index, shards, min_chars, name)
