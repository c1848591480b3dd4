"""Token ids as fixed-width bit-packed binary blocks.

Every id takes the minimum number of bits for the vocabulary, least significant bit first. A block holds whole
documents, with their ids, lengths and the index of its first token in the shard, so a document or any token range is found
without unpacking anything else, and a block unpacks with a few numpy calls. Shards follow each other in ascending doc_id order.

The container is Parquet: one row for each block, written by Spark's committed writer to the shared folder, so a repeated or lost
task leaves no half file and any store Spark can reach will do.

A text is encoded word by word: the given tokenizer drops white space and no token crosses it, so a word between blanks is
always encoded alike and is looked up in a bounded memo; the library encodes what is not there. Texts in which that could not hold
(special tokens, separators U+001C to U+001F) go to the library whole.

Defined results: null or empty text is just the end id; a null doc_id comes first; rows with one doc_id follow each other by text; no
documents give no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from vacantia.llm.common import lean, partitions, slices, work_dir

BLOCK_IDS = 1 << 18
MEMO_WORDS = 500_000
#: Fixed values of the tokenizer file: its word pattern, and the last code point for which the plain route is used.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x00-\u024f]*")
#: What the tokenizer file says besides vocabulary and special tokens. The word route holds for this description only; a file with any other
#: goes to the library whole.
LAYOUT = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "model": {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False,
        "byte_fallback": False, "ignore_merges": False,
    },
}


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes, equal to the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [t["content"] for t in described["added_tokens"]]
        model = {k: v for k, v in described["model"].items() if k not in ("vocab", "merges")}
        plain = all(not t["normalized"] and t["special"] for t in described["added_tokens"])
        told = {k: described[k] for k in LAYOUT if k != "model"}
        self.by_word = plain and {**told, "model": model} == LAYOUT
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            tokens = self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            found = self.pieces[piece] = np.array([t.id for t in tokens], "<u4").tobytes()
        return found

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self._piece(word.lower())
        elif not _PLAIN.fullmatch(word) or not unicodedata.is_normalized("NFC", word):
            return self._library(word)
        return b"".join(map(self._piece, _PIECES.findall(word.lower())))

    def encode(self, text: str) -> bytes:
        if not self.by_word or any(s in text for s in (*self.special, "\x1c", "\x1d", "\x1e", "\x1f")):
            return self._library(text)
        memo, words = self.words, text.split()
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            for w in words:
                if w not in memo:
                    memo[w] = self._word(w)
            ids = b"".join([memo[w] for w in words])
        if len(memo) > MEMO_WORDS:
            memo.clear()
        if len(self.pieces) > MEMO_WORDS:
            self.pieces.clear()
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread, bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """``n`` ids from the token ``start`` of a block on; only the bytes that hold them are touched."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(payload, f"<u{width}", n, start * width).astype("<u4")
    first, last = start * bits // 8, -(-(start + n) * bits // 8)
    spread = np.unpackbits(np.frombuffer(payload, np.uint8)[first:last], bitorder="little")
    spread = spread[start * bits - 8 * first :][: n * bits].reshape(n, bits)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :bits] = spread
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


BLOCK = "shard int, block int, first bigint, n_ids bigint, bits int, doc_ids array<bigint>, lengths array<bigint>, payload binary"
_BLOCK_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()),
     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def write_tokens(documents: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS, path: str | None = None) -> str:
    """Encode whole texts, write them in ascending doc_id order, and return the folder. One range partition makes one shard."""
    spark = documents.sparkSession
    path = path or work_dir(spark, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        bits = bits_for(max(words.vocabulary, end_id + 1))
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held, n_held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {"shard": shard, "block": block, "first": first, "n_ids": len(ids), "bits": bits, "doc_ids": doc_ids, "lengths": lengths, "payload": pack(ids, bits)}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in (part for batch in batches for part in slices(batch)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(text or "") + end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                n_held += lengths[-1]
                if n_held >= block_ids:
                    yield closed()
                    block, first = block + 1, first + n_held
                    doc_ids, lengths, held, n_held = [], [], [], 0
        if held:
            yield closed()

    rows = documents.select(F.col("doc_id").cast("bigint"), "text")
    # rows of one doc_id may be many: the beginning of the text deals them too, in the order of the sort
    rows = rows.repartitionByRange(partitions(spark), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(lean(encode), BLOCK).write.parquet(path)
    return path


def blocks(spark, path: str) -> DataFrame:
    """The written blocks, with the global index ``start`` of each block's first token."""
    table = spark.read.schema(BLOCK).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    offsets = sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    return table.join(offsets, "shard").withColumn("start", F.col("offset") + F.col("first")).drop("offset")


def token_table(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
                ends = np.cumsum(row["lengths"])
                starts = ends - np.array(row["lengths"])
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                columns = [row["doc_ids"], (starts + row["start"]).tolist(), row["lengths"], sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = blocks(spark, path).select("start", "n_ids", "bits", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(lean(read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
