"""Cross-tokenizer alignment: where two tokenizers end a token at the same byte, and which of their tokens overlap.

Both tokenizers encode a text; cumulated token lengths give two ascending lists of end offsets. The shorter list drives: each of its ends
gallops into the longer one, from the place its rank suggests, in steps that double until they enclose the end, and a binary search
closes in. An end found in both lists closes a group, so the common indices slice both token lists; the difference of two neighbouring
ranks is the range of longer-list tokens that a shorter-list token overlaps, which gives every link without comparing tokens. All ends of a
block of documents gallop together as one array. Links are counted for each pair of ids over the whole corpus.

Tokenizer A is a byte-level BPE file of the tokenizers library, tokenizer B a sentencepiece model; A encodes a space and the text, B the text
(it adds the space). A file of exactly the plain description below is run by tiktoken over the vocabulary of that same file, which a test
compares with the tokenizers library; any other file runs in the tokenizers library itself.

Results for odd input: a text that is null, empty, or not given back byte by byte by both tokenizers has no tokens, all counts 0 and the empty
string as its groups. Strings of special tokens inside a text are plain text. Every row of ``documents`` gives a row, also with a repeated or
null doc_id; each counts in the corpus totals. Texts are encoded whole; one text is in one task's memory. An empty table gives no rows. Extra columns are not read.

On Spark: one pass encodes, aligns and stores each document's distinct links (a key and how often), compressed. Totals are combined
inside the tasks, then by key. They come back to the documents as a broadcast while they are at most TABLE_BYTES, counted first. Beyond
that each block of documents asks once for every key it holds: a join of (block, key) rows with the totals, and the answers meet their
block again. The size of a block is bounded, so no group grows with the corpus; a frequent key has one row for each block.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from vacantia.llm.common import work_dir

#: Text that is aligned at once, and about the text of a block.
CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20
#: Distinct keys a task holds before it hands its counts on.
HELD_KEYS = 3_000_000
#: Largest table of totals that is broadcast.
TABLE_BYTES = 64 << 20

# fixed values: what a plain byte-level BPE file says besides its vocabulary, and its pattern of words
PLAIN = {
    "truncation": None, "padding": None, "normalizer": None, "post_processor": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
}
PLAIN_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
    "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK_PIECE = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level files write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: token ids of a space and the text, and the bytes of every id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, special = told["model"], {t["id"]: t["content"] for t in told["added_tokens"]}
        size = max([*model["vocab"].values(), *special]) + 1
        self.pieces = [b""] * size
        for piece, i in model["vocab"].items():
            if i not in special:
                self.pieces[i] = bytes(letters[c] for c in piece)
        ranked = all(model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) == 256 + i for i, m in enumerate(model["merges"]))
        plain = all(told.get(k) == v for k, v in PLAIN.items()) and all(model.get(k) == v for k, v in PLAIN_MODEL.items())
        if plain and ranked and all(t["special"] for t in told["added_tokens"]):
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.pieces) if b}
            own = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [own.encode_ordinary(" " + t) for t in texts]
        else:
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B: token ids of the text, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [
            bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(BLANK_PIECE, " ").encode() for i in range(n)
        ]
        self.encode = lambda texts: model.encode(texts, out_type=int, num_threads=1)


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str):
    """Both tokenizers with the lengths of their tokens; once for each Python worker."""
    pair = ByteLevel(a_path), Pieces(b_path)
    return *pair, *[np.array([len(p) for p in t.pieces], np.int64) for t in pair]


def gallop(needles: np.ndarray, hay: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rank of each needle in the ascending ``hay``: its first position whose value is not below. Each search starts at its own place,
    doubles its step until the needle is enclosed, and halves the bracket. No needle exceeds the last value of ``hay``."""
    n = len(hay)
    start = np.clip(start, 0, n - 1)
    above = hay[start] >= needles
    low, high = np.where(above, -1, start), np.where(above, start, n - 1)
    for rising in (True, False):
        open_ = np.flatnonzero(~above if rising else above)
        at, step = start[open_], 1
        while len(open_):
            probe = np.minimum(at + step, n - 1) if rising else at - step
            met = hay[probe] >= needles[open_] if rising else (probe < 0) | (hay[np.maximum(probe, 0)] < needles[open_])
            if rising:
                high[open_[met]], low[open_[~met]] = probe[met], probe[~met]
            else:
                low[open_[met]], high[open_[~met]] = np.maximum(probe[met], -1), probe[~met]
            open_, at, step = open_[~met], probe[~met], 2 * step
    wide = np.flatnonzero(high - low > 1)
    while len(wide):
        middle = (low[wide] + high[wide]) >> 1
        over = hay[middle] >= needles[wide]
        high[wide[over]], low[wide[~over]] = middle[over], middle[~over]
        wide = wide[high[wide] - low[wide] > 1]
    return high


def intersect(short: np.ndarray, long: np.ndarray, n_short: np.ndarray, n_long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, common, first): of every end in ``short`` its rank among the ends ``long``, whether it is one of them, and the first ``long``
    token that its token overlaps; the last one is the rank. Both are the ends of the same documents laid end to end, with
    ``n_short`` and ``n_long`` tokens each, so every document ends at a common end."""
    before_short, before_long = np.cumsum(n_short) - n_short, np.cumsum(n_long) - n_long
    place = np.arange(len(short)) - np.repeat(before_short, n_short)
    start = np.repeat(before_long, n_short) + place * np.repeat(n_long, n_short) // np.maximum(1, np.repeat(n_short, n_short))
    rank = gallop(short, long, start)
    common = long[rank] == short
    first = np.zeros(len(short), np.int64)
    first[1:] = rank[:-1] + common[:-1]
    return rank, common, first


@lru_cache(maxsize=2)
def _decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below n, one row each with a free last place, and how many there are."""
    text = [str(i).encode() for i in range(n)]
    width = max(map(len, text), default=1) + 1
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in text), np.uint8).reshape(n, width), np.array([len(t) for t in text])


def written_groups(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, ids_below: int) -> list[bytes]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``; cut_a and cut_b flag the tokens that end a group, all ids are below ``ids_below``."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    of_a, of_b = np.bincount(group_a, minlength=int(cut_a.sum())), np.bincount(group_b, minlength=int(cut_a.sum()))
    place_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(of_a)[group_b]
    ids, marks = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.uint8)
    ids[place_a], ids[place_b] = a, b
    marks[place_a], marks[place_b] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
    table, lengths = _decimal(ids_below)
    size = lengths[ids]
    cells = table[ids]
    cells[np.arange(len(ids)), size] = marks
    flat = cells[np.arange(table.shape[1]) <= size[:, None]].tobytes()
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(n_a)), n_a + n_b), weights=size + 1, minlength=len(n_a)).astype(np.int64))
    return [flat[e - s : e - 1] if s else b"" for s, e in zip(np.diff(ends, prepend=0).tolist(), ends.tolist(), strict=True)]


def _flat(lists: list[list[int]], sizes: np.ndarray) -> np.ndarray:
    out = np.empty(int(sizes.sum()), np.int64)
    at = 0
    for ids in lists:
        out[at : at + len(ids)] = ids
        at += len(ids)
    return out


def align_texts(texts: list[str | None], a_path: str, b_path: str) -> list[tuple[int, int, int, int, bytes, np.ndarray, np.ndarray]]:
    """For each text (n_a, n_b, n_groups, n_links, groups, keys, times): the distinct links as ascending keys ``b * |A| + a``."""
    a, b, length_a, length_b = _pair(a_path, b_path)
    given = [t or "" for t in texts]
    ids_a, ids_b = a.encode(given), b.encode(given)
    for i, text in enumerate(given):
        raw = b" " + text.encode()
        if not text or b"".join([a.pieces[x] for x in ids_a[i]]) != raw or b"".join([b.pieces[x] for x in ids_b[i]]) != raw:
            ids_a[i], ids_b[i] = [], []
    n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
    out: list = [None] * len(texts)
    for of_a in (True, False):
        own = np.flatnonzero((n_a <= n_b) == of_a)
        if not len(own):
            continue
        na, nb = n_a[own], n_b[own]
        flat_a, flat_b = _flat([ids_a[i] for i in own], na), _flat([ids_b[i] for i in own], nb)
        ends_a, ends_b = np.cumsum(length_a[flat_a]), np.cumsum(length_b[flat_b])
        short, long, ns, nl = (flat_a, flat_b, na, nb) if of_a else (flat_b, flat_a, nb, na)
        rank, common, first = intersect(*((ends_a, ends_b) if of_a else (ends_b, ends_a)), ns, nl)
        document = np.repeat(np.arange(len(own)), ns)
        cut_long = np.zeros(len(long), bool)
        cut_long[rank[common]] = True
        cuts = (common, cut_long) if of_a else (cut_long, common)
        groups = written_groups(flat_a, flat_b, *cuts, na, nb, max(len(a.pieces), len(b.pieces)))
        n_groups = np.bincount(document[common], minlength=len(own))
        overlaps = rank - first + 1
        n_links = np.bincount(document, weights=overlaps, minlength=len(own)).astype(np.int64)
        met = np.arange(int(overlaps.sum())) - np.repeat(np.cumsum(overlaps) - overlaps - first, overlaps)
        left, right = np.repeat(short, overlaps), long[met]
        keys = (right if of_a else left) * len(a.pieces) + (left if of_a else right)
        span = len(a.pieces) * len(b.pieces)
        told = np.repeat(document, overlaps) * span + keys
        told.sort()
        new = np.flatnonzero(np.diff(told, prepend=-1))
        times = np.diff(new, append=len(told))
        ends = np.cumsum(np.bincount(told[new] // span, minlength=len(own)))
        keys = told[new] % span
        for j, i in enumerate(own.tolist()):
            part = slice(ends[j - 1] if j else 0, ends[j])
            out[i] = (int(na[j]), int(nb[j]), int(n_groups[j]), int(n_links[j]), groups[j], keys[part], times[part])
    return out


def _packed(keys: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Differences of the keys, and the counts; both as the fewest bytes that hold the largest, named by a first byte."""

    def pack(values: np.ndarray) -> bytes:
        size = next(s for s in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * s))
        # all low bytes first, then all higher ones: like bytes lie together for the file's compression
        return bytes([size]) + np.ascontiguousarray(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()

    return pack(np.diff(keys, prepend=0)), pack(times)


def _unpack(data: bytes) -> np.ndarray:
    size = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)


def _links(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unpack(keys)), _unpack(times)


_ALIGNED = "block string, place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, keys binary, times binary"


def align(documents: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, place, doc_id, n_a, n_b, n_groups, n_links, groups, keys, times) for each document: the alignment written as text, and its
    distinct links packed. ``block`` names the documents that one task took one after the other; it changes when the frame is computed anew, so write the frame before using it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, number, filled, place = f"{task.partitionId()}-{task.taskAttemptId()}", 0, 0, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            at = 0
            while at < len(batch):
                end = at + 1
                total = sizes[at]
                while end < len(batch) and total + sizes[end] <= chunk_bytes:
                    total += sizes[end]
                    end += 1
                if filled and filled + total > block_bytes:
                    number, filled, place = number + 1, 0, 0
                found = align_texts(batch.column(1)[at:end].to_pylist(), a_path, b_path)
                packed = [_packed(f[5], f[6]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{name}-{number}"] * (end - at), pa.string()), pa.array(np.arange(place, place + end - at), pa.int32()), batch.column(0)[at:end],
                        *[pa.array([f[j] for f in found], pa.int64()) for j in range(4)],
                        pa.array([f[4].decode() for f in found], pa.string()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary()),
                    ],
                    ["block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "keys", "times"],
                )
                filled, place, at = filled + total, place + end - at, end

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ALIGNED)


def stored(aligned: DataFrame) -> DataFrame:
    """The aligned documents as a table in the shared folder, written once."""
    path = work_dir(aligned.sparkSession, "aligned")
    aligned.write.option("compression", "zstd").parquet(path)
    return aligned.sparkSession.read.schema(aligned.schema).parquet(path)


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def link_totals(aligned: DataFrame, a_size: int, held_keys: int = HELD_KEYS) -> DataFrame:
    """(key, n, best): links of each pair of ids in the corpus, and whether no pair of its B id has more; written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            both = [held, *waiting]
            return _counted(np.concatenate([k for k, _ in both]), np.concatenate([n for _, n in both]))

        def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(n[a : a + 100_000])], ["key", "n"])

        for batch in batches:
            for keys, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.append(_links(keys, times))
                size += len(waiting[-1][0])
                if size >= held_keys:
                    held, waiting, size = merged(), [], 0
                    if len(held[0]) >= held_keys:
                        yield from rows(*held)
                        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from rows(*merged())

    each = aligned.where("n_links > 0").select("keys", "times").mapInArrow(run, "key bigint, n bigint")
    totals = stored(each.groupBy("key").agg(F.sum("n").alias("n")))
    of_b = F.expr(f"key div {a_size}L")
    highest = totals.groupBy(of_b.alias("b")).agg(F.max("n").alias("highest"))  # at most as many rows as B has ids
    return stored(totals.withColumn("b", of_b).join(F.broadcast(highest), "b").select("key", "n", (F.col("n") == F.col("highest")).alias("best")))


_OWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def _sums(keys: np.ndarray, times: np.ndarray, known: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple[int, int]:
    at = np.searchsorted(known, keys)
    return int(times[best[at]].sum()), int((times * n[at]).sum())


def with_link_counts(aligned: DataFrame, a_size: int, table_bytes: int = TABLE_BYTES, held_keys: int = HELD_KEYS) -> DataFrame:
    """The aligned documents (written before) with ``n_best`` and ``count_sum`` instead of their packed links."""
    totals = link_totals(aligned, a_size, held_keys)
    kept = [c for c in aligned.columns if c not in ("block", "place", "keys", "times")]
    schema = aligned.select(*kept).schema.add("n_best", T.LongType()).add("count_sum", T.LongType())
    if totals.count() * 17 <= table_bytes:
        rows = totals.toArrow().sort_by("key")
        held = aligned.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("key", "n", "best")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_sums(*_links(k, t), *held.value) if n else (0, 0) for n, k, t in zip(*(batch.column(c).to_pylist() for c in ("n_links", "keys", "times")), strict=True)]
                columns = [batch.column(c) for c in kept] + [pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n_best", "count_sum"])

        return aligned.select(*kept, "keys", "times").mapInArrow(run, schema)
    return _asked_by_block(aligned, totals, kept, schema)


def _asked_by_block(aligned: DataFrame, totals: DataFrame, kept: list[str], schema) -> DataFrame:
    """Each block asks for the totals of its distinct keys; the answers come back to the block's documents."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[str, np.ndarray] = {}
        for batch in batches:
            by_block: dict[str, list[np.ndarray]] = {}
            for block, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_block.setdefault(block, []).append(np.cumsum(_unpack(keys)))
            for block, parts in by_block.items():  # a key asked for in an earlier batch of the block is not asked for again
                keys = np.unique(np.concatenate(parts))
                known = asked.get(block, np.zeros(0, np.int64))
                fresh = np.setdiff1d(keys, known, assume_unique=True)
                asked = {block: np.union1d(known, fresh)}
                for a in range(0, len(fresh), 100_000):
                    own = fresh[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.string()), pa.array(own)], ["block", "key"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["key"].to_numpy(), kind="stable")
        known, n, best = (right[c].to_numpy()[order] for c in ("key", "n", "best"))
        found = [_sums(*_links(k, t), known, n, best) if m else (0, 0) for m, k, t in zip(*(left[c].to_pylist() for c in ("n_links", "keys", "times")), strict=True)]
        columns = [left[c] for c in kept] + [pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)]
        return pa.table(columns, names=[*kept, "n_best", "count_sum"])

    asked = aligned.where("n_links > 0").select("block", "keys").mapInArrow(ask, "block string, key bigint")
    # a block may ask for a key once for each of its files' batches; the cogroup looks keys up, so repeated answers are harmless
    answers = asked.join(totals, "key").select("block", "key", "n", "best")
    return aligned.select("block", *kept, "keys", "times").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, schema)


def digest(aligned: DataFrame) -> DataFrame:
    """The groups replaced by their SHA-256, empty for a text without tokens."""
    told = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return aligned.withColumn("groups_sha256", told).drop("groups")


def vocabulary(a_path: str, b_path: str) -> tuple[int, int]:
    a, b, _, _ = _pair(a_path, b_path)
    return len(a.pieces), len(b.pieces)
