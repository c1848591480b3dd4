"""Language-model scores from a hierarchical Pitman-Yor model.

Every token (word or end of text) is a customer of the restaurant of the word before it. There are ``RESTAURANTS`` context restaurants, dealt by
a hash of that word; they all share one parent, the root, whose customers are their tables, and the root falls back to a uniform
base over the known tokens and one unknown token:

    p(w | context) = (c_w - d t_w + (s + d t) p(w)) / (s + c)        c customers, t tables of the restaurant, c_w, t_w those of w
    p(w)           = the same over the root's customers and tables, with 1 / (V + 1) as the base

Seating is sampled by blocked Gibbs: given all others, the tables of one word in one restaurant have probability proportional to
S(c_w, t) ((s + d t_all) p(w))^t with generalised Stirling numbers S. They are drawn exactly up to ``EXACT`` customers; further
customers sit down in blocks, each opening a binomial number of tables. This departs from a full sampler in three ways: the totals t_all of the restaurants
and of the root are held fixed during the sweeps of a round and brought up to date once, between the first round and the second; a word's own
customers stay in its weight; and the tables of the samples after the first sweeps are averaged and give one probability, instead of
averaging the probabilities of the samples.

As Spark jobs: training documents emit packed (word, context, count) combined per batch, dealt by word into shards of bounded size; a shard is merged
step by step, sampled in place and becomes a row of the model. Then all documents send packed (word, context, document) to the shards, a hot shard being
replicated over several salts, and get partial sums back, added up per batch. Only totals of a fixed size (``RESTAURANTS``) and single sums
reach the driver or are broadcast; all counts cover all training documents.

Defined results: null or empty text is one end token; rows are scored one by one, so repeated rows count and score each; a null
doc_id is in training; without training documents every token is unknown; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vacantia.llm import shingles
from vacantia.llm.common import cut_lineage, lean, release, slices
from vacantia.llm.line_quality import remainder

RESTAURANTS = 1 << 16
#: Text bytes whose words one shard holds, text bytes of a batch, and tokens scored by one task.
SHARD_BYTES = 20 << 20
BATCH_BYTES = 6 << 20
TASK_TOKENS = 10_000_000
#: Partial counts that are merged at once.
FAN_IN = 256
STRENGTH = 1.0
EXACT = 64
BURN_IN, SAMPLES = 2, 3
END = np.uint64(0x243F6A8885A308D3)
START = np.uint64(0x13198A2E03707344)
_LOG10 = np.log(10)


def is_held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 5) == 1


# Tokens ----------------------------------------------------------------------------------------------------------------


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, context restaurants, number of tokens of each text), the end token included."""
    parts, sizes, held, total = [], [], [], 0
    for text in [*texts, None]:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if held and (total + len(data) > shingles.BATCH_BYTES or len(sizes) + len(held) == len(texts)):
            words, counts = shingles.word_hashes(held)
            parts.append(words)
            sizes += counts.tolist()
            held, total = [], 0
        held.append(data)
        total += len(data)
    counts = np.array(sizes[: len(texts)], np.int64) + 1
    ends = np.cumsum(counts) - 1
    tokens = np.full(int(counts.sum()), END, np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    tokens[is_word] = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    before = np.concatenate([[START], tokens[:-1]]) if len(tokens) else tokens
    before[ends[:-1] + 1] = START
    contexts = (shingles.mixed(before) >> np.uint64(48)).astype(np.uint16)
    return tokens, contexts, counts


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, list]]:
    """(batch number, doc ids, texts, held-out flags) of bounded text size; the numbers are the same in every run of the task."""
    number = TaskContext.get().partitionId() << 32
    ids, texts, held, size = [], [], [], 0
    for batch in (part for batch in batches for part in slices(batch)):
        for doc_id, text, out in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ids.append(doc_id)
            texts.append(text)
            held.append(out)
            size += len(text or "")
            if size >= BATCH_BYTES or len(ids) == 60_000:
                yield number, ids, texts, held
                number, ids, texts, held, size = number + 1, [], [], [], 0
    if ids:
        yield number, ids, texts, held


def _shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so sorted words have sorted shards."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _rows(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], list(columns))


# Counting ----------------------------------------------------------------------------------------------------------------


def counted(documents: DataFrame, shards: int, batches: int = 1) -> DataFrame:
    """One row for each shard: sorted words, number of contexts of each, contexts (sorted within a word) and their counts in training, and ``tokens``,
    how many tokens of all documents fall into the shard.

    Partial counts of a shard are merged in steps of at most about FAN_IN, so a group stays small when one word is everywhere; ``batches`` is about
    how many there are.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts, held in _batches(batches):
            tokens, contexts, counts = tokens_of(texts)
            every = np.bincount(_shard_of(tokens, shards), minlength=shards)
            training = np.repeat(~np.array(held, bool), counts)
            words, place = np.unique(tokens[training], return_inverse=True)
            pairs, counts = np.unique(place.astype(np.uint64) << np.uint64(16) | contexts[training], return_counts=True)
            owner = (pairs >> np.uint64(16)).astype(np.int64)
            sizes = np.bincount(owner, minlength=len(words))
            shard = _shard_of(words, shards)
            at = np.searchsorted(shard, np.arange(shards + 1))
            pair_at = np.concatenate([[0], np.cumsum(sizes)])[at]
            rows: dict[str, list] = {c: [] for c in ("shard", "part", "tokens", *_COUNTS)}
            for s in np.flatnonzero(every).tolist():
                a, b, p, q = at[s], at[s + 1], pair_at[s], pair_at[s + 1]
                values = (words[a:b], sizes[a:b].astype(np.uint32), (pairs[p:q] & np.uint64(0xFFFF)).astype(np.uint16), counts[p:q].astype(np.uint32))
                for c, v in zip(rows, (s, number, int(every[s]), *(x.tobytes() for x in values)), strict=True):
                    rows[c].append(v)
            yield _rows({c: (_PART.get(c, pa.binary()), v) for c, v in rows.items()})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(*row) for row in frame[list(_COUNTS)].itertuples(index=False)]
        words, pairs, counts = _merged(parts)
        sizes = np.bincount((pairs >> np.uint64(16)).astype(np.int64), minlength=len(words)).astype(np.uint32)
        first = frame.iloc[0]
        row = (int(first["shard"]), int(first["part"]), int(frame["tokens"].sum()), words.tobytes(), sizes.tobytes(), (pairs & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), narrow(counts).tobytes())
        release()
        return pd.DataFrame([row], columns=["shard", "part", "tokens", *_COUNTS])

    schema = "shard int, part bigint, tokens bigint, words binary, sizes binary, contexts binary, counts binary"
    partial = documents.mapInArrow(lean(emit), schema)
    parts = -(-batches // FAN_IN)
    while True:
        dealt = partial.withColumn("part", F.pmod(F.xxhash64(F.lit(parts), "part"), F.lit(parts)))
        partial = cut_lineage(dealt.groupBy("shard", "part").applyInPandas(merge, schema))
        if parts == 1:
            return partial.drop("part")
        parts = -(-parts // FAN_IN)


_COUNTS = ("words", "sizes", "contexts", "counts")
_PART = {"shard": pa.int32(), "part": pa.int64(), "tokens": pa.int64()}


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in four bytes while all fit, else in eight; the number of contexts tells which."""
    return counts.astype(np.uint64 if len(counts) and counts.max() >= 1 << 32 else np.uint32)


def _unpack(words: bytes, sizes: bytes, contexts: bytes, counts: bytes) -> tuple[np.ndarray, ...]:
    kinds = (np.uint64, np.uint32, np.uint16, np.uint32 if len(counts) == 2 * len(contexts) else np.uint64)
    return tuple(np.frombuffer(x, k) for x, k in zip((words, sizes, contexts, counts), kinds, strict=True))


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, pair keys word place << 16 | context, counts) over all parts of a shard."""
    words = np.unique(np.concatenate([p[0] for p in parts]))
    keys = [np.repeat(np.searchsorted(words, w), s).astype(np.uint64) << np.uint64(16) | c for w, s, c, _ in parts]
    keys, counts = np.concatenate(keys), np.concatenate([p[3] for p in parts])  # of eight bytes if one part has them
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return words, keys[first], np.add.reduceat(counts, first, dtype=np.uint64) if len(first) else counts


# Seating -----------------------------------------------------------------------------------------------------------------


@dataclass
class Totals:
    """Customers and tables of every restaurant, of the root, and the discounts; all of fixed size."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float
    known: int
    discount: float = 0.5
    root_discount: float = 0.5

    @property
    def tokens(self) -> int:
        return int(self.customers.sum())

    @property
    def new_table(self) -> np.ndarray:
        """Weight of the parent in each restaurant's prediction."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        over = STRENGTH + self.root_customers
        rest = (STRENGTH + self.root_discount * self.root_tables) / over / (self.known + 1)
        return (customers - self.root_discount * tables) / over + rest


def log_stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(n, t) for n, t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for n in range(most):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(0, n - discount * np.arange(most + 1)))
        out[n + 1] = np.logaddexp(np.concatenate([[-np.inf], out[n, :-1]]), out[n] + stay)
    return out


def sample_tables(counts: np.ndarray, weight: np.ndarray, stirling: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of each pair, given its customers and the weight of a new table."""
    tables = np.ones(len(counts))
    few = np.minimum(counts, EXACT)
    order = np.argsort(few, kind="stable")
    bounds = np.searchsorted(few[order], np.arange(2, EXACT + 2))
    for c in range(2, EXACT + 1):
        for a in range(bounds[c - 2], bounds[c - 1], max(1, 500_000 // c)):
            own = order[a : min(bounds[c - 1], a + max(1, 500_000 // c))]
            logs = stirling[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(weight[own])[:, None]
            below = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (below < random.random(len(own))[:, None] * below[:, -1:]).sum(axis=1)
    own, seated = np.flatnonzero(counts > EXACT), EXACT
    while len(own):
        block = np.minimum(counts[own] - seated, max(1, seated // 8))
        chance = weight[own] / (np.maximum(1, seated + block / 2 - discount * tables[own]) + weight[own])
        tables[own] += random.binomial(block, np.clip(chance, 0, 1))
        seated += max(1, seated // 8)
        own = own[counts[own] > seated]
    return np.minimum(tables, counts)


def seat(shard: tuple[np.ndarray, ...], totals: Totals, seed: list[int], burn_in: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Averages over samples: tables of each pair, customers and tables of each word at the root."""
    words, sizes, contexts, counts = shard
    counts, random = counts.astype(np.int64), np.random.default_rng(seed)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(words), dtype=np.uint32), sizes)
    stirling, root_stirling = log_stirling(totals.discount, EXACT), log_stirling(totals.root_discount, EXACT)
    new = STRENGTH + totals.discount * totals.tables[contexts]
    root_new = (STRENGTH + totals.root_discount * totals.root_tables) / (totals.known + 1)
    customers, root_tables = sizes.astype(np.float64), np.ones(len(words))
    several = np.flatnonzero(counts > 1)
    sums = [np.zeros(len(counts)), np.zeros(len(words)), np.zeros(len(words))]
    tables = np.ones(len(counts))
    for i in range(burn_in + samples):
        p = totals.root(customers, root_tables)
        tables[several] = sample_tables(counts[several], (new * p[owner])[several], stirling, totals.discount, random)
        customers = np.add.reduceat(tables, starts) if len(words) else customers
        root_tables = sample_tables(customers.astype(np.int64), np.full(len(words), root_new), root_stirling, totals.root_discount, random)
        if i >= burn_in:
            sums = [s + x for s, x in zip(sums, (tables, customers, root_tables), strict=True)]
    return tuple(s / samples for s in sums)


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5


_TOTAL = "context int, customers double, tables double"


def _total_rows(customers: np.ndarray, tables: np.ndarray, more: list[float]) -> pa.RecordBatch:
    """Rows of the restaurants in use, and scalars under negative contexts."""
    used = np.flatnonzero(customers)
    contexts = [*used.tolist(), *(-1 - i for i in range(len(more)))]
    return _rows({"context": (pa.int32(), contexts), "customers": (pa.float64(), [*customers[used], *more]), "tables": (pa.float64(), [*tables[used], *[0.0] * len(more)])})


def _summed(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """At most RESTAURANTS and a few more rows reach the driver."""
    customers, tables, more = np.zeros(RESTAURANTS), np.zeros(RESTAURANTS), {}
    for context, c, t in rows.groupBy("context").agg(F.sum("customers"), F.sum("tables")).collect():
        if context < 0:
            more[-1 - context] = c
        else:
            customers[context], tables[context] = c, t
    return customers, tables, more


def first_totals(counts: DataFrame) -> Totals:
    """One table for each pair, and discounts from the numbers of pairs and words seen once and twice."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, sizes, contexts, n = _unpack(*(row[c] for c in _COUNTS))
                customers = np.bincount(contexts, n, RESTAURANTS)
                scalars = [len(words), (n == 1).sum(), (n == 2).sum(), (sizes == 1).sum(), (sizes == 2).sum()]
                yield _total_rows(customers, np.bincount(contexts, minlength=RESTAURANTS).astype(float), [float(x) for x in scalars])

    customers, tables, more = _summed(counts.mapInArrow(lean(describe), _TOTAL))
    known, ones, twos, root_ones, root_twos = (more.get(i, 0.0) for i in range(5))
    return Totals(customers, tables, float(tables.sum()), known, int(known), _discount(ones, twos), _discount(root_ones, root_twos))


_MODEL = "shard int, tokens bigint, words binary, sizes binary, contexts binary, counts binary, tables binary, root_customers binary, root_tables binary"


def model(counts: DataFrame, totals: Totals, seed: int, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """The counts with averaged seating: mean tables of the pairs of two and more customers, and of each word at the root."""
    held = counts.sparkSession.sparkContext.broadcast(totals)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _unpack(*(row[c] for c in _COUNTS))
                tables, customers, root_tables = seat(shard, held.value, [seed, row["shard"]], burn_in, samples)
                row["tables"] = tables[shard[3] > 1].astype(np.float32).tobytes()
                row["root_customers"], row["root_tables"] = customers.astype(np.float64).tobytes(), root_tables.astype(np.float32).tobytes()
                yield _rows({c: (_PART.get(c, pa.binary()), [row[c]]) for c in (x.split()[0] for x in _MODEL.split(", "))})

    return cut_lineage(counts.mapInArrow(lean(sample), _MODEL))


def _all_tables(counts: np.ndarray, tables: bytes) -> np.ndarray:
    out = np.ones(len(counts))
    out[counts > 1] = np.frombuffer(tables, np.float32)
    return out


def updated(seated: DataFrame, totals: Totals) -> Totals:
    """Totals of the seating in the model."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, contexts, n = _unpack(*(row[c] for c in _COUNTS))
                tables = np.bincount(contexts, _all_tables(n, row["tables"]), RESTAURANTS)
                scalars = [np.frombuffer(row["root_customers"]).sum(), np.frombuffer(row["root_tables"], np.float32).sum(dtype=np.float64)]
                yield _total_rows(np.bincount(contexts, n, RESTAURANTS), tables, [float(x) for x in scalars])

    customers, tables, more = _summed(seated.mapInArrow(lean(describe), _TOTAL))
    return Totals(customers, tables, more.get(0, 0.0), more.get(1, 0.0), totals.known, totals.discount, totals.root_discount)


def trained(documents: DataFrame, shards: int, seed: int = 1, batches: int = 1) -> tuple[DataFrame, Totals]:
    """The model and its totals; two rounds of sweeps, with totals brought up to date in between."""
    counts = counted(documents, shards, batches)
    totals = first_totals(counts)
    totals = updated(model(counts, totals, seed, 1, 1), totals)
    seated = model(counts, totals, seed + 1)
    return seated, updated(seated, totals)


# Scoring -----------------------------------------------------------------------------------------------------------------


class ShardModel:
    def __init__(self, row: pd.Series | None, totals: Totals):
        self.totals, self.new = totals, totals.new_table
        empty = {c: b"" for c in (*_COUNTS, "tables", "root_customers", "root_tables")}
        row = empty if row is None else row
        self.words, sizes, contexts, counts = _unpack(*(row[c] for c in _COUNTS))
        owner = np.repeat(np.arange(len(self.words), dtype=np.uint32), sizes)
        self.keys = owner.astype(np.uint64) << np.uint64(16) | contexts
        seen = counts - totals.discount * _all_tables(counts, row["tables"])
        self.own = seen / (STRENGTH + totals.customers[contexts])
        self.count = np.bincount(owner, counts, len(self.words))
        self.root = totals.root(np.frombuffer(row["root_customers"]), np.frombuffer(row["root_tables"], np.float32).astype(np.float64))
        self.unknown = float(totals.root(np.zeros(1), np.zeros(1))[0])

    def predict(self, words: np.ndarray, repeats: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, training count) of each token; ``words`` are distinct, each followed by ``repeats`` contexts."""
        place = np.searchsorted(self.words, words)
        known = place < len(self.words)
        known[known] = self.words[place[known]] == words[known]
        root, count = np.full(len(words), self.unknown), np.zeros(len(words))
        root[known], count[known] = self.root[place[known]], self.count[place[known]]
        p = self.new[contexts] * np.repeat(root, repeats)
        is_known = np.repeat(known, repeats)
        keys = np.repeat(place, repeats)[is_known].astype(np.uint64) << np.uint64(16) | contexts[is_known]
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        if len(keys):
            p[is_known] += np.where(self.keys[at] == keys, self.own[at], 0)
        return p, np.repeat(count, repeats)


_ASKED = "batch bigint, shard int, words binary, repeats binary, contexts binary, docs binary, meta binary"
_ANSWER = "batch bigint, docs binary, score binary, base binary, known binary, meta binary"


def requests(documents: DataFrame, shards: int) -> DataFrame:
    """Packed (word, context, document of the batch) for each batch and shard; the batch's row for shard 0 also lists its documents."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts, held in _batches(batches):
            tokens, contexts, counts = tokens_of(texts)
            docs = np.repeat(np.arange(len(counts), dtype=np.uint16), counts)
            words, place, repeats = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(place, kind="stable")
            contexts, docs = contexts[order], docs[order]
            at = np.searchsorted(_shard_of(words, shards), np.arange(shards + 1))
            token_at = np.concatenate([[0], np.cumsum(repeats)])[at]
            meta = pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(counts, pa.int64())], ["doc_id", "held_out", "n_tokens"])
            rows: dict[str, list] = {c.split()[0]: [] for c in _ASKED.split(", ")}
            for s in sorted({0, *np.flatnonzero(np.diff(at)).tolist()}):
                a, b, p, q = at[s], at[s + 1], token_at[s], token_at[s + 1]
                parts = (words[a:b], repeats[a:b].astype(np.uint32), contexts[p:q], docs[p:q])
                values = [number, s, *(x.tobytes() for x in parts), _to_bytes(meta) if s == 0 else None]
                for c, v in zip(rows, values, strict=True):
                    rows[c].append(v)
            kinds = {"batch": pa.int64(), "shard": pa.int32()}
            yield _rows({c: (kinds.get(c, pa.binary()), v) for c, v in rows.items()})

    return documents.mapInArrow(lean(emit), _ASKED)


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def prepared(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint"), "text", is_held_out(F.col("doc_id")).alias("held"))


def scores(documents: DataFrame, shard_bytes: int = SHARD_BYTES, task_tokens: int = TASK_TOKENS, seed: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of documents."""
    rows = prepared(documents)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // shard_bytes) + 1
    seated, totals = trained(rows, shards, seed, int(size // BATCH_BYTES) + 1)
    held = documents.sparkSession.sparkContext.broadcast(totals)

    def score(asked: pd.DataFrame, model_rows: pd.DataFrame) -> pd.DataFrame:
        totals = held.value
        shard = ShardModel(model_rows.iloc[0] if len(model_rows) else None, totals)
        out = []
        for row in asked.itertuples(index=False):
            words, repeats = np.frombuffer(row.words, np.uint64), np.frombuffer(row.repeats, np.uint32)
            contexts, docs = np.frombuffer(row.contexts, np.uint16), np.frombuffer(row.docs, np.uint16)
            p, count = shard.predict(words, repeats, contexts)
            used, place = np.unique(docs, return_inverse=True)
            base = np.log((count + 0.5) / (totals.tokens + 0.5 * (totals.known + 1))) / _LOG10
            sums = [np.bincount(place, x, len(used)) for x in (np.log(p) / _LOG10, base, count > 0)]
            out.append((row.batch, used.tobytes(), sums[0].tobytes(), sums[1].tobytes(), sums[2].astype(np.uint32).tobytes(), row.meta))
        release()
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ANSWER.split(", ")])

    def add_up(answers: pd.DataFrame) -> pd.DataFrame:
        meta = pa.ipc.open_stream(answers["meta"].dropna().iloc[0]).read_all()
        sums = np.zeros((3, meta.num_rows))
        for row in answers.itertuples(index=False):
            docs = np.frombuffer(row.docs, np.uint16)
            for i, part in enumerate((np.frombuffer(row.known, np.uint32), np.frombuffer(row.base), np.frombuffer(row.score))):
                sums[i, docs] += part
        frame = pd.DataFrame({"doc_id": pd.array(meta["doc_id"].to_pylist(), dtype="Int64"), "held_out": meta["held_out"].to_pylist(), "n_tokens": meta["n_tokens"].to_pylist()})
        return frame.assign(n_known=sums[0].astype(np.int64), base_score=sums[1], score=sums[2])

    salts = seated.select("shard", F.ceil(F.col("tokens") / task_tokens).cast("int").alias("salts"))  # by the tokens that will be asked for
    salts = cut_lineage(salts.where("salts > 1"))
    spread = seated.join(salts, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    asked = requests(rows, shards).join(salts, "shard", "left")
    asked = asked.withColumn("salt", F.pmod(F.hash("batch"), F.coalesce("salts", F.lit(1)))).drop("salts")
    answered = asked.groupBy("shard", "salt").cogroup(spread.drop("salts").groupBy("shard", "salt")).applyInPandas(score, _ANSWER)
    summed = answered.groupBy("batch").applyInPandas(add_up, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return summed.withColumn("train_tokens", F.lit(totals.tokens).cast("bigint"))
