"""Benchmark decontamination: one Aho-Corasick automaton over normalised questions and answers.

Text is normalised by lower-casing A-Z and turning every ASCII character other than a letter or digit into a break, so
a word is a run of ASCII letters, digits and non-ASCII characters. A window is 13 consecutive item words, or the
whole item when it has fewer. Item words are numbered, and the automaton's letters are digits of these numbers. Every window of 13 holds one of the item's
blocks of 7 words that begin at a multiple of 7, so the patterns are these blocks (and whole short items): the automaton grows with the
benchmark's words, not with its windows. A document is scanned once, whole; around each block found, the text's windows are looked up among the
windows of the items and compared with them, and hits are mapped back to words and to character offsets of the original text.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; an item
listed twice counts once; a null item_id still marks words but is not named; an empty benchmark contaminates nothing;
documents keep every column and every repeated row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vacantia.llm import shingles
from vacantia.llm.common import cut_lineage, free_name, release

WINDOW = 13
#: Letters of one place of a word's number in the automaton; few, as its nodes search their links one by one.
BASE = 128
#: Text bytes of the benchmark that one automaton may cover; a larger benchmark takes one scan for each such share. A megabyte of text of distinct
#: words makes about 25 MB of automaton and tables in a worker.
AUTOMATON_BYTES = 10 << 20
SCAN = (
    "n_words bigint, hits array<struct<first:bigint,last:bigint>>, items array<string>, "
    "spans array<struct<start:bigint,stop:bigint>>"
)
_NORMAL = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Matcher:
    """The automaton and the window table of benchmark items (item_id, text)."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.block = window, (window + 1) // 2
        distinct = {(None if i is None else str(i), tuple(words_of(text))) for i, text in items}
        given = sorted(((name, words) for name, words in distinct if words), key=repr)
        numbers: dict[bytes, int] = {}
        self.ids = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int32) for _, words in given]
        self.names = [name for name, _ in given]
        self.digits = next(k for k in range(1, 10) if BASE**k > len(numbers))
        self.numbers = numbers
        # each place of a number has letters of its own, so a match begins and ends between words
        self.letters = letters = ["".join(chr(k * BASE + n // BASE**k % BASE) for k in range(self.digits)) for n in range(len(numbers) + 1)]
        self.automaton, self.short = ahocorasick.Automaton(), []
        hashes, places = [], []
        for k, ids in enumerate(self.ids):
            if len(ids) < window:
                pattern = "".join(letters[n] for n in ids.tolist())
                known = self.automaton.get(pattern, None)
                if known is None:
                    self.short.append([])
                    self.automaton.add_word(pattern, len(self.short) - 1)
                    known = len(self.short) - 1
                self.short[known].append((k, len(ids)))
                continue
            rolling = shingles.rolled(shingles.mixed(ids.astype(np.uint64)), window)
            hashes.append(rolling)
            places.append(np.stack([np.full(len(rolling), k), np.arange(len(rolling))]))
        for ids in self.ids:
            for at in range(0, len(ids) - self.block + 1, self.block) if len(ids) >= window else ():
                pattern = "".join(letters[n] for n in ids[at : at + self.block].tolist())
                if pattern not in self.automaton:
                    self.automaton.add_word(pattern, -1)
        if len(self.automaton):
            self.automaton.make_automaton()
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.places = (np.concatenate(places, axis=1) if places else np.zeros((2, 0), np.int64))[:, order].astype(np.int32)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(number of words, merged runs of hit words as (first, last), items with an occurring window)."""
        words = words_of(text)
        if not words or not len(self.automaton):
            return len(words), [], set()
        get, letters, step = self.numbers.get, self.letters, self.digits
        matches = list(self.automaton.iter("".join([letters[get(w, 0)] for w in words])))
        if not matches:
            return len(words), [], set()
        runs, names = [], set()
        last = np.array([end for end, _ in matches]) // step
        value = np.array([v for _, v in matches])
        for end, known in zip(last[value >= 0].tolist(), value[value >= 0].tolist(), strict=True):
            for item, n in self.short[known]:
                runs.append((end - n + 1, end))
                names.add(self.names[item])
        runs += self._windows(words, np.unique(last), names)  # a short item may be a block of a long one too
        names.discard(None)
        return len(words), merged(runs), names

    def _windows(self, words: list[bytes], ends: np.ndarray, names: set) -> list[tuple[int, int]]:
        """Item windows of the text around blocks that end at the given words."""
        if not len(self.hashes) or len(words) < self.window:
            return []
        starts = np.unique((ends[:, None] - np.arange(self.block - 1, self.window)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts <= len(words) - self.window)]
        if not len(starts):
            return []
        number = self.numbers.get
        ids = np.array([number(w, 0) for w in words], np.int32)
        own = shingles.rolled(shingles.mixed(ids.astype(np.uint64)), self.window)[starts]
        low = np.searchsorted(self.hashes, own)
        high = np.searchsorted(self.hashes, own, side="right")
        runs = []
        seen: dict[int, bool] = {}
        for at, a, b in zip(starts.tolist(), low.tolist(), high.tolist(), strict=True):
            if a == b:
                continue
            if a not in seen:  # equal windows of the text share the look at the items
                mine, seen[a] = ids[at : at + self.window], False
                for k, q in self.places[:, a:b].T.tolist():
                    if np.array_equal(self.ids[k][q : q + self.window], mine):
                        seen[a] = True
                        names.add(self.names[k])
            if seen[a]:
                runs.append((at, at + self.window - 1))
        return runs


_held: dict[str, Matcher] = {}


def matcher(items) -> Matcher:
    """The matcher of the broadcast (name, items, window), built once in a Python worker; only the newest is held."""
    name, given, window = items.value
    if name not in _held:
        _held.clear()
        _held[name] = Matcher(given, window)
    return _held[name]


def merged(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    places = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [(places[first][0], places[last][1]) for first, last in hits]


_SCANNED = pa.struct(
    [
        ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ]
)


def _scanned(found: Matcher, text: str | None, old: dict | None) -> dict:
    n, hits, names = found.scan(text)
    if old is not None:
        hits = merged([*hits, *((h["first"], h["last"]) for h in old["hits"])])
        names |= set(old["items"])
    spans = [{"start": a, "stop": b} for a, b in _spans(text, hits)] if hits else []
    return {"n_words": n, "hits": [{"first": a, "last": b} for a, b in hits], "items": sorted(names), "spans": spans}


def _scanner(items, earlier: bool) -> Callable:
    """A scalar UDF over (text) or (text, earlier result)."""
    if earlier:

        @F.arrow_udf(SCAN)
        def again(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            found = matcher(items)
            for texts, old in batches:
                yield pa.array([_scanned(found, t.as_py(), o.as_py()) for t, o in zip(texts, old, strict=True)], _SCANNED)
            release()

        return again

    @F.arrow_udf(SCAN)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = matcher(items)
        for texts in batches:
            yield pa.array([_scanned(found, t.as_py(), None) for t in texts], _SCANNED)
        release()

    return scan


def scanned(
    documents: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """Documents with a struct column ``name``: n_words, hits, items, spans of the original text.

    The items' texts are broadcast up to ``automaton_bytes``, counted first. A larger benchmark is dealt into that many shares by hash and
    the documents are scanned once for each; the hits are united, so the result is the same.
    """
    spark = documents.sparkSession
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = int(size // automaton_bytes) + 1
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(shares))
    for k in range(shares):
        part = [tuple(r) for r in items.where(share == k).collect()]
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, part, window))
        if k:
            documents = cut_lineage(documents)
        columns = [F.col("text")] + [F.col(name)] * bool(k)
        documents = documents.withColumn(name, _scanner(held, bool(k))(*columns))
    return documents


def n_hit(scan: str) -> Column:
    return F.aggregate(f"{scan}.hits", F.lit(0).cast("bigint"), lambda a, h: a + h["last"] - h["first"] + 1)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one hit word in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated), a row for each row of documents."""
    rows = scanned(documents.select("doc_id", "text"), benchmark, "scan", **options).select("doc_id", "scan")
    rows = rows.select("doc_id", "scan.n_words", n_hit("scan").alias("n_hit"), "scan.items", "scan.spans")
    return rows.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    scan = free_name(documents, "scan")
    rows = scanned(documents, benchmark, scan, **options)
    return rows.where(~is_contaminated(n_hit(scan), F.col(f"{scan}.n_words"))).select(*documents.columns)
