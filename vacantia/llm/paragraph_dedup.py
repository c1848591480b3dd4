"""Substring dedup by paragraphs: min-max hash banding, exact confirmation, removal by components.

A paragraph is a line of at least ``MIN_WORDS`` words, or shorter lines that follow each other without a blank line and have as many together. Its set holds the distinct shingles of five words; paragraphs of equal sets form a
class, classes that share a band are compared on full sets (Jaccard 0.8 or more), and components are taken over all links
(``similar``). Six bands of two values, the minimum and maximum of one permutation: a pair at similarity 0.8 shares one with probability 0.998.

A passage may also stand inside a longer paragraph that is otherwise new, where no measure of the whole paragraph sees it. So paragraphs of more
than ``LONG_WORDS`` words are also cut into pieces at sentence ends, each of at least ``PIECE_WORDS`` words; the cuts of two copies of a passage
fall together again after a sentence or two. Pieces take part in the first step only, the classes of equal texts.

In what the paragraphs leave, every run of ``RUN_WORDS`` words that stands in several documents is found, whatever lines and sentences it lies in
(``repeated_runs``): the smallest hash of the ``PIECE_WORDS``-word shingles of such a window depends on the window alone, so documents that share
a window share it; only windows whose smallest hash repeats, outside the removed paragraphs too, are then compared by a 128-bit hash of all their words, and adjoining ones are joined
to the whole run. Windows side by side with one smallest hash travel as one row up to that choice. With ``skip_periodic`` text that repeats fewer than ``SHINGLE`` words over and over is no run and no paragraph of joined lines.

What this does not see: a paragraph below ``MIN_WORDS`` words that no lines join; and a passage of 20 to 49 words inside a paragraph of at most
``LONG_WORDS`` words that is otherwise new, unless both paragraphs reach the similarity.

A text is read twice: once for its paragraphs, pieces and smallest window hashes, and, where some of these repeat, for the windows.

In each component the occurrence in the smallest (doc_id, place) stays and all others are removed. Components that lie within one
document are left alone unless ``within_documents`` is set. Of runs all places in the first document stay, with ``within_documents`` only those
that overlap the first place.

Defined results: null, empty and short-lined text has no paragraphs and stays as it is; a null doc_id comes last, so its
paragraphs are removed before others; rows with one doc_id are one document, in which later repeats go too; no documents give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from vacantia.llm import shingles, similar
from vacantia.llm.common import cut_lineage, free_name, lean, likely, slices, small_batches
from vacantia.operators.skew import lookup_join

MIN_WORDS = 20
LONG_WORDS = 60
PIECE_WORDS = 12
RUN_WORDS = 50
SHINGLE = 5
PERCENT = 80
BANDS = 6
NO_ID = (1 << 63) - 1
_SENTENCE_END = np.isin(np.arange(256), [ord(c) for c in "!.?"])
_UNIT = "doc_id bigint, start bigint, stop bigint, n_words bigint, node binary, bands array<bigint>, marks array<bigint>"


class Texts(NamedTuple):
    """Texts side by side, so that numpy works on many short ones at once: word i has bytes ``starts[i]`` to ``stops[i]`` of ``data`` and characters
    ``chars[0][i]`` to ``chars[1][i]`` of its own text; text k has the words ``begin[k]`` to ``end[k]``."""

    data: bytes
    words: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    chars: tuple[np.ndarray, np.ndarray]
    begin: np.ndarray
    end: np.ndarray


def side_by_side(texts: list[str | None]) -> Iterator[Texts]:
    """All texts in order, some ``shingles.BATCH_BYTES`` at once; a longer one is alone."""
    held, total = [], 0
    for text in texts:
        own = (text or "").encode("utf-8", "surrogatepass").lower()
        if held and total + len(own) > shingles.BATCH_BYTES:
            yield _joined(held)
            held, total = [], 0
        held.append(own)
        total += len(own) + 1
    if held:
        yield _joined(held)


def _joined(texts: list[bytes]) -> Texts:
    data = b" ".join(texts)
    words, starts, stops = shingles.words_with_places(data)
    until = np.cumsum([len(t) + 1 for t in texts])
    end = np.searchsorted(starts, until)
    begin = np.concatenate([[0], end[:-1]])
    chars, base = (starts, stops), np.concatenate([[0], until[:-1]])
    if not data.isascii():
        before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        chars, base = (before[starts], before[stops]), before[base]
    base = np.repeat(base, end - begin)
    return Texts(data, words, starts, stops, (chars[0] - base, chars[1] - base), begin, end)


def places_of(words: np.ndarray, begin: int, end: int, lines: list[int], sentences: list[int], skip_periodic: bool = False) -> list[tuple[int, int, bool]]:
    """(first word, end word, is a whole paragraph) of each paragraph and piece of the text whose words are ``begin`` to ``end`` of ``words``; ``lines`` and
    ``sentences`` are the words that lines and sentences end before, in order, of this text and others."""

    def joins(a: int, b: int) -> bool:
        return b - a >= MIN_WORDS and not (skip_periodic and is_periodic(words[a:b], b - a).any())

    out, joined, a = [], begin, begin
    for b in [*lines[bisect_right(lines, begin) : bisect_left(lines, end)], end]:
        if not 0 < b - a < MIN_WORDS:
            if joins(joined, a):
                out.append((joined, a, True))
            joined = b
        if b - a >= MIN_WORDS:
            out.append((a, b, True))
            if b - a > LONG_WORDS:
                cut = a
                for stop in sentences[bisect_right(sentences, a) : bisect_right(sentences, b)]:
                    if stop - cut >= PIECE_WORDS and (cut, stop) != (a, b):
                        out.append((cut, stop, False))
                        cut = stop
                if cut > a and b - cut >= PIECE_WORDS:
                    out.append((cut, b, False))
        a = b
    if joins(joined, end):
        out.append((joined, end, True))
    return out


def is_periodic(words: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of ``size`` words repeats fewer than SHINGLE words over and over."""
    out = np.zeros(max(0, len(words) - size + 1), bool)
    for period in range(1, min(SHINGLE, size)):
        same = np.concatenate([[0], np.cumsum(words[period:] == words[:-period])])
        out |= same[size - period :][: len(out)] - same[: len(out)] == size - period
    return out


def span_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word, from differences of running sums: its cost does not grow with ``size``."""
    n = len(words) - size + 1
    sums = np.zeros(len(words) + 1, np.uint64)
    np.add.accumulate(words * shingles.powers(len(words)), out=sums[1:])
    return shingles.mixed((sums[size:] - sums[:-size]) * shingles.inverse_powers(n)) if n > 0 else np.zeros(0, np.uint64)


def least_hashes(words: np.ndarray) -> np.ndarray:
    """The smallest hash of the shingles of PIECE_WORDS words in each window of RUN_WORDS words."""
    low, width, size = span_hashes(words, PIECE_WORDS), 1, RUN_WORDS - PIECE_WORDS + 1
    while width < size:
        step = min(width, size - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def units(documents: DataFrame, bands: int = BANDS, skip_periodic: bool = False) -> DataFrame:
    """(doc_id, start, stop, n_words, node, bands, marks): every paragraph and piece, and for each text a row with only its ``marks``, the distinct least
    hashes of its windows; start and stop are character offsets; pieces have no bands."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            ids, at = batch.column(0).fill_null(NO_ID).to_numpy(), 0
            for texts in side_by_side(batch.column(1).to_pylist()):
                yield from _units_of(ids[at : at + len(texts.begin)], texts, bands, skip_periodic)
                at += len(texts.begin)

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lean(find), _UNIT)


_UNIT_TYPES = [*[pa.int64()] * 4, pa.binary(), *[pa.list_(pa.int64())] * 2]


def _unit_batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    names = [c.split()[0] for c in _UNIT.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, _UNIT_TYPES, strict=True)], names)


def _lists(values: np.ndarray, counts: np.ndarray, nulls: np.ndarray | None = None) -> pa.ListArray:
    ends = np.cumsum(counts, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), pa.array(values), mask=None if nulls is None else pa.array(nulls))


def _units_of(ids: np.ndarray, texts: Texts, bands: int, skip_periodic: bool) -> Iterator[pa.RecordBatch]:
    words, raw = texts.words, np.frombuffer(texts.data, np.uint8)
    lines = np.searchsorted(texts.starts, np.flatnonzero(raw == 10)).tolist()
    sentences = (np.flatnonzero(_SENTENCE_END[raw[texts.stops - 1]]) + 1).tolist()
    places, counts = [], []
    for begin, end in zip(texts.begin.tolist(), texts.end.tolist(), strict=True):
        before = len(places)
        if end - begin >= MIN_WORDS:
            places += places_of(words, begin, end, lines, sentences, skip_periodic)
        counts.append(len(places) - before)
    if places:
        first, last, whole = (np.array(c) for c in zip(*places, strict=True))
        sets, sizes = _distinct(shingles.rolled(words, SHINGLE), first, last - first - SHINGLE + 1)
        ends = 8 * np.cumsum(sizes)
        own = memoryview(sets).cast("B")
        nodes = [xxhash.xxh3_128_digest(own[a:b]) for a, b in zip((ends - 8 * sizes).tolist(), ends.tolist(), strict=True)]
        hashes = _bands(sets[np.repeat(whole, sizes)], sizes[whole], bands)
        spans = {"start": pa.array(texts.chars[0][first]), "stop": pa.array(texts.chars[1][last - 1]), "n_words": pa.array(last - first)}
        banded = _lists(hashes.ravel(), np.where(whole, bands, 0), ~whole)
        yield _unit_batch(len(places), doc_id=pa.array(np.repeat(ids, counts)), **spans, node=pa.array(nodes, pa.binary()), bands=banded)
    n = np.maximum(texts.end - texts.begin - RUN_WORDS + 1, 0)
    if n.any():
        at = np.arange(n.sum()) + np.repeat(texts.begin - np.cumsum(n) + n, n)  # windows that lie in one text
        owner, marks = np.repeat(np.arange(len(n)), n), least_hashes(words)[at]
        if skip_periodic:
            free = ~is_periodic(words, RUN_WORDS)[at]
            owner, marks = owner[free], marks[free]
        for _ in range(2):  # windows side by side mostly have one mark; what is left is sorted
            new = np.ones(len(marks), bool)
            new[1:] = (marks[1:] != marks[:-1]) | (owner[1:] != owner[:-1])
            owner, marks = owner[new], marks[new]
            order = np.lexsort((marks, owner))
            owner, marks = owner[order], marks[order]
        asked = n > 0
        yield _unit_batch(int(asked.sum()), doc_id=pa.array(ids[asked]), marks=_lists(marks.astype(np.int64), np.bincount(owner, minlength=len(n))[asked]))


def _distinct(rolled: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of every place, one place after the other; how many each has)."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    values = rolled[np.arange(sizes.sum()) + np.repeat(first - starts, sizes)]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[starts] = True
    return values[new], np.add.reduceat(new.astype(np.int64), starts)


def _bands(values: np.ndarray, sizes: np.ndarray, bands: int) -> np.ndarray:
    """A row of band hashes for each set, of the minimum and maximum under the band's permutation."""
    low, high = np.zeros((2, bands, len(sizes)), np.uint64)
    starts = np.cumsum(sizes) - sizes
    for i in range(bands if len(sizes) else 0):
        values_i = similar.permuted(values, i)
        np.minimum.reduceat(values_i, starts, out=low[i])
        np.maximum.reduceat(values_i, starts, out=high[i])
    return shingles.mixed(low + shingles.mixed(high ^ np.arange(bands, dtype=np.uint64)[:, None])).astype(np.int64).T


def _texts_of(documents: DataFrame, classes: DataFrame) -> similar.Fetch:
    """Reads the paragraphs of the classes in question again, one place for each class, a document once for all its paragraphs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            every = [(text, w) for text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in asked]
            found = shingles.shingle_sets([text[w["start"] : w["stop"]] for text, w in every], SHINGLE)
            yield from similar.sent_sets([w["partners"] for _, w in every], [w["node"] for _, w in every], found)

    def fetch(wanted: DataFrame) -> DataFrame:
        asked = wanted.join(classes, "node")
        place = F.struct(F.col("first.start").alias("start"), F.col("first.stop").alias("stop"), "node", "partners")
        by_doc = cut_lineage(asked.groupBy(F.col("first.doc_id").alias("owner")).agg(F.collect_list(place).alias("asked")))
        return likely(_by_owner(documents), "owner", by_doc).join(by_doc, "owner").select("text", "asked").mapInArrow(sets, similar.SENT)

    return fetch


def _by_owner(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("owner"), F.coalesce("text", F.lit("")).alias("text"))


#: Windows of one chunk at most.
CHUNK = 64
#: A chunk is ``n`` windows side by side that have one mark: 16 bytes of ``nodes`` for each, and where each starts and stops, counted from ``start``.
_CHUNK = "mark bigint, owner bigint, at bigint, until bigint, n bigint, start bigint, nodes binary, starts array<int>, stops array<int>"


def _stretches(words: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the asked windows, place of the last window that each stands for). A window equal to one of the SHINGLE - 1 before it, as in text that
    repeats a few words over and over, is left to the window before these: it repeats where that one does."""
    same, n_asked = np.zeros(len(asked), bool), np.concatenate([[0], np.cumsum(asked)])
    for period in range(1, min(SHINGLE, len(asked))):
        alike = words[period:] == words[:-period]
        if np.count_nonzero(alike) < RUN_WORDS:
            continue  # as in most texts
        equal = np.concatenate([[0], np.cumsum(alike)])
        whole = equal[RUN_WORDS:] - equal[:-RUN_WORDS] == RUN_WORDS  # window i + period equals window i
        same[period:] |= whole[: len(asked) - period] & (n_asked[period + 1 :] - n_asked[: -period - 1] == period + 1)  # with all in between
    at = np.flatnonzero(asked & ~same)
    ends = np.flatnonzero(~same)  # a stretch lasts until the next window that is not left to another
    after = np.append(ends, len(asked))[np.searchsorted(ends, at, side="right")]
    return at, after - 1


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are among the distinct ``known``, of which there is one at least; long texts have the same value many times in a row."""
    known.sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    own = values[new]
    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return (known[place] == own)[np.cumsum(new) - 1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the windows of (owner, text, marks, gone) with one of the marks and outside the spans that are gone."""
    for batch in (part for batch in batches for part in slices(batch)):
        held: list[tuple] = []
        n_held = 0
        owners, given, every_mark, spans = batch.columns
        ends, marks = every_mark.offsets.to_numpy(), every_mark.values.to_numpy()
        rows = zip(owners.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), spans.to_pylist(), strict=True)
        for texts in side_by_side(given.to_pylist()):
            hashes = least = None
            for begin, end in zip(texts.begin.tolist(), texts.end.tolist(), strict=True):
                owner, first, after, gone = next(rows)
                if end - begin < RUN_WORDS:
                    continue
                if hashes is None:
                    least = least_hashes(texts.words).astype(np.int64)
                    hashes = np.stack([span_hashes(w, RUN_WORDS) for w in (texts.words, shingles.mixed(texts.words))], axis=1)
                words, starts, stops = texts.words[begin:end], texts.chars[0][begin:end], texts.chars[1][begin:end]
                marked = _among(least[begin : end - RUN_WORDS + 1], np.array(marks[first:after]))
                if gone:
                    free = np.zeros(len(words) + 1, np.int64)
                    np.add.at(free, np.searchsorted(starts, [span["start"] for span in gone]), 1)
                    np.subtract.at(free, np.searchsorted(starts, [span["stop"] for span in gone]), 1)
                    taken = np.concatenate([[0], np.cumsum(np.cumsum(free[:-1]) > 0)])
                    marked &= taken[RUN_WORDS:] == taken[:-RUN_WORDS]
                at, last = _stretches(words, marked)
                for a in range(0, len(at), 10_000):
                    own, until = at[a : a + 10_000], last[a : a + 10_000] + RUN_WORDS
                    held.append((np.full(len(own), owner), least[begin + own], own, until, hashes[begin + own], starts[own], stops[until - 1]))
                    n_held += len(own)
                    if n_held >= 10_000:
                        yield _chunk_batch(*(np.concatenate(c) for c in zip(*held, strict=True)))
                        held, n_held = [], 0
        if held:
            yield _chunk_batch(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _chunk_batch(owners: np.ndarray, marks: np.ndarray, at: np.ndarray, until: np.ndarray, nodes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
    new = np.ones(len(at), bool)
    new[1:] = (marks[1:] != marks[:-1]) | (at[1:] != at[:-1] + 1) | (owners[1:] != owners[:-1])
    every = np.arange(len(at))
    new |= (every - np.maximum.accumulate(np.where(new, every, 0))) % CHUNK == 0
    begun = np.flatnonzero(new)
    ends = np.append(begun, len(at)).astype(np.int32)
    n = ends[1:] - ends[:-1]
    base = np.repeat(starts[begun], n)
    binary = pa.Array.from_buffers(pa.binary(), len(begun), [None, pa.py_buffer(16 * ends), pa.py_buffer(nodes)])
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array((x - base).astype(np.int32))) for x in (starts, stops)]
    numbers = (marks[begun], owners[begun], at[begun], until[begun + n - 1], n, starts[begun])
    columns = [pa.array(x.astype(np.int64, copy=False)) for x in numbers]
    return pa.RecordBatch.from_arrays([*columns, binary, *lists], [c.split()[0] for c in _CHUNK.split(", ")])


def _windows_of(chunks: DataFrame) -> DataFrame:
    """(node, owner, at, until, start, stop) of each window; all windows of a chunk but the last one stand for themselves only."""
    each = chunks.select("owner", "at", "until", "n", "start", "nodes", "stops", F.posexplode("starts").alias("i", "from_"))
    return each.select(
        F.substring("nodes", 16 * F.col("i") + 1, F.lit(16)).alias("node"), "owner", (F.col("at") + F.col("i")).alias("at"),
        F.when(F.col("i") == F.col("n") - 1, F.col("until")).otherwise(F.col("at") + F.col("i") + RUN_WORDS).alias("until"),
        (F.col("start") + F.col("from_")).alias("start"), (F.col("start") + F.get("stops", F.col("i"))).alias("stop"),
    )


def repeated_runs(documents: DataFrame, marks: DataFrame, gone: DataFrame, within_documents: bool = False) -> DataFrame:
    """(owner, start, stop, n_words, first_owner, first_start, kept): the longest runs of words, RUN_WORDS or more, whose windows all repeat and
    have their first places side by side too. ``marks`` (owner, mark) are the texts' least hashes; ``gone`` (owner, start, stop) is left out of account."""
    several = "times > 1" if within_documents else "low <> high"
    known = marks.groupBy("mark").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.count("*").alias("times"))
    # one document has each of its marks once, so repeats inside it show only in its windows
    known = known.select("mark", F.lit(True).alias("met")) if within_documents else cut_lineage(known.where(several).select("mark", F.lit(True).alias("met")))
    met = cut_lineage(likely(marks, "mark", known))
    met = lookup_join(met, known, "mark", row_count=met.count()).where("met")
    asked = cut_lineage(met.groupBy("owner").agg(F.collect_set("mark").alias("marks")))
    spans = gone.groupBy("owner").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    asked = cut_lineage(asked.join(spans, "owner", "left"))
    texts = likely(_by_owner(documents), "owner", asked).join(asked, "owner").select("owner", "text", "marks", "gone")
    chunks = cut_lineage(texts.mapInArrow(lean(_chunks), _CHUNK))
    # most marks repeat only in what is gone, so few of them still have windows in several documents
    still = chunks.groupBy("mark").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.sum("n").alias("times")).where(several)
    windows = cut_lineage(_windows_of(likely(chunks, "mark", still.select("mark"))))
    first = windows.groupBy("node").agg(
        F.min(F.struct("owner", "at", "start")).alias("first"), F.min("owner").alias("low"), F.max("owner").alias("high"), F.count("*").alias("times")
    )
    first = cut_lineage(first.where(several).select("node", "first"))
    rows = cut_lineage(likely(windows, "node", first))
    rows = lookup_join(rows, first, "node", row_count=rows.count()).where("first is not null")
    rows = rows.select("owner", "at", "until", "start", "stop", F.col("first.owner").alias("first_owner"), F.col("first.start").alias("first_start"), (F.col("first.at") - F.col("at")).alias("shift"))
    rows = rows.distinct()
    side = ["owner", "first_owner", "shift"]
    place = F.row_number().over(Window.partitionBy(*side).orderBy("at"))
    runs = rows.withColumn("run", F.col("at") - place).groupBy(*side, "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("until") - F.min("at")).alias("n_words"), F.min("first_start").alias("first_start")
    )
    near = F.lit(not within_documents) | (F.col("shift") > -RUN_WORDS)  # a later place that overlaps the first one would take from it
    kept = (F.col("owner") == F.col("first_owner")) & near
    return cut_lineage(runs.select("owner", "start", "stop", "n_words", "first_owner", "first_start", kept.alias("kept")))


def repeated_paragraphs(
    documents: DataFrame, percent: int = PERCENT, bands: int = BANDS, within_documents: bool = False, skip_periodic: bool = False
) -> DataFrame:
    """(doc_id, start, stop, n_words, is_piece, first_doc_id, first_start, kept): every paragraph, piece or run that occurs again, with the
    occurrence of its component that stays. Runs count as pieces; a piece inside a run of its document is left to the run."""
    with small_batches(documents.sparkSession):
        read = cut_lineage(units(documents, bands, skip_periodic))
    found = read.where("marks is null").drop("marks")
    marks = read.where("marks is not null").select(F.col("doc_id").alias("owner"), F.explode("marks").alias("mark"))
    repeated = cut_lineage(found.groupBy("node").agg(F.count("*").alias("places")).where("places > 1").select("node"))
    candidates = found.where("bands is not null").unionByName(likely(found.where("bands is null"), "node", repeated))
    first = F.min(F.struct("doc_id", "start", "stop")).alias("first")
    last, hashes = F.max("doc_id").alias("last_doc"), F.first("bands", ignorenulls=True).alias("bands")
    classes = cut_lineage(candidates.groupBy("node").agg(first, last, F.count("*").alias("places"), hashes).where("places > 1 or bands is not null"))
    named = classes.where("bands is not null").select(F.lower(F.hex("node")).alias("node"), "first", "bands")
    labels = similar.link_classes(named.select("node", "bands"), _texts_of(documents, named.select("node", "first")), percent)
    labels = labels.select(F.unhex("node").alias("node"), F.unhex("component").alias("component"))
    owners = classes.join(labels, "node", "left").where("component is not null or places > 1")
    owners = cut_lineage(owners.select("node", "first", "last_doc", F.coalesce("component", "node").alias("component")))
    stays = owners.groupBy("component").agg(F.min("first").alias("stays"), F.max("last_doc").alias("last_doc"))
    if not within_documents:
        stays = stays.where("last_doc <> stays.doc_id")
    lookup = cut_lineage(owners.join(stays.drop("last_doc"), "component").select("node", "stays"))
    slim = found.select("node", "doc_id", "start", "stop", "n_words", F.col("bands").isNull().alias("is_piece"))
    slim = cut_lineage(likely(slim, "node", lookup))
    rows = lookup_join(slim, lookup, "node", row_count=slim.count()).where("stays is not null")
    kept = (F.col("doc_id") == F.col("stays.doc_id")) & (F.col("start") == F.col("stays.start"))

    def known(c: str):
        return F.when(F.col(c) != NO_ID, F.col(c))

    repeats = cut_lineage(rows.withColumn("kept", kept))
    gone = repeats.where("not kept and not is_piece").select(F.col("doc_id").alias("owner"), "start", "stop")
    runs = repeated_runs(documents, marks, gone, within_documents)
    inside = runs.select(F.col("owner").alias("doc_id"), F.col("start").alias("from_"), F.col("stop").alias("to_"))
    covered = repeats.where("is_piece").join(inside, "doc_id").where("from_ <= start and stop <= to_").select("doc_id", "start", "stop", "is_piece").distinct()
    repeats = repeats.join(covered, ["doc_id", "start", "stop", "is_piece"], "left_anti")
    found_runs = runs.select(
        known("owner").alias("doc_id"), "start", "stop", "n_words", F.lit(True).alias("is_piece"), known("first_owner").alias("first_doc_id"), "first_start", "kept"
    )
    return repeats.select(
        known("doc_id").alias("doc_id"), "start", "stop", "n_words", "is_piece", known("stays.doc_id").alias("first_doc_id"),
        F.col("stays.start").alias("first_start"), "kept",
    ).unionByName(found_runs)


def without_repeats(documents: DataFrame, **options) -> DataFrame:
    """The documents with all columns, the removed paragraphs and pieces cut out of ``text``."""
    spans = repeated_paragraphs(documents, **options).where("not kept")
    own, cuts = free_name(documents, "owner_"), free_name(documents, "cuts_")
    by_doc = spans.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias(own)).agg(F.collect_set(F.struct("start", "stop")).alias(cuts))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        out = []
        for text, a, b in zip(texts, starts, stops, strict=True):
            if text is not None and a is not None:
                at, parts = 0, []
                for start, stop in sorted(zip(a, b, strict=True)):
                    parts.append(text[at : max(at, start)])
                    at = max(at, stop)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype="object")

    rows = documents.withColumn(own, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).join(by_doc, own, "left")
    return rows.withColumn("text", cut("text", F.col(f"{cuts}.start"), F.col(f"{cuts}.stop"))).select(*documents.columns)
