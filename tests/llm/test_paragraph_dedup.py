from __future__ import annotations

from tests.llm.helpers import documents, edited, prose, rows
from vacantia.llm import paragraph_dedup as p


def test_repeats_are_found_and_the_first_stays(spark):
    passage, long_passage = prose(1, 60), prose(2, 70)
    near = [*passage[:40], "changed", *passage[41:]]
    given = [
        (10, " ".join(prose(10, 80)) + "\n" + " ".join(passage)),
        (4, " ".join(passage).upper() + "\n" + " ".join(prose(11, 30))),
        (7, "start\n" + " ".join(near)),
        (20, " ".join(prose(20, 90)) + ". " + " ".join(long_passage) + ". " + " ".join(prose(21, 90))),
        (21, " ".join(prose(22, 40)) + ". " + " ".join(long_passage) + ". " + " ".join(prose(23, 40))),
        (30, " ".join(prose(30, 200))), (31, "short line\n" * 30), (32, "short line\n" * 30), (33, None), (34, ""),
        (40, "\n".join([" ".join(prose(40, 50))] * 3)), (None, " ".join(prose(50, 45))), (51, " ".join(prose(50, 45))), (60, "é " * 100_000),
    ]
    docs = documents(spark, given)
    out = p.repeated_paragraphs(docs, skip_periodic=True).collect()
    assert {r["doc_id"] for r in out} == {4, 7, 10, 20, 21, None, 51}
    assert {r["doc_id"]: r["kept"] for r in out if not r["is_piece"]} == {4: True, 7: False, 10: False, None: False, 51: True}
    text = dict(given)
    found = [r for r in out if r["doc_id"] == 7][0]
    assert text[7][found["start"] : found["stop"]] == " ".join(near) and (found["first_doc_id"], found["first_start"]) == (4, 0)
    assert all(r["kept"] == (r["doc_id"] == 20) for r in out if r["is_piece"] and r["doc_id"] in (20, 21))
    cleaned = p.without_repeats(docs, skip_periodic=True)
    assert cleaned.columns == docs.columns
    after = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert after[7] == "start\n" and after[4] == text[4] and after[None] == "" and after[33] is None and after[30] == text[30]
    gone = sum(r["stop"] - r["start"] for r in out if r["doc_id"] == 21)
    assert gone > 80 and len(after[21]) == len(text[21]) - gone and after[20] == text[20]
    within = p.repeated_paragraphs(docs, within_documents=True, skip_periodic=True).where("doc_id = 40").collect()
    assert sorted(r["kept"] for r in within) == [False, False, True]


def test_shared_runs_of_fifty_words(spark):
    """Hard-wrapped lines, short passages in longer lines, text without sentence ends and a changed word: 50 shared words are found."""
    def plain(seed, n):
        return [w.strip(".") for w in prose(seed, n)]

    def wrapped(words):
        return "\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8))

    passages = [plain(100 + i, n) for i, n in enumerate((70, 52, 90, 120))]
    changed = [*passages[3][:60], "changed", *passages[3][61:]]
    parts = [
        (plain(1, 30), passages[0], plain(2, 37)), (plain(3, 41), passages[0], plain(4, 90)), (plain(5, 4), passages[1], plain(6, 4)),
        (plain(7, 40), passages[1], plain(8, 40)), (plain(9, 200), passages[2], plain(10, 200)), (plain(11, 80), passages[2], plain(12, 300)),
        (plain(13, 200), passages[3], plain(14, 200)), (plain(15, 80), changed, plain(16, 300)), (plain(17, 90), passages[1][:49], plain(18, 90)),
    ]
    given = [(i, "é\n\n" + (wrapped if i < 3 else " ".join)([*a, *b, *c])) for i, (a, b, c) in enumerate(parts, 1)]
    after = {r["doc_id"]: r["text"].split() for r in p.without_repeats(documents(spark, given)).collect()}
    left = {2: [], 4: [], 6: [], 8: ["changed"]}
    assert after == {i: ["é", *a, *left.get(i, b), *c] for i, (a, b, c) in enumerate(parts, 1)}


def test_links_equal_all_pairs(spark):
    base = prose(7, 60)
    given = [(i, " ".join(edited(base, i, 0.015))) for i in range(40)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in given]
    parent = list(range(40))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(40):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    expected = {(i, find(i)) for i in range(40) if sum(find(j) == find(i) for j in range(40)) > 1}
    assert {(r["doc_id"], r["first_doc_id"]) for r in p.repeated_paragraphs(documents(spark, given)).collect()} == expected


def test_no_documents(spark):
    assert rows(p.repeated_paragraphs(documents(spark, []))) == []
    assert p.without_repeats(documents(spark, [])).count() == 0


def test_periodic_text_repeats_too(spark):
    given = [(31, "short line\n" * 30), (32, "short line\n" * 30), (33, "one " * 60), (34, "x " + "one " * 52 + "y"), (60, "é " * 100_000), (61, "short line\n" * 9)]
    out = p.repeated_paragraphs(documents(spark, given)).collect()
    assert {(r["doc_id"], r["kept"]) for r in out} == {(31, True), (32, False), (33, True), (34, False)}
    assert sorted(r["n_words"] for r in out if r["doc_id"] in (33, 34)) == [52, 60] and len(out) <= 8
    after = {r["doc_id"]: r["text"].split() for r in p.without_repeats(documents(spark, given)).collect()}
    assert after[31] == ["short", "line"] * 30 and after[32] == [] and after[34] == ["x", "y"] and len(after[60]) == 100_000 and len(after[61]) == 18


def brute_runs(given, n=50):
    """Words of each document that lie in a run of n words which another document holds too, but those of the first one."""
    import collections

    held, windows = collections.defaultdict(set), {}
    for i, text in given:
        words = text.split()
        windows[i] = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        for w in windows[i]:
            held[w].add(i)
    gone = {}
    for i, text in given:
        cut = {k + j for k, w in enumerate(windows[i]) if min(held[w]) < i for j in range(n)}
        gone[i] = [x for k, x in enumerate(text.split()) if k not in cut]
    return gone


def test_runs_equal_brute_force_on_random_texts(spark):
    """Texts of shared and own parts without lines or sentences, below paragraph similarity: what is cut is what brute force finds."""
    import random

    random_ = random.Random(12)
    pool = [[w.strip(".") for w in prose(900 + i, random_.choice([49, 50, 51, 70, 140]))] for i in range(12)]
    given = []
    for i in range(40):
        parts = []
        for k in range(3):
            parts += [w.strip(".") for w in prose(1000 + 10 * i + k, random_.randrange(90, 200))]
            shared = random_.choice(pool)
            a = random_.choice([0, 0, random_.randrange(len(shared))])
            parts += shared[a:]
        given.append((i, " ".join(parts)))
    after = {r["doc_id"]: r["text"].split() for r in p.without_repeats(documents(spark, given)).collect()}
    assert after == brute_runs(given)


def test_stretches_leave_out_only_windows_that_come_again():
    import numpy as np

    random_ = np.random.default_rng(4)
    for _ in range(200):
        period = random_.integers(1, 7)
        words = np.concatenate([random_.integers(0, 3, random_.integers(0, 30)), np.tile(random_.integers(0, 3, period), 40), random_.integers(0, 3, random_.integers(0, 70))]).astype(np.uint64)
        if len(words) < p.RUN_WORDS:
            continue
        asked = random_.random(len(words) - p.RUN_WORDS + 1) < random_.choice([0.7, 1.0])
        at, last = p._stretches(words, asked)
        window = lambda i: tuple(words[i : i + p.RUN_WORDS])
        held = {window(i) for i in at.tolist()}
        assert set(at.tolist()) <= set(np.flatnonzero(asked).tolist()) and {window(i) for i in np.flatnonzero(asked).tolist()} == held
        covered = {k for i, j in zip(at.tolist(), last.tolist(), strict=True) for k in range(i, j + 1)}
        assert covered >= set(np.flatnonzero(asked).tolist()) and all(asked[k] for k in covered)


def test_chunks_hold_each_window_once_in_few_rows(spark):
    """Windows side by side travel as one row; taken apart again they are all windows outside what is gone, with their places in the text."""
    import numpy as np
    from pyspark.sql import functions as F

    from vacantia.llm import shingles

    given = [(1, "é " + " ".join(prose(1, 400))), (2, " ".join([*prose(2, 60), *["a", "b", "c", "d", "e", "f", "g"] * 60, *prose(3, 60)])), (3, "x y " * 100), (4, " ".join(prose(1, 400)[100:200]))]
    gone = {1: [(0, 300)], 2: [], 3: [], 4: []}
    expected = {}
    for i, text in given:
        words, starts, stops = shingles.words_with_places(text.lower().encode())
        chars = np.cumsum([(c & 0xC0) != 0x80 for c in b"x" + text.lower().encode()]) - 1
        starts, stops = chars[starts], chars[stops]
        free = np.array([all(not a <= s < b for a, b in gone[i]) for s in starts.tolist()])
        at, last = p._stretches(words, np.array([free[k : k + p.RUN_WORDS].all() for k in range(len(words) - p.RUN_WORDS + 1)]))
        for k, j in zip(at.tolist(), last.tolist(), strict=True):
            end = j + p.RUN_WORDS
            expected[i, k] = (end, starts[k], stops[end - 1], tuple(words[k : k + p.RUN_WORDS].tolist()))
    marks = {i: np.unique(p.least_hashes(shingles.words_with_places(t.lower().encode())[0]).astype(np.int64)).tolist() for i, t in given}
    rows_ = [(i, t, marks[i], [{"start": a, "stop": b} for a, b in gone[i]]) for i, t in given]
    asked = spark.createDataFrame(rows_, "owner bigint, text string, marks array<bigint>, gone array<struct<start:bigint,stop:bigint>>")
    chunks = asked.mapInArrow(p._chunks, p._CHUNK)
    found = p._windows_of(chunks).collect()
    assert len(found) == len(expected) and {(r["owner"], r["at"]): (r["until"], r["start"], r["stop"]) for r in found} == {k: v[:3] for k, v in expected.items()}
    nodes = {(bytes(r["node"]), expected[r["owner"], r["at"]][3]) for r in found}
    assert len({n for n, _ in nodes}) == len({w for _, w in nodes}) == len(nodes)
    prose_rows = chunks.where("owner = 4").agg(F.count("*").alias("rows"), F.sum("n").alias("windows")).first()
    assert 5 * prose_rows["rows"] < prose_rows["windows"] == 51


def test_distinct_shingles_and_bands_of_each_place():
    import numpy as np

    random_ = np.random.default_rng(5)
    words = random_.integers(0, 40, 900).astype(np.uint64)
    first = np.array([0, 0, 300, 880])
    sizes = np.array([900, 200, 60, 20])
    sets, n = p._distinct(words, first, sizes)
    assert [x.tolist() for x in np.split(sets, np.cumsum(n)[:-1])] == [sorted(set(words[a : a + k].tolist())) for a, k in zip(first, sizes, strict=True)]
    bands = p._bands(sets, n, 6)
    for row, own in zip(bands, np.split(sets, np.cumsum(n)[:-1]), strict=True):
        for i in range(6):
            hashed = p.similar.permuted(own, i)
            assert row[i] == p.shingles.mixed(hashed.min(keepdims=True) + p.shingles.mixed(hashed.max(keepdims=True) ^ np.uint64(i))).astype(np.int64)[0]


def test_short_texts_are_hashed_together(spark, monkeypatch):
    """Many texts take a few calls, and give what each gives alone: odd ones, repeated ids, blank lines at both ends, characters of several bytes."""
    import pyarrow as pa

    from tests.llm.helpers import SCHEMA

    odd = [None, "", "\n\n", "é \n\n" + "one two. three! " * 40 + "\n", "\n\nx y z\n" * 30, "a\n" * 300 + "\n\n", "x " * 9 + "\n" + "y " * 12 + "\n\nz", "ü " * 300_000, "\ud800 " * 60]
    given = odd + [("\n" * (i % 3)).join([" ".join(prose(i, 10 + i)), " ".join(prose(i % 7, 70)), "é\n"]) for i in range(200)] + odd
    batch = pa.RecordBatch.from_arrays([pa.array([None if i % 50 == 9 else i % 150 for i in range(len(given))], pa.int64()), pa.array([t and t.replace("\ud800", "") for t in given])], ["doc_id", "text"])
    kept, calls = [], []
    monkeypatch.setattr(type(spark.createDataFrame([], SCHEMA)), "mapInArrow", lambda self, work, schema: kept.append(work))
    whole = p.shingles.words_with_places
    monkeypatch.setattr(p.shingles, "words_with_places", lambda data: calls.append(len(data)) or whole(data))
    for skip in (False, True):
        p.units(documents(spark, []), skip_periodic=skip)

        def rows_of(batches):
            return sorted(repr(list(r.items())) for out in kept[-1](iter(batches)) for r in out.to_pylist())  # noqa: B023

        alone = rows_of([batch.slice(i, 1) for i in range(len(batch))])
        assert len(calls) == len(batch)
        calls.clear()
        assert rows_of([batch]) == alone and len(alone) > 1000 and len(calls) < 30
        calls.clear()
    texts = [t for some in p.side_by_side(given) for t in zip(some.begin.tolist(), some.end.tolist(), strict=True)]
    assert [b - a for a, b in texts] == [len((t or "").split()) for t in given]


def test_filter_before_a_join_has_every_slot_right(spark, capsys):
    """The rows whose slot some key has, in few and in many bitmaps; no row takes bytes of a bitmap apart."""
    from pyspark.sql import functions as F

    from vacantia.llm.common import likely

    given = spark.range(20_000).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    keys = given.where("k % 7 = 0").select("k")
    for bits in (64, 4096, 100_000, 1 << 26):
        slots = {r["k"]: r["s"] for r in given.select("k", F.pmod(F.xxhash64("k"), F.lit(bits)).alias("s")).collect()}
        taken = {slots[k] for k in range(0, 20_000, 7)}
        assert {r["k"] for r in likely(given, "k", keys, bits).collect()} == {k for k, s in slots.items() if s in taken}
    out = likely(given, "k", keys)
    assert out.columns == ["k", "v"] and likely(given, "k", keys.limit(0)).count() == 0
    out.explain()
    looks = [line for line in capsys.readouterr().out.splitlines() if "& 63)" in line]  # the steps that look at a bit
    assert looks and not any("conv(" in line or "substring" in line for line in looks)
