from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.helpers import documents, edited, prose, rows
from vacantia.llm import minhash_dedup as m, shingles, similar

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(text, size=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(given, size=3, percent=85):
    """Components over all pairs."""
    sets = [word_sets(t, size) for _, t in given]
    parent = list(range(len(given)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(given):
        groups.setdefault(find(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(given):
        known = [x for x in groups[find(i)] if x is not None]
        least = min(known) if known else None
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return out


def made(seed):
    """Copies, chains of edits whose ends are not similar, fans around one text, and texts that share a bucket but no link."""
    given, n = [], 0

    def add(words):
        nonlocal n
        given.append((n * 3 % 1009, " ".join(words)))
        n += 1

    base = prose(seed, 200)
    for i in range(40):
        add(edited(base, i, 0.02))
    chain = prose(seed + 1, 150)
    for i in range(30):
        add(chain)
        chain = edited(chain, 1000 + i, 0.02)
    for i in range(30):
        add(edited(prose(seed + 2, 120), 2000 + i, 0.045))
    for i in range(40):
        add(prose(9000 + i, 1 + i))
    for _ in range(25):
        add(base)
    return given


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["a bb  ccc", "", None, "\tx\ny ", "É é", "a bb ccc " * 50_000]
    alone = [next(iter(shingles.shingle_sets([t], 3))) for t in texts]
    assert all((a == b).all() for a, b in zip(alone, shingles.shingle_sets(texts, 3), strict=True))
    assert [len(x) for x in alone] == [len(word_sets(t)) for t in texts]
    same, other = shingles.shingle_sets(["A b", "a B", "b a"], 3), None
    first, second, other = same
    assert (first == second).all() and (first != other).all()


def test_signatures_estimate_similarity_with_half_the_hashes():
    a, b = set(range(1000)), set(range(150, 1150))
    x, y = (shingles.mixed(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in (a, b))
    low, high = similar.min_max(x, 500), similar.min_max(y, 500)
    agree = np.mean([(p == q).mean() for p, q in zip(low, high, strict=True)])
    assert abs(agree - len(a & b) / len(a | b)) < 0.05


@pytest.mark.parametrize("seed", [5, 77])
def test_components_equal_all_pairs(spark, seed):
    given = made(seed)
    given += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "ONE"), (2004, "one two"), (None, given[0][1]), (None, "alone here now"), (2005, "w " * 100_000), (2006, "w " * 100_001)]
    random.Random(seed).shuffle(given)
    docs = documents(spark, given)
    got = rows(m.near_duplicates(docs))
    assert sorted(map(str, got)) == sorted(map(str, brute(given)))


def test_hot_bucket_with_two_components(spark):
    """Many texts around two centres: no single star reaches all of them."""
    a, b = prose(1, 300), prose(1, 300)
    b[100:124] = prose(3, 24)
    given = [(i, " ".join(edited(a if i % 2 else b, i, 0.01))) for i in range(80)]
    assert sorted(map(str, rows(m.near_duplicates(documents(spark, given))))) == sorted(map(str, brute(given)))


def given_sets(spark, sets):
    """A fetch of sets held by the test, each sent ``times`` times."""
    def fetch(wanted, times=1):
        asked = [(r["node"], p) for r in wanted.collect() for p in r["partners"]]
        return spark.createDataFrame([(p, n, similar.packed(sets[n])) for n, p in asked] * times, similar.SENT)

    return fetch


def grouped(labels):
    groups = {}
    for r in labels.collect():
        groups.setdefault(r["component"], set()).add(r["node"])
    return sorted(map(sorted, groups.values()))


def test_star_rounds_end_with_the_links_they_find(spark, monkeypatch):
    """One bucket of two clusters that are not linked: the second is joined in the second round, and a third has nothing to try."""
    sets = {f"{c}{i}": np.arange(k, k + 100, dtype=np.uint64) << np.uint64(16) for k, c in ((0, "a"), (5000, "b")) for i in range(6)}
    calls, compare = [], similar.compared

    def counting(*args):
        calls.append(1)
        assert len(calls) < 5, "the rounds do not end"
        return compare(*args)

    monkeypatch.setattr(similar, "compared", counting)
    classes = spark.createDataFrame([(n, [1]) for n in sets], "node string, bands array<bigint>")
    assert grouped(similar.link_classes(classes, given_sets(spark, sets), 85)) == [[f"{c}{i}" for i in range(6)] for c in "ab"]


def test_exact_step_with_every_row_repeated(spark):
    """x and y are linked near the threshold and meet no centre that is linked with them, so only their first tokens join them."""
    sets = {c: np.arange(k, k + 100, dtype=np.uint64) << np.uint64(16) for c, k in (("z", 9000), ("w", 7000), ("x", 0), ("y", 8))}
    fetch, classes = given_sets(spark, sets), spark.createDataFrame([(n, [1]) for n in sets], "node string, bands array<bigint>")
    assert similar.linked(sets["x"], sets["y"], 85)
    for times in (1, 2):
        assert grouped(similar.link_classes(classes, lambda wanted, k=times: fetch(wanted, k), 85)) == [["x", "y"]]


def test_one_document_of_each_group_stays(spark):
    base = prose(4, 100)
    near = [*base[:50], "changed", *base[51:]]
    given = [(5, " ".join(base)), (3, " ".join(base)), (9, " ".join(near)), (7, "other words in this one"), (7, "other words in this one"), (None, "no id"), (8, None)]
    docs = documents(spark, given)
    out = m.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "7", "8", "None"]


def test_centre_without_id(spark):
    """A class held only by rows without doc_id joins two documents that are not linked with each other, and is the centre of their buckets."""
    base = prose(6, 200)
    left, right = [*base[:60], *prose(7, 8), *base[68:]], [*base[:130], *prose(8, 8), *base[138:]]
    alone = prose(9, 50)
    given = [(1, " ".join(left)), (None, " ".join(base)), (None, " ".join(base)), (2, " ".join(right))]
    given += [(None, " ".join(alone)), (None, " ".join(alone).upper()), (None, " ".join([*alone[:49], "end"]))]
    docs = documents(spark, given)
    assert sorted(map(str, rows(m.near_duplicates(docs)))) == sorted(map(str, brute(given)))
    assert len({r[2] for r in brute(given)[:4]}) == 1 and {r[2] for r in brute([given[0], given[3]])} == {1, 2}
    assert sorted(str(r["doc_id"]) for r in m.deduplicated(docs).collect()) == ["1", "None"]


def test_no_documents(spark):
    assert rows(m.near_duplicates(documents(spark, []))) == []
    assert m.deduplicated(documents(spark, [])).count() == 0
