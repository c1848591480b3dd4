from __future__ import annotations

from collections import defaultdict

import pytest

from tests.llm.helpers import documents, prose, rows
from vacantia.llm import source_mix as m


def shares(sizes):
    """Targets by cutting and sharing again until nothing changes."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cut, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in cut)
        open_weight = sum(weight[s] for s in names if s not in cut)
        target = {s: 3 * sizes[s] if s in cut else weight[s] * left / open_weight for s in names}
        over = {s for s in names if s not in cut and target[s] > 3 * sizes[s]}
        if not over:
            return target
        cut |= over


@pytest.mark.parametrize("seed,sources", [(1, ["a", "b", "c", None]), (2, ["only"]), (3, ["big", "é", "z", "tiny", "empty"])])
def test_targets_and_taken_words(spark, seed, sources):
    given = []
    for i in range(600):
        source = sources[0] if i % 3 == 0 else sources[i % len(sources)]
        n = 0 if source == "empty" else 2 if source == "tiny" else 1 + (i * 7 * seed) % 90
        given.append((i, " ".join(prose(i, n)), source))
    given += [(1000, None, sources[0]), (1001, " \t ", sources[0]), (None, "a b", sources[0]), (5, "same id", sources[0]), (5, "same id", sources[0])]
    docs = documents(spark, given)
    out = m.mix(docs).collect()
    assert len(out) == len(given)
    sizes, largest, taken, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    by_id = defaultdict(list)
    for doc_id, text, source in given:
        n = len((text or "").split())
        sizes[source] += n
        largest[source] = max(largest[source], n)
        by_id[doc_id, n].append(source)
    for r in out:
        source = by_id[r["doc_id"], r["size"]][0]
        assert r["source_size"] == sizes[source] and 0 <= r["copies"] <= 3
        taken[source] += r["size"] * r["copies"]
        target[source] = r["target"]
    assert target == pytest.approx(shares(dict(sizes)))
    for source in sizes:
        assert abs(taken[source] - target[source]) <= max(1, largest[source] * 2)
    again = m.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    copies = m.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in out)


def test_no_documents_and_no_words(spark):
    assert rows(m.mix(documents(spark, []))) == []
    assert [(r["size"], r["target"], r["copies"]) for r in m.mix(documents(spark, [(1, None), (2, " ")])).collect()] == [(0, 0.0, 0)] * 2
    assert m.mixed_documents(documents(spark, [])).count() == 0
