from __future__ import annotations

import numpy as np
import pytest

from tests.llm.helpers import documents, prose
from vacantia.llm import line_dedup as d


def brute(given):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    holders = {}
    for doc_id, text in given:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in given:
        lines = (text or "").split("\n")
        own = -1 if doc_id is None else doc_id
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == own]
        out.append((own, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("broadcast_bytes,shard_keys", [(1 << 20, 50_000), (0, 3)])
def test_equals_brute_force_by_either_way(spark, broadcast_bytes, shard_keys):
    common = [" ".join(prose(i, 12)) for i in range(12)]
    short, exact, below = "s" * 39, "é" * 40, "é" * 39 + " "
    given = [(i, "\n".join([common[i % 12], f"  {common[(i * 5) % 12].upper()}\t", short, exact, below, "", common[i % 12]])) for i in range(60)]
    given += [(60, None), (61, ""), (None, common[0] + "\n" + common[1]), (59, common[3]), (59, common[3]), (62, "x y " * 40_000)]
    docs = documents(spark, given)
    out = d.drop_repeated_lines(docs, broadcast_bytes=broadcast_bytes, shard_keys=shard_keys, name="found")
    assert out.columns == [*docs.columns, "found"]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["found"]["text"], r["found"]["n_lines"], r["found"]["n_dropped"]) for r in out.collect())
    assert got == brute(given)


def test_perfect_hash_is_minimal():
    low = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 5000, np.uint64))
    levels = d.build_mph(low)
    index = d.ShardIndex(np.array([len(x) for x in levels]).tobytes(), np.packbits(np.concatenate(levels)).tobytes(), b"", b"", b"")
    assert sorted(index.slot(low)) == list(range(len(low)))


def test_no_documents(spark):
    assert d.drop_repeated_lines(documents(spark, [])).count() == 0
