from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import documents, prose, rows
from vacantia.llm import pitman_yor as p, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def corpus():
    given = [(i, " ".join(prose(i % 40, 60, 300)).capitalize()) for i in range(200)]
    return given + [(300, None), (301, ""), (302, " \n"), (None, "w1 w2"), (5, given[5][1]), (303, "long " * 200_000), (304, "never seen words")]


@pytest.mark.parametrize("shard_bytes,task_tokens", [(48 << 20, 24_000_000), (20_000, 300)])
def test_base_scores_and_counts(spark, shard_bytes, task_tokens):
    given = corpus()
    out = p.scores(documents(spark, given), shard_bytes=shard_bytes, task_tokens=task_tokens).collect()
    known = Counter(t for i, text in given if not held_out(i) for t in tokens(text))
    n, v = sum(known.values()), len(known)
    expected = []
    for i, text in given:
        own = tokens(text)
        base = sum(math.log10((known[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        expected.append((str(i), held_out(i), len(own), sum(known[t] > 0 for t in own), n, round(base, 5)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out]
    assert sorted(got) == sorted(expected)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    better = [r["score"] > r["base_score"] for r in out if r["held_out"] and r["n_tokens"] > 30]
    assert sum(better) > 0.9 * len(better)


def test_scores_do_not_depend_on_the_run(spark):
    docs = documents(spark, corpus())
    assert sorted(map(str, p.scores(docs).collect())) == sorted(map(str, p.scores(docs).collect()))


def test_predictions_sum_to_one(spark):
    docs = documents(spark, [(i, " ".join(prose(i, 50, 60))) for i in range(60)])
    seated, totals = p.trained(p.prepared(docs), 3)
    models = [p.ShardModel(r, totals) for _, r in seated.toPandas().iterrows()]
    for context in range(0, p.RESTAURANTS, 4096):
        some = np.uint16(context)
        mass = totals.new_table[context] * models[0].unknown
        for m in models:
            mass += m.predict(m.words, np.ones(len(m.words), np.int64), np.full(len(m.words), some))[0].sum()
        assert mass == pytest.approx(1, abs=1e-5)
    word, before = (shingles.word_hashes([x])[0] for x in (b"w5", b"w7"))
    assert p.tokens_of(["W5 w7", None, ""])[0].tolist() == [word[0], before[0], p.END, p.END, p.END]


def test_seating_follows_its_distribution():
    discount, customers, weight = 0.6, 6, 0.8
    logs = p.log_stirling(discount, 8)
    exact = np.exp(logs[customers, 1 : customers + 1] + np.arange(1, customers + 1) * math.log(weight))
    drawn = p.sample_tables(np.full(40_000, customers), np.full(40_000, weight), p.log_stirling(discount, p.EXACT), discount, np.random.default_rng(1))
    share = np.bincount(drawn.astype(int), minlength=customers + 1)[1:] / 40_000
    assert np.abs(share - exact / exact.sum()).max() < 0.01
    many = p.sample_tables(np.full(200, 100_000), np.full(200, 5.0), p.log_stirling(discount, p.EXACT), discount, np.random.default_rng(2))
    assert 1 <= many.min() and many.max() <= 100_000 and many.mean() > 20


def test_stirling_numbers_by_recursion():
    logs = np.exp(p.log_stirling(0.3, 4))
    assert logs[1, 1] == pytest.approx(1) and logs[2, 1] == pytest.approx(0.7) and logs[3, 1] == pytest.approx(0.7 * 1.7)
    assert logs[3, 2] == pytest.approx(0.7 + 1.4) and logs[4, 4] == pytest.approx(1)


def test_empty_tables(spark):
    assert rows(p.scores(documents(spark, []))) == []
    only_held = next(i for i in range(100) if held_out(i))
    out = p.scores(documents(spark, [(only_held, "a b")])).collect()
    assert [(r["n_known"], r["train_tokens"], r["n_tokens"]) for r in out] == [(0, 0, 3)]


def test_counts_are_merged_in_steps_and_never_clipped(spark, monkeypatch):
    docs = p.prepared(documents(spark, corpus()).repartition(40))
    monkeypatch.setattr(p, "FAN_IN", 3)
    steps, whole = (sorted(p.counted(docs, 2, n).toPandas().itertuples(index=False), key=lambda r: r.shard) for n in (40, 1))
    assert [tuple(r) for r in steps] == [tuple(r) for r in whole]
    assert sum(r.tokens for r in steps) == sum(len(tokens(t)) for _, t in corpus())
    one = np.array([7], np.uint64), np.array([1], np.uint32), np.array([3], np.uint16)
    merged = p._merged([(*one, np.array([2**32 - 1], np.uint32)), (*one, np.array([5], np.uint32))])[2]
    assert merged.tolist() == [2**32 + 4]
    packed = [x.tobytes() for x in (*one, p.narrow(merged))]
    assert p._unpack(*packed)[3].tolist() == [2**32 + 4] and p._unpack(*packed[:3], p.narrow(np.array([9])).tobytes())[3].tolist() == [9]
    assert p._merged([p._unpack(*packed), (*one, np.array([5], np.uint32))])[2].tolist() == [2**32 + 9]
