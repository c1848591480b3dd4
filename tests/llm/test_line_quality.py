from __future__ import annotations

import itertools
import math
import random

import numpy as np

from tests.llm.helpers import documents, prose
from vacantia.llm import line_quality as q


def junk(seed, n):
    return " ".join(w.upper() + "!!" for w in prose(seed, n))


def corpus():
    """Good prose, junk, and junk behind an ordinary first line."""
    random_, texts, labels = random.Random(1), [], []
    for i in range(300):
        bad = i % 3 == 0
        lines = [junk(i * 10 + k, 15) if bad and k else " ".join(prose(i * 10 + k, random_.randrange(5, 30))) for k in range(random_.randrange(1 + bad, 6))]
        texts.append((i, "\n".join(lines)))
        labels.append((i, int(not bad)))
    return texts, labels


def test_marginals_equal_enumeration():
    random_ = np.random.default_rng(2)
    chain = q.Chain(random_.normal(size=3 * q.OWN), random_.normal(size=(2, 2)))
    own = random_.normal(size=(5, q.OWN)).astype(np.float32) / 4
    features = q.with_neighbours(own)
    emit, total, good = features @ chain.weights, 0.0, np.zeros(5)
    for labels in itertools.product((0, 1), repeat=5):
        value = math.exp(sum(emit[i] * y for i, y in enumerate(labels)) + sum(chain.steps[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        total += value
        good += value * np.array(labels)
    assert np.allclose(chain.marginals(features), good / total)


def test_gradient_is_that_of_the_likelihood():
    random_ = np.random.default_rng(3)
    docs = [random_.normal(size=(n, 4)) for n in (3, 1, 4)]
    sample, labels = q._Padded(docs), np.array([1, 0, 1, 1, 0, 0, 1, 0])
    weights, steps = random_.normal(size=4), random_.normal(size=(2, 2))

    def likelihood(w, s):
        out, at = 0.0, 0
        for i in sample.order:
            n = len(docs[i])
            own, emit = labels[at : at + n], docs[i] @ w

            def value(ys, emit=emit):
                return sum(e * y for e, y in zip(emit, ys, strict=True)) + sum(s[a, b] for a, b in zip(ys, ys[1:], strict=False))

            out += value(own) - math.log(sum(math.exp(value(ys)) for ys in itertools.product((0, 1), repeat=n)))
            at += n
        return out / len(labels)

    by_weight, by_step = sample.gradient(weights, steps, labels)
    for k in range(4):
        move = np.eye(4)[k] * 1e-6
        assert abs((likelihood(weights + move, steps) - likelihood(weights - move, steps)) / 2e-6 - by_weight[k]) < 1e-5
    for a, b in itertools.product((0, 1), repeat=2):
        move = np.zeros((2, 2))
        move[a, b] = 1e-6
        assert abs((likelihood(weights, steps + move) - likelihood(weights, steps - move)) / 2e-6 - by_step[a, b]) < 1e-5


def test_held_out_documents_and_odd_inputs(spark):
    texts, labels = corpus()
    texts += [(400, None), (401, ""), (402, "\n\n"), (403, "w " * 100_000), (None, "no id at all"), (3, texts[3][1])]
    docs = documents(spark, texts)
    known = spark.createDataFrame([(*x, 0) for x in labels] + [(5000, None, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    out = q.scored(docs, known, "score")
    assert out.columns == [*docs.columns, "score"]
    scores = [(r["doc_id"], r["score"]) for r in out.collect()]
    assert len(scores) == len(texts) and all(0 <= s <= 1 for _, s in scores)
    truth = dict(labels)
    held = {r[0] for r in docs.where(q.is_held_out(docs["doc_id"])).select("doc_id").collect()}
    right = [(s >= q.THRESHOLD) == truth[i] for i, s in scores if i in held and i in truth]
    assert len(right) > 40 and np.mean(right) > 0.95
    kept = q.good_documents(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(s >= q.THRESHOLD for _, s in scores)
    renamed = docs.withColumn("lang", docs["source"]).withColumn("source", docs["text"])
    assert sorted(r["score"] for r in q.scored(renamed, known, "score").collect()) == sorted(s for _, s in scores)


def test_without_labels_or_documents(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    schema = "doc_id long, quality int, toxic int"
    assert [r["score"] for r in q.scored(docs, spark.createDataFrame([], schema), "score").collect()] == [1.0, 1.0]
    assert [r["score"] for r in q.scored(docs, spark.createDataFrame([(1, 0, 0)], schema), "score").collect()] == [0.0, 0.0]
    assert q.scored(documents(spark, []), spark.createDataFrame([(1, 0, 0)], schema), "score").count() == 0


def test_training_is_bounded_by_lines_and_takes_a_document_once(spark):
    texts, labels = corpus()
    docs = documents(spark, texts + [(600, "good line here.\n" * 1_000_000), (604, "x\n" * 3000)] + [(3, texts[3][1])] * 3000 + [(8, "other row of an id")])
    known = spark.createDataFrame([(*x, 0) for x in labels] + [(600, 1, 0), (604, 0, 0)], "doc_id long, quality int, toxic int")
    plain = q.train(documents(spark, texts + [(8, "other row of an id")]), known)
    chain = q.train(docs, known)
    assert np.allclose(chain.weights, plain.weights) and np.allclose(chain.steps, plain.steps)
    few = q.train(docs, known, train_lines=60)
    assert isinstance(few, q.Chain) and not np.allclose(few.weights, plain.weights)
    assert q.train(docs, known, train_lines=0) == 1.0
