"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets features of its own characters and words and those of the lines before and after it. The chain labels each line good
(1) or bad (0); forward-backward gives each line's probability of being good, and the mean of these, weighted by line length, becomes
the document's quality through a logistic curve fitted on document labels.

Only document labels exist, so lines are labelled in rounds: first each line as its document; then, in bad documents, each line as the fitted
chain sees it, at least the worst line staying bad; and the chain is fitted again.

Training uses a bounded sample: of the ``SAMPLE_DOCS`` labelled documents of each class that come first in a hash order of doc_id, those of at most
``MAX_LINES`` lines, whole, as many as ``TRAIN_LINES`` lines hold; of a repeated doc_id one row. Only their feature rows reach
the driver. Scoring is one pass over all documents without a shuffle.

Defined results: null or empty text is one empty line and gets a score like any other; a document labelled more than once counts as its
lowest label; null labels are ignored; without labels of both classes every score is the share of label 1, or 1 with no label at all; every row and
column of documents is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vacantia.llm.common import cut_lineage, free_name, lean, release, slices

SAMPLE_DOCS = 2500
#: A labelled document of more lines is not trained on.
MAX_LINES = 2000
#: Lines that training looks at, half of them from each class.
TRAIN_LINES = 200_000
THRESHOLD = 0.7
ROUNDS = 3
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
_CLASSES = [_UPPER, _DIGITS, b"!?", b"*#$%&@^~+=", b"|", b"<>{}[]\\/_", b".,;:'\"()-"]
OWN = 31


def _words(words: list[str], n: int) -> list[float]:
    distinct = len(set(words))
    odd = sum(1 for w in words if not (w[-1].isalpha() or w[-1] in ".,;:'\")"))
    repeats = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    return [distinct / n, odd / n, repeats / n, sum(map(len, words)) / n / 10, sum(1 for w in words if len(w) == 1) / n, max(map(len, words)) / 40]


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, without its neighbours'; weight of each line)."""
    lines = (text or "").split("\n")
    rows, seen = [], set()
    for line in lines:
        data, words = line.encode("utf-8", "surrogatepass"), line.split()
        n, size = len(words), max(1, len(line))
        shares = [(len(data) - len(data.translate(None, c))) / size for c in _CLASSES]
        letters = (len(data) - len(data.translate(None, _LETTERS))) / max(1, len(data))
        about = _words(words, n) if n else [0.0] * 6
        flags = [
            n == 0, n <= 2, n >= 60, shares[0] > 0.5, shares[1] > 0.3, shares[2] > 0.05, shares[3] > 0.05, shares[4] > 0.03, shares[5] > 0.05,
            about[0] < 0.5 and n > 5, about[0] < 0.2 and n > 5, about[1] > 0.5, about[2] > 0.1, n > 0 and line in seen, line[-1:] in ".!?:",
        ]
        seen.add(line)
        rows.append([1.0, math.log1p(n) / 5, *shares, letters, *about, *map(float, flags)])
    return np.array(rows, np.float32), np.array([len(x) + 1 for x in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    nothing = np.zeros((1, own.shape[1]), own.dtype)
    return np.hstack([own, np.vstack([nothing, own[:-1]]), np.vstack([own[1:], nothing])]).astype(np.float64)


@dataclass
class Chain:
    """Weights of the good label's score, the score of each pair of neighbouring labels, and the curve from mean to quality."""

    weights: np.ndarray
    steps: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Probability of good for each line, by forward-backward in plain floats."""
        emit = np.exp(np.clip(features @ self.weights, -30, 30)).tolist()
        (a, b), (c, d) = np.exp(self.steps).tolist()
        ahead, bad, good = [], 1.0, 1.0
        for i, e in enumerate(emit):
            if i:
                bad, good = bad * a + good * c, bad * b + good * d
            good *= e
            total = bad + good
            bad, good = bad / total, good / total
            ahead.append((bad, good))
        out, bad, good = [0.0] * len(emit), 1.0, 1.0
        for i in range(len(emit) - 1, -1, -1):
            p, q = ahead[i][0] * bad, ahead[i][1] * good
            out[i] = q / (p + q)
            e = emit[i] * good
            bad, good = a * bad + b * e, c * bad + d * e
            total = bad + good
            bad, good = bad / total, good / total
        return np.array(out)

    def mean(self, own: np.ndarray, lengths: np.ndarray) -> float:
        return float((self.marginals(with_neighbours(own)) * lengths).sum() / lengths.sum())

    def quality(self, mean: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * _log_odds(mean) + self.offset))))


def _log_odds(p: float) -> float:
    p = min(1 - 1e-4, max(1e-4, p))
    return math.log(p / (1 - p))


class _Padded:
    """Documents of the sample side by side, longest first, for forward-backward over all of them at once."""

    def __init__(self, documents: list[np.ndarray]):
        self.order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        lengths = np.array([len(documents[i]) for i in self.order])
        self.active = [int((lengths > t).sum()) for t in range(lengths.max())]
        self.row = np.zeros((len(documents), len(self.active)), np.int64)  # place of each line in the stacked features
        self.features = np.vstack([documents[i] for i in self.order])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for t in range(len(self.active)):
            self.row[: self.active[t], t] = starts[: self.active[t]] + t

    def stacked(self, values: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([values[i] for i in self.order])

    def gradient(self, weights: np.ndarray, steps: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the mean log likelihood of the line labels."""
        emit = np.exp(np.clip(self.features @ weights, -30, 30))
        m, n_docs, width = np.exp(steps), len(self.row), len(self.active)
        ahead = np.zeros((n_docs, width, 2))
        for t, k in enumerate(self.active):
            now = ahead[:k, t - 1] @ m if t else np.ones((k, 2))
            now[:, 1] *= emit[self.row[:k, t]]
            ahead[:k, t] = now / now.sum(axis=1, keepdims=True)
        back, good, pairs = np.ones((n_docs, 2)), np.zeros(len(emit)), np.zeros((2, 2))
        for t in range(width - 1, -1, -1):
            k = self.active[t]
            both = ahead[:k, t] * back[:k]
            both /= both.sum(axis=1, keepdims=True)
            good[self.row[:k, t]] = both[:, 1]
            later = back[:k].copy()
            later[:, 1] *= emit[self.row[:k, t]]
            if t:
                joint = ahead[:k, t - 1, :, None] * m[None] * later[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            now = later @ m.T
            back[:k] = now / now.sum(axis=1, keepdims=True)
        seen = np.zeros((2, 2))
        for t in range(1, width):
            k = self.active[t]
            np.add.at(seen, (labels[self.row[:k, t - 1]], labels[self.row[:k, t]]), 1)
        n = len(emit)
        return self.features.T @ (labels - good) / n, (seen - pairs) / n


def _fit_chain(sample: _Padded, labels: np.ndarray, start: Chain, rounds: int = 100, rate: float = 0.1, shrink: float = 1e-4) -> Chain:
    """Gradient ascent with running moments."""
    weights, steps = start.weights.copy(), start.steps.copy()
    first, second = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for i in range(1, rounds + 1):
        by_weight, by_step = sample.gradient(weights, steps, labels)
        slope = np.concatenate([by_weight - shrink * weights, (by_step - shrink * steps).ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
        weights += move[:-4]
        steps += move[-4:].reshape(2, 2)
    return Chain(weights, steps)


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rounds: int = ROUNDS) -> Chain:
    """Chain for documents given as (own features, line lengths) with a label of 0 or 1 each; both labels must occur."""
    features = [with_neighbours(own) for own, _ in documents]
    sample = _Padded(features)
    lines = [np.full(len(f), y, np.int64) for f, y in zip(features, labels, strict=True)]
    chain = Chain(np.zeros(features[0].shape[1]), np.zeros((2, 2)))
    for i in range(rounds):
        chain = _fit_chain(sample, sample.stacked(lines), chain)
        if i < rounds - 1:
            for k, (f, y) in enumerate(zip(features, labels, strict=True)):
                if y == 0:
                    good = chain.marginals(f)
                    lines[k] = (good > max(0.5, good.min())).astype(np.int64)
    odds = np.array([_log_odds(chain.mean(*d)) for d in documents])
    chain.slope, chain.offset = _logistic(odds, np.array(labels, np.float64))
    return chain


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton steps for P(y) = 1 / (1 + exp(-(slope x + offset))), slightly shrunk."""
    design, at = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * at)
        at = at + np.clip(step, -2, 2)
    return float(at[0]), float(at[1])


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def is_held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


def train(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, train_lines: int = TRAIN_LINES) -> Chain | float:
    """The chain, or a constant score where labels of both classes are missing."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    order = [F.xxhash64(F.lit(11), "doc_id"), "doc_id"]
    first = [known.where(F.col("label") == y).orderBy(*order).limit(sample_docs) for y in (0, 1)]
    chosen = first[0].unionByName(first[1])  # at most 2 * sample_docs rows of two numbers

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch)):
            found = [line_features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.tobytes() for f, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary()), *batch.columns[1:]],
                ["features", "lengths", "label", "doc_id", "n_lines", "place"],
            )

    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.where(n_lines <= MAX_LINES).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    counted = texts.select("text", "label", "doc_id", n_lines.cast("bigint").alias("n_lines"), F.xxhash64(F.lit(11), "doc_id").alias("place"))
    described = cut_lineage(counted.mapInArrow(lean(describe), "features binary, lengths binary, label int, doc_id bigint, n_lines bigint, place bigint"))
    used = []
    for y in (0, 1):  # in hash order, as many whole documents as fit
        left = train_lines // 2
        for r in described.where(F.col("label") == y).select("doc_id", "n_lines", "place").orderBy("place", "doc_id").collect():
            if r["n_lines"] <= left:
                used.append((r["doc_id"],))
                left -= r["n_lines"]
    spark = documents.sparkSession
    rows = described.join(F.broadcast(spark.createDataFrame(used, "doc_id bigint")), "doc_id").select("features", "lengths", "label", "doc_id").collect()
    rows.sort(key=lambda r: r["doc_id"])
    given = [r["label"] for r in rows]
    if len(set(given)) < 2:
        return float(given[0]) if given else 1.0
    return fit([(np.frombuffer(r["features"], np.float32).reshape(-1, OWN), np.frombuffer(r["lengths"])) for r in rows], given)


def scored(documents: DataFrame, labels: DataFrame, name: str, **options) -> DataFrame:
    """Documents with a column ``name``: the quality of the whole text, 0 to 1."""
    chain = documents.sparkSession.sparkContext.broadcast(train(documents, labels, **options))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = chain.value
        try:
            for texts in batches:
                if isinstance(model, float):
                    yield pa.array([model] * len(texts), pa.float64())
                else:  # one text at a time becomes a Python value
                    yield pa.array((model.quality(model.mean(*line_features(t.as_py()))) for t in texts), pa.float64())
        finally:
            release()

    return documents.withColumn(name, score("text"))


def good_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents of at least the threshold's quality, with their columns."""
    name = free_name(documents, "quality_")
    return scored(documents, labels, name, **options).where(F.col(name) >= threshold).select(*documents.columns)
