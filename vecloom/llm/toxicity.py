"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import drawn, map_arrow, slices, where_text

SCHEMA = "toxicity double, toxic boolean, offending_at array<int>, offending array<string>"
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"\w+")
PREFIXES = (4, 6)
_CACHED = 200_000


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s]


def features(word: str) -> list[str]:
    """A word and its beginnings, which tell families of words of which each is rare."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


class _Known(dict):
    """The features with a weight of each word that was asked for."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word):
        if len(self) >= _CACHED:
            self.clear()
        value = self[word] = tuple(f for f in features(word) if f in self.weights)
        return value


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    threshold: float

    def __post_init__(self):
        self.known = _Known(self.weights)

    def __getstate__(self):
        return self.weights, self.bias, self.threshold

    def __setstate__(self, state):
        self.__init__(*state)

    def logits(self, parts: list[str]) -> np.ndarray:
        """The sum of the weights of each sentence's distinct features, and the bias."""
        known, get, find = self.known.__getitem__, self.weights.__getitem__, WORD.findall
        return np.array([sum(map(get, set().union(*filter(None, map(known, set(find(s.lower()))))))) for s in parts], float) + self.bias

    def judge(self, text: str | None) -> tuple[float, bool, list[int], list[str]]:
        parts = sentences(text) if text else []
        if not parts:
            return 0.0, False, [], []
        z = np.maximum(self.logits(parts), self.bias)
        whole = float(-np.expm1(len(z) * np.logaddexp(0, self.bias) - np.logaddexp(0, z).sum()))
        if whole < self.threshold:
            return whole, False, [], []
        at = np.flatnonzero(z >= min(0.0, z.max() - 1))
        return whole, True, at.tolist(), [parts[k] for k in at]


def _log_tail(n: int, hits: int, rate: float) -> float:
    """The logarithm of the chance of hits or more in n draws of the rate; 0 if that many are to be expected."""
    if hits <= n * rate:
        return 0.0
    one = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    parts = [one(k) for k in range(hits, min(n, hits + 50) + 1)]  # those beyond are smaller still
    return max(parts) + math.log(sum(math.exp(x - max(parts)) for x in parts))


def train(bags: list[list[list[str]]], labels: list[int], *, least_documents: int = 3, l2: float = 0.005, rounds: int = 200, threshold: float = 0.5) -> Model:
    """A leaky noisy-or over logistic sentence scores, fitted to the labels of bags of sentences of distinct words.

    P(toxic) = 1 - (1 - leak) * prod(1 - p(sentence)). The leak takes up documents whose label no sentence explains, so
    that they don't raise the score of every sentence; it is not part of the score. Without both labels the model
    calls nothing toxic. Copies of a bag count once. A feature is a word or a word's beginning, so that words too rare to
    count for themselves count as a family. Features of fewer than least_documents bags don't count, nor do those that
    aren't in more toxic bags than chance gives one feature of all (else rare ones learn their documents' labels by heart).
    """
    seen: dict[tuple, int] = {}
    for bag, label in zip(bags, labels):
        key = tuple(map(tuple, bag))
        seen[key] = max(label, seen.get(key, 0))
    bags, labels = list(seen), list(seen.values())
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, -20.0, threshold)
    words = [set().union(*bag) for bag in bags]
    of = {w: features(w) for w in set().union(*words)}
    df: dict[str, list[int]] = {}
    for own, label in zip(words, labels):
        for f in set().union(*map(of.__getitem__, own)):
            n = df.setdefault(f, [0, 0])
            n[0] += 1
            n[1] += label
    df = {w: n for w, n in df.items() if n[0] >= least_documents}
    chance = math.log(max(1, len(df)))
    vocabulary = {w: k for k, w in enumerate(sorted(w for w, (n, hits) in df.items() if _log_tail(n, hits, y.mean()) <= -chance))}
    places = {w: own for w, fs in of.items() if (own := [vocabulary[f] for f in fs if f in vocabulary])}
    row, col, bag_of = [], [], []
    for b, bag in enumerate(bags):
        for s in bag:
            own = sorted({k for w in s if w in places for k in places[w]})
            row += [len(bag_of)] * len(own)
            col += own
            bag_of.append(b)
    row, col, bag_of = np.array(row, np.int64), np.array(col, np.int64), np.array(bag_of, np.int64)
    n, v = len(bag_of), len(vocabulary)
    weight = 1 / len(y)
    # Adam
    theta = np.concatenate([np.zeros(v), [-5.0, -3.0]])
    m, s2 = np.zeros(v + 2), np.zeros(v + 2)
    for t in range(1, rounds + 1):
        w, bias, leak = theta[:v], theta[v], theta[v + 1]
        z = np.bincount(row, w[col], n) + bias if len(row) else np.full(n, bias)
        p = 1 / (1 + np.exp(-z))
        log_not = -np.bincount(bag_of, np.logaddexp(0, z), len(y)) - np.logaddexp(0, leak)
        none = np.exp(log_not)
        # d loss / d log_not, where loss = -log P for positive and -log_not for negative documents
        g = weight * np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0)
        gz = g[bag_of] * -p
        grad = np.concatenate([np.bincount(col, gz[row], v) + l2 / len(y) * w, [gz.sum()], [(-g / (1 + np.exp(-leak))).sum()]])
        m, s2 = 0.9 * m + 0.1 * grad, 0.99 * s2 + 0.01 * grad**2
        theta -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(s2 / (1 - 0.99**t)) + 1e-9)
    return Model({w: float(theta[k]) for w, k in vocabulary.items()}, float(theta[v]), threshold)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_label: int = 2500,
    seed: int = 11,
    **options,
) -> Model:
    """Sentence weights from at most rows_per_label labelled documents of each label, drawn in a seeded order.

    That is the documented bound of the fit. Rows of the same id and text are one document. Labels other than 0 and 1, null labels and texts, and labels of absent
    documents don't count; of several labels of a document the largest holds.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    sample = drawn(docs, known, id_col, text_col, rows_per_label, seed).select("id", "text", "label")

    def start():
        def step(batch):
            for part in slices(batch, 1):
                ids, texts, y = (c.to_pylist() for c in part.columns)
                bags = [[sorted(set(WORD.findall(s.lower()))) for s in sentences(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(y, pa.int32()), pa.array(bags, pa.list_(pa.list_(pa.string())))], names=["id", "y", "bag"])

        return step

    got = map_arrow(sample, "id string, y int, bag array<array<string>>", start).toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"] or "", r["bag"]))
    return train([r["bag"] for r in got], [r["y"] for r in got], **options)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, toxicity, toxic, offending_at, offending) for each row of docs; other columns are not looked at.

    toxicity is the noisy-or of the scores of all sentences, less that of as many sentences without any feature, so that a
    document isn't toxic by its length alone. A document is toxic if that reaches the threshold, be it by
    many sentences of which none is likely toxic for itself. offending_at holds the places, counted from 0, of the sentences
    that are likely toxic or near the worst one (a logit of 0, or of the largest less 1), and offending their texts; both
    are empty for other documents. Null, empty and blank texts have toxicity 0 and are not toxic. Repeated rows give
    repeated results. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}"

    def start():
        m = shared.value

        def step(batch):
            for part in slices(batch, 1):
                cols = list(zip(*map(m.judge, part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.round(cols[0], 6), pa.float64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.string()))],
                    names=[id_col, "toxicity", "toxic", "offending_at", "offending"],
                )

        return step

    return map_arrow(docs.select(id_col, text_col), schema, start)


def civil(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that score() doesn't call toxic; each row is judged for itself, whatever its id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return where_text(docs, text_col, lambda: lambda texts: [not shared.value.judge(t)[1] for t in texts])
