"""Toxicity by multiple-instance learning.

Only documents have labels. A document is a bag of sentences; each sentence has a score
p = sigmoid(bias + sum of the weights of its distinct words, and of the words' beginnings
of four to six characters, which inflected words share), and the document is toxic
if any sentence is: P = 1 - (1 - leak) * product(1 - p), a noisy-or. Weights, bias and
leak maximise the likelihood of document labels, so the credit for a toxic document
falls on the sentences whose words set it apart, and those are reported with their
places. The leak takes labels that no sentence explains, whatever a text's length.

Fitting uses a bounded sample (`most_of_each` rows of a class, a documented parameter);
scoring covers every sentence of every whole text. Null and empty texts have no
sentence: their score is the leak. Repeated rows score alike.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagewright.llm.labelled import labelled_sample
from pagewright.llm.shared import append_columns

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")

#: Entries of the per-task table of word weights.
CACHE_ENTRIES = 400_000


@dataclass(frozen=True)
class ToxicModel:
    """weights: of words, and of beginnings marked with a caret; leak: a document's score without any sentence."""

    weights: dict[str, float]
    bias: float
    leak: float


def features(word: str) -> list[str]:
    """A lower-case word and its beginnings."""
    return [word, *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


def sentence_words(text: str) -> list[set[str]]:
    return [words for s in _SENTENCE.findall(text.lower()) if (words := set(_WORD.findall(s)))]


class Bags:
    """Texts as bags of sentences, split anew at each reading: held as words they take many times their bytes."""

    def __init__(self, texts: list[str]):
        self.texts = texts

    def __iter__(self):
        return map(sentence_words, self.texts)


def fit_bags(bags: Iterable[list[set[str]]], labels: list[int], share: dict[int, float] | None = None, least_documents: int = 4, penalty: float = 0.2, rounds: int = 160) -> ToxicModel:
    """Noisy-or maximum likelihood by Adam over all bags at once.

    Weights are not negative, so no harmless word can hide an offending one beside it;
    an exponential prior (`penalty`) leaves most of them at nought.

    share: weight of each class, to undo unequal sampling. Features of fewer than
    `least_documents` bags have no weight.
    """
    y = np.array(labels, dtype=bool)
    prior = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.001
    if not y.any() or y.all():
        return ToxicModel({}, -12.0, prior if y.any() else 0.001)
    seen = Counter(f for bag in bags for f in {f for w in set().union(*bag) for f in features(w)})
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least_documents))}
    del seen
    places: dict[str, list[int]] = {}
    words, sentence_of, bag_of = array("i"), array("i"), array("i")
    for b, bag in enumerate(bags):
        for sentence in bag:
            known = []
            for w in sentence:
                if (at := places.get(w)) is None:
                    places[w] = at = [vocabulary[f] for f in features(w) if f in vocabulary]
                known += at
            words.extend(known)
            sentence_of.extend([len(bag_of)] * len(known))
            bag_of.append(b)
    del places
    words, sentence_of, bag_of = (np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32) for x in (words, sentence_of, bag_of))
    cost = np.array([(share or {}).get(int(v), 1.0) for v in y])
    cost /= cost.mean()
    n, v = len(bag_of), len(vocabulary)
    theta = np.zeros(v + 2)
    theta[v], theta[v + 1] = -7.0, -3.0  # bias; leak as a log-odds
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = theta[v] + np.bincount(sentence_of, weights=theta[words], minlength=n)
        rate = np.bincount(bag_of, weights=np.logaddexp(0, z), minlength=len(y)) + np.logaddexp(0, theta[v + 1])
        slope = np.where(y, -1 / np.expm1(np.maximum(rate, 1e-9)), 1.0) * cost  # of the loss by a bag's rate
        by_sentence = slope[bag_of] / (1 + np.exp(-z))
        gradient = np.empty_like(theta)
        gradient[:v] = np.bincount(words, weights=by_sentence[sentence_of], minlength=v) + penalty
        gradient[v] = by_sentence.sum()
        gradient[v + 1] = slope.sum() / (1 + np.exp(-theta[v + 1]))
        m, s = 0.9 * m + 0.1 * gradient, 0.99 * s + 0.01 * gradient**2
        theta -= 0.15 * min(1, 4 * (1 - t / (rounds + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        np.maximum(theta[:v], 0, out=theta[:v])
    leak = float(1 / (1 + np.exp(-theta[v + 1])))
    return ToxicModel({w: float(theta[i]) for w, i in vocabulary.items() if abs(theta[i]) > 1e-3}, float(theta[v]), leak)


def fit(docs: DataFrame, labels: DataFrame, most_of_each: int = 2500, longest: int = 20_000) -> ToxicModel:
    """A model from labels.toxic of rows that are not held out; see labelled_sample for the bounds."""
    rows, sizes = labelled_sample(docs, labels, "toxic", most_of_each, longest)
    drawn = Counter(y for _, y in rows)
    share = {y: sizes[y] / drawn[y] for y in drawn}
    return fit_texts([t for t, _ in rows], [y for _, y in rows], share)


def fit_texts(texts: list[str], labels: list[int], share: dict[int, float] | None = None) -> ToxicModel:
    return fit_bags(Bags(texts), labels, share)


class _Weights(dict):
    def __init__(self, weights: dict[str, float]):
        self.known = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = w = sum(self.known.get(f, 0.0) for f in features(word.lower()))
        return w


def score_text(text: str | None, model: ToxicModel, weight=None, report: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score, and start, end (code points) and score of each offending sentence."""
    weight = weight or _Weights(model.weights)
    get, bias, found, rates = weight.__getitem__, model.bias, [], []
    line = np.log(report / (1 - report))
    for m in _SENTENCE.finditer(text or ""):
        words = _WORD.findall(m[0])
        if not words:
            continue
        z = sum(map(get, words))
        if len(words) > 1 and z:  # each distinct word counts once
            z = sum(map(get, set(map(str.lower, words))))
        rates.append(z)
        if z + bias >= line:
            found.append((m.start(), m.end(), float(1 / (1 + np.exp(-(z + bias))))))
    rate = -np.log1p(-model.leak)
    if rates:
        rate += np.logaddexp(0, np.array(rates) + bias).sum()
    return float(-np.expm1(-rate)), found


def score(docs: DataFrame, model: ToxicModel, text: str = "text", report: float = 0.5) -> DataFrame:
    """docs with `score` (0 to 1) and `offending`, the sentences of score `report` or more with their places.

    No shuffle: the model, bounded by the fitting sample, goes to every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        weight = _Weights(model.weights)

        def step(texts: list) -> list[pa.Array]:
            made = [score_text(t, model, weight, report) for t in texts]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in made]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return [pa.array([x for x, _ in made], pa.float64()), pa.array(spans, kind)]

        return step

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return append_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))], start, text)
