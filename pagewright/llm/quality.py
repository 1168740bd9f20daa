"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes its terms: words and runs of punctuation as they stand, and one term, AGAIN,
for each word that is the same as the one before it. Terms are hashed to BUCKETS, weigh the
root of their count times their rarity in the sample, and the profile, scaled to length
one, is projected on the leading singular vectors of a sample of labelled texts. The
sample's vectors are broadcast; every document's cosine with every one of them is computed
exactly in double precision, block by block, and the labels of the `neighbours` nearest vote
with their cosine as weight. Cosines are compared in steps of a billionth; where several are
equal at the last place, all of those share its votes, so the order of the sample does not
matter. Nothing else enters a score.

The sample is bounded (`most_of_each` rows of a class, a documented parameter), so what
is broadcast is too: under 2 MB. Scoring covers whole texts of all documents. Null and
empty texts have no vector: they score the sample's share of label 1. Repeated rows
score alike. Columns of documents that bear a new column's name are replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagewright.llm.labelled import labelled_sample
from pagewright.llm.shared import append_columns

BUCKETS = 4096
CACHE_ENTRIES = 300_000
AGAIN = "<again>"

_TERM = re.compile(r"\w+|[^\w\s]+")


class _Buckets(dict):
    """Term to bucket."""

    def __missing__(self, term: str) -> int:
        made = zlib.crc32(term.encode()) % BUCKETS
        if len(term) <= 40:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[term] = made
        return made


def profile(text: str | None, buckets: dict) -> np.ndarray | None:
    """Roots of the counts of all terms by bucket; None without terms."""
    terms = _TERM.findall(text or "")
    if not terms:
        return None
    counts = np.bincount(np.fromiter(map(buckets.__getitem__, terms), np.int64, len(terms)), minlength=BUCKETS)
    words = text.split()
    counts[buckets[AGAIN]] += sum(map(str.__eq__, words, words[1:]))
    return np.sqrt(counts, dtype=np.float32)


@dataclass(frozen=True)
class QualityModel:
    """weight: of each bucket; axes: buckets by dimensions; vectors, labels: of the sample; prior: its share of label 1."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, profiles: np.ndarray) -> np.ndarray:
        return _unit(_unit(profiles.astype(np.float64) * self.weight) @ self.axes)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading_axes(x: np.ndarray, dimensions: int, rounds: int = 8) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    if not len(x):
        return np.empty((x.shape[1], 0), np.float32)
    start = np.random.default_rng(1).standard_normal((x.shape[1], dimensions + 16)).astype(np.float32)
    basis = np.linalg.qr(x @ start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(x @ (x.T @ basis))[0]
    _, size, axes = np.linalg.svd(basis.T @ x, full_matrices=False)
    return np.ascontiguousarray(axes[:dimensions][size[:dimensions] > 1e-3].T)


def fit_texts(texts: list[str], labels: list[int], dimensions: int = 48) -> QualityModel:
    buckets = _Buckets()
    x, y = np.empty((len(texts), BUCKETS), np.float32), np.empty(len(texts), np.float32)
    n = 0
    for text, label in zip(texts, labels, strict=True):
        if (made := profile(text, buckets)) is not None:
            x[n], y[n] = made, label
            n += 1
    x, y = x[:n], y[:n]
    weight = (np.log((1 + n) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = _unit(x * weight)
    axes = leading_axes(x, dimensions)
    prior = float(y.mean()) if n else 0.5
    return QualityModel(weight, axes, _unit(x.astype(np.float64) @ axes), y, prior)


def fit(docs: DataFrame, labels: DataFrame, most_of_each: int = 1500, longest: int = 20_000, dimensions: int = 48) -> QualityModel:
    """A model from labels.quality of rows that are not held out; see labelled_sample for the bounds."""
    rows, _ = labelled_sample(docs, labels, "quality", most_of_each, longest)
    return fit_texts([t for t, _ in rows], [y for _, y in rows], dimensions)


def vote(vectors: np.ndarray, model: QualityModel, neighbours: int = 7) -> np.ndarray:
    """Share of label 1 among the nearest, weighted by cosine (negative: none)."""
    if not len(model.vectors) or not len(vectors):
        return np.full(len(vectors), model.prior)
    near = np.round(vectors @ model.vectors.T, 9)
    k = min(neighbours, near.shape[1])
    last = np.partition(near, -k, axis=1)[:, -k, None]
    above, equal = near > last, near == last
    share = (k - above.sum(1, keepdims=True)) / equal.sum(1, keepdims=True)
    weight = np.maximum(near, 0) * (above + equal * share)
    total = weight.sum(1)
    return np.where(total > 0, weight @ model.labels / np.maximum(total, 1e-300), model.prior)


def score(docs: DataFrame, model: QualityModel, text: str = "text", neighbours: int = 7) -> DataFrame:
    """docs with `score`, 0 to 1: how likely label 1 is. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model, buckets = shared.value, _Buckets()

        def step(texts: list) -> list[pa.Array]:
            out = np.full(len(texts), model.prior)
            for at in range(0, len(texts), 512):
                made = [(i, p) for i, t in enumerate(texts[at : at + 512], at) if (p := profile(t, buckets)) is not None]
                if made:
                    out[[i for i, _ in made]] = vote(model.project(np.array([p for _, p in made])), model, neighbours)
            return [pa.array(np.clip(out, 0.0, 1.0))]

        return step

    return append_columns(docs, [T.StructField("score", T.DoubleType())], start, text)
