"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are scaled to length one and turned by a random rotation; of each component only
its sign is kept, packed, beside one correction: the inner product of the turned vector
with its code (the signs over the root of the dimension). For a query of length one,
<code, query> / correction estimates the cosine without bias, and its error exceeds
EPSILON * sqrt((1 - correction^2) / correction^2) / sqrt(dimension - 1) only rarely. The
query's components are rounded to BITS bits and kept as BITS planes of packed bits, so the
product with a code is a count of the bits that the code shares with each plane; the bound
takes the rounding in.
The best estimates of a block are computed exactly first; then every vector whose upper
bound reaches the kth exact value is reranked with the original vectors. The kth value
is carried from block to block.

The rotation depends on the dimension alone, nothing is fitted, and every row is
indexed. Vectors of length zero, and others that vectors.usable leaves out, take no
part. Repeated rows: see vectors. With fewer than k candidates all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import vectors

#: Standard deviations, about, to which the error bound reaches.
EPSILON = 1.9
#: Bits of a query's component.
BITS = 4
#: Estimates that are computed exactly at first, times k.
FIRST = 3
GROUP = 256


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for a dimension everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths, without overflow or underflow."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.sqrt(((x / top) ** 2).sum(axis=1)) * top[:, 0]


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of rows, as whole 64-bit words, and corrections."""
    turned = (x / lengths(x)[:, None]) @ rotation(x.shape[1])
    return words(turned > 0), (np.abs(turned).sum(1) / np.sqrt(x.shape[1])).astype(np.float32)


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of truth values, packed into 64-bit words; what a row lacks to a whole word is unset."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


@dataclass(frozen=True)
class Planes:
    """Queries of length one, turned, each component rounded to BITS bits between the query's least and largest.

    planes: for each bit the packed words of all queries; component = low + step * number.
    """

    planes: list[np.ndarray]
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    dim: int


def planes(queries: np.ndarray) -> Planes:
    dim = queries.shape[1]
    turned = (queries / lengths(queries)[:, None]) @ rotation(dim)
    low = turned.min(1)
    step = np.maximum(turned.max(1) - low, 1e-12) / (2**BITS - 1)
    numbers = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    return Planes([words(numbers >> b & 1) for b in range(BITS)], low, step, turned.sum(1), dim)


def estimates(q: Planes, group: slice, code: np.ndarray, correction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries of the group by rows) and the error bound of each, from packed bits and scalars alone."""
    both = np.zeros((len(q.low[group]), len(code)), np.uint32)  # sum of a query's numbers over a row's set bits
    for b, plane in enumerate(q.planes):
        for w in range(code.shape[1]):
            both += np.bitwise_count(plane[group, w, None] & code[None, :, w]).astype(np.uint32) << np.uint32(b)
    set_ = np.bitwise_count(code).sum(1)
    low, step = q.low[group][:, None], q.step[group][:, None]
    # the sum over set bits, twice, less the sum of all components
    inner = (2 * (step * both + low * set_) - q.total[group][:, None]) / np.sqrt(q.dim)
    wide = correction.astype(np.float64)
    # of the code, in deviations; and of rounding, of which a component's deviation is 2 * step / sqrt(12)
    error = np.hypot(np.sqrt(np.maximum(1 - wide**2, 0) / max(q.dim - 1, 1)), step / np.sqrt(3))
    return inner / wide, EPSILON * error / wide + 1e-5


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows, in double precision; the same for the same rows wherever they are."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by cosine.

    is_query: which rows, by the id column named `id`, are queries too.
    """
    every = vectors.usable(rows, vec_id, vector).where(F.exists("v", lambda x: x != 0))

    def build(data: np.ndarray) -> list[bytes]:
        code, correction = codes(data)
        return [code.tobytes(), correction.tobytes()]

    def find(queries, q_ids, block, state):
        ids, x = block["ids"], block["x"]
        code = np.frombuffer(block["codes"], np.uint64).reshape(len(ids), -1)
        correction = np.frombuffer(block["corrections"], np.float32)
        if "kth" not in state:
            state.update(kth=np.full(len(queries), -np.inf), planes=planes(queries))
        kth, out = state["kth"], []
        for at in range(0, len(queries), GROUP):
            group = slice(at, at + GROUP)
            q = queries[group]
            guess, error = estimates(state["planes"], group, code, correction)
            own = q_ids[group][:, None] == ids
            guess[own] = -np.inf
            exact = np.full(guess.shape, -np.inf)

            def rerank(which, q=q, exact=exact):
                r, c = np.nonzero(which)
                for i in range(0, len(r), 65536):
                    a, b = r[i : i + 65536], c[i : i + 65536]
                    exact[a, b] = cosines(q[a], x[b])

            def raise_kth(group=group, exact=exact):
                if exact.shape[1] > k:
                    kth[group] = np.maximum(kth[group], np.partition(exact, exact.shape[1] - k, axis=1)[:, exact.shape[1] - k])

            first = vectors.best_of(guess, ids, FIRST * k)
            rerank(first)
            raise_kth()
            rerank((guess + error >= kth[group][:, None]) & ~first & ~own)
            raise_kth()
            r, c = np.nonzero(vectors.best_of(exact, ids, k))
            good = exact[r, c] >= kth[group][r]
            out.append((r[good] + at, ids[c[good]], exact[r[good], c[good]]))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True))

    return vectors.search(every, is_query, k, "codes corrections", build, find, "double")
