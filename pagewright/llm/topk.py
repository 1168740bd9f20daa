"""Exact top-k search by Fagin's threshold algorithm.

A block's components are put into one sorted list for each dimension. A query reads its
lists in rounds, each from the end that its sign favours. Rows met for the first time
get their whole inner product; what no list has shown yet can score no more than the
threshold, the inner product of the query with the last values read. A query is done
with a block when the threshold falls below its kth score so far, which it carries from
block to block. Scores are integers, so results are exact; equal scores go to the
smaller id, hence lists are read on while threshold and kth score are equal.

Nulls, other rows that take no part, and repeated rows: see vectors. With fewer than k
candidates all are returned. An inner product beyond 64 bits is an error.

New rows are scored by gathering them; once they are over a quarter of the queries' rows
in a round, one matrix product gives the same scores for less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from pagewright.llm import vectors

#: Entries that a query reads of each list in the first round; each later one doubles it.
FIRST_ROUND = 8
#: Queries that go through a block together.
GROUP = 256
#: Share of new rows in a round above which a matrix product scores them.
DENSE = 0.25


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(x * scale)


def threshold_search(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the rows seen (queries by rows, -inf: not seen, or its own), and how many entries were read in all.

    lists: rows in ascending order of each dimension (rows by dimensions); kth: what a
    result must reach already.
    """
    n, d = x.shape
    exact = max(np.abs(x).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) * d < 2**53
    scores = np.full((len(queries), n), -np.inf) if exact else np.full((len(queries), n), -np.inf, object)
    seen = np.zeros((len(queries), n), bool)
    active, depth, step, read = np.arange(len(queries)), 0, FIRST_ROUND, 0
    dims = np.arange(d)
    line = kth.copy()
    up = queries >= 0
    while len(active) and depth < n:
        stop = min(n, depth + step)
        low, high = lists[depth:stop], lists[n - stop : n - depth]
        fresh = np.zeros((len(active), n), bool)
        rows = np.arange(len(active))[:, None]
        for j in range(d):
            take = up[active, j]
            fresh[rows[take], high[:, j]] = True
            fresh[rows[~take], low[:, j]] = True
        read += len(active) * d * (stop - depth)
        fresh &= ~seen[active]
        seen[active] |= fresh
        r, c = np.nonzero(fresh)
        if not exact:
            got = [sum(int(a) * int(b) for a, b in zip(queries[active[i]], x[j], strict=True)) for i, j in zip(r, c, strict=True)]
            scores[active[r], c] = got
        elif len(r) > DENSE * fresh.size:
            scores[active[r], c] = (queries[active] @ x.T)[r, c]
        else:
            for at in range(0, len(r), 65536):
                i, j = r[at : at + 65536], c[at : at + 65536]
                scores[active[i], j] = np.einsum("ij,ij->i", queries[active[i]], x[j])
        mine = own[active][:, None] == ids
        view = np.where(mine, -np.inf, scores[active])
        if n > k:
            line[active] = np.maximum(line[active], np.partition(view, n - k, axis=1)[:, n - k])
        ends_high, ends_low = x[lists[n - stop], dims], x[lists[stop - 1], dims]
        most = (np.where(up[active], ends_high, ends_low) * queries[active]).sum(1)
        depth, step = stop, step * 2
        active = active[most >= line[active]]
    return np.where(own[:, None] == ids, -np.inf, scores), read


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * component) for each query.

    is_query: which rows, by the id column named `id`, are queries too.
    """
    every = vectors.usable(rows, vec_id, vector)

    def build(data: np.ndarray) -> list[bytes]:
        return [np.argsort(scaled(data, scale), axis=0, kind="stable").astype(np.uint16).tobytes()]

    def find(queries, q_ids, block, state):
        ids, x, q = block["ids"], scaled(block["x"], scale), scaled(queries, scale)
        lists = np.frombuffer(block["lists"], np.uint16).reshape(x.shape)
        kth = state.setdefault("kth", np.full(len(q), -np.inf))
        out = []
        for at in range(0, len(q), GROUP):
            group = slice(at, at + GROUP)
            scores, _ = threshold_search(q[group], q_ids[group], x, ids, lists, k, kth[group])
            keep = vectors.best_of(scores, ids, k)
            if len(ids) > k:
                kth[group] = np.maximum(kth[group], np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
            r, c = np.nonzero(keep)
            good = scores[r, c] >= kth[group][r]
            out.append((r[good] + at, ids[c[good]], np.array([int(v) for v in scores[r[good], c[good]]], np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return vectors.search(every, is_query, k, "lists", build, find, "long")
