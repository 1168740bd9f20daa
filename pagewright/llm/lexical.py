"""Ranked lexical search over a two-level quantised index, exact.

The index is cut by documents: a block holds the terms of some documents, and for each term
the documents that hold it, by place in the block, with two levels. The first is a byte, the
part of a score that depends on the document alone, (1000000000 * tf) div (1000 * tf + 20 * m),
in steps of STEP and rounded upward. The second is tf. No posting is shuffled, and a block
never grows: more documents are more blocks.

A query first sums w * byte over its terms in a block: an upper bound of every document's
score, and, less the sum of the block's w, a lower bound. Documents whose upper bound reaches
the kth lower bound of the block, and the kth score of the sampled blocks (a document's
score is a lower bound of the kth), are scored exactly in integers from tf; of those a block
returns its k best at most. The sampled blocks, one in SAMPLE by a hash, lie in a folder of
their own and are searched first, so that a query returns about SAMPLE * k rows of all
blocks, however many there are. Ties go to the least doc_id, within blocks too, so a third of
all rows with one text cannot flood the result.

Queries of the same set of terms are one. They are dealt to shards of at most SHARD terms,
which are broadcast with their weights; each shard is one pass over the index. A query is
held as a whole.

Null texts, and texts without terms, are no documents (they do not count in N), and queries
without terms find nothing. Rows that repeat a doc_id are documents of their own; rows
without an id come last among equals. Each query row has a list of its own, also where rows
repeat an item_id. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import fresh_path, written
from pagewright.llm.words import word_blocks, word_list

#: Bytes of text and documents in a block, at most but for one longer text. One block in SAMPLE is searched first.
BLOCK_BYTES, BLOCK_DOCS, SAMPLE = 8 << 20, 4096, 16
#: Step of the byte level: the largest value is 1000000, and 255 steps hold it.
STEP = 3922
#: Terms of queries that one pass holds.
SHARD = 200_000

_BLOCK = "docs array<bigint>, n binary, terms binary, offsets binary, slots binary, bytes binary, tf binary, sample boolean"


@dataclass(frozen=True)
class Index:
    """blocks: the table; n_docs: documents with a term; n_terms: all their terms with repeats."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def length_term(n, n_docs: int, n_terms: int):
    """m of documents with n terms."""
    return 100 - 50 + (50 * n * n_docs) // n_terms


def factor(tf, m):
    """What a term adds to a score, over its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block(ids: list, docs: list[np.ndarray], terms: list[bytes], n_docs: int, n_terms: int, sample: int) -> list:
    """A row of the index from the term numbers of each document."""
    import xxhash

    n = np.array([len(d) for d in docs], np.int64)
    key = np.concatenate(docs).astype(np.int64) * len(docs) + np.repeat(np.arange(len(docs)), n)
    key, tf = np.unique(key, return_counts=True)
    slots = key % len(docs)
    offsets = np.searchsorted(key, np.arange(len(terms) + 1) * len(docs))
    level = -(-factor(tf, length_term(n, n_docs, n_terms)[slots]) // STEP)
    whole = b"\n".join(terms)  # no term holds a newline
    arrays = [n, offsets.astype(np.int32), slots.astype(np.int32), level.astype(np.uint8), tf.astype(np.int32)]
    n, offsets, slots, level, tf = (a.tobytes() for a in arrays)
    return [ids, n, whole, offsets, slots, level, tf, xxhash.xxh3_64_intdigest(whole + n) % sample == 0]


def _totals(texts: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms: a sum of each batch's."""

    def run(batches):
        for batch in batches:
            sizes = [sum(map(len, word_blocks(body.as_py()))) for body in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["docs", "terms"])

    made = texts.mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return made[0] or 0, made[1] or 0


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS, sample: int = SAMPLE) -> Index:
    """The index of all documents, as a table in the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    n_docs, n_terms = _totals(rows.select("text"))
    names = [part.split()[0] for part in _BLOCK.split(", ")]

    def run(batches):
        number: dict[bytes, int] = {}
        ids, held, size = [], [], 0

        def block() -> pa.RecordBatch:
            row = _block(ids, held, list(number), n_docs, n_terms, sample)
            kinds = [pa.list_(pa.int64()), *[pa.binary()] * 6, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = [np.fromiter([number.setdefault(w, len(number)) for w in words], np.int32, len(words)) for words in word_blocks(body.as_py())]
                mine = np.concatenate([np.empty(0, np.int32), *parts])
                if not len(mine):
                    continue
                ids.append(doc)
                held.append(mine)
                size += len(body.as_buffer())
                if size >= block_bytes or len(ids) >= block_docs:
                    yield block()
                    number, ids, held, size = {}, [], [], 0
        if ids:
            yield block()

    path = fresh_path(docs.sparkSession, "index")
    rows.mapInArrow(run, _BLOCK).write.partitionBy("sample").parquet(path)
    return Index(docs.sparkSession.read.schema(_BLOCK).parquet(path), n_docs, n_terms)


def _places(terms: bytes, wanted) -> dict[bytes, int]:
    """The places of wanted terms among a block's."""
    return {t: i for i, t in enumerate(terms.split(b"\n")) if t in wanted}


def document_frequencies(blocks: DataFrame, shared) -> dict[bytes, int]:
    """How many documents hold each term of a broadcast set: as many rows as the set has terms, at most."""

    def run(batches):
        wanted = shared.value
        for batch in batches:
            for terms, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, n = _places(terms, wanted), np.diff(np.frombuffer(offsets, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.binary()), pa.array([int(n[i]) for i in at.values()], pa.int64())], names=["term", "df"])

    found = blocks.select("terms", "offsets").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in found.collect()}


class BlockSearch:
    """One block of the index, with what its queries need of it."""

    def __init__(self, row: dict, weights: dict[bytes, int]):
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["docs"]], np.int64)
        self.null = np.array([i is None for i in row["docs"]])
        self.n = np.frombuffer(row["n"], np.int64)
        self.offsets, self.slots, self.tf = (np.frombuffer(row[c], np.int32) for c in ("offsets", "slots", "tf"))
        self.bytes = np.frombuffer(row["bytes"], np.uint8)
        self.at, self.weights = _places(row["terms"], weights), weights

    def best(self, terms: list[bytes], k: int, least: int, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the block's k best, those below `least` left out."""
        mine = [(self.weights[t], self.at[t]) for t in terms if t in self.at]
        upper = np.zeros(len(self.ids), np.int64)
        for w, i in mine:
            s, e = self.offsets[i], self.offsets[i + 1]
            upper[self.slots[s:e]] += w * self.bytes[s:e].astype(np.int64)
        bound = max(least, 1)
        if len(upper) > k:  # the kth lower bound
            bound = max(bound, (int(np.partition(upper, -k)[-k]) - sum(w for w, _ in mine)) * STEP)
        left = np.flatnonzero(upper * STEP >= bound)
        score = np.zeros(len(left), np.int64)
        m = length_term(self.n[left], n_docs, n_terms)
        for w, i in mine:
            s, e = self.offsets[i], self.offsets[i + 1]
            at = np.searchsorted(self.slots[s:e], left)
            held = at < e - s
            held[held] = self.slots[s:e][at[held]] == left[held]
            score[held] += w * factor(self.tf[s:e][at[held]].astype(np.int64), m[held])
        good = score >= max(least, 1)
        left, score = left[good], score[good]
        order = np.lexsort((self.ids[left], self.null[left], -score))[:k]
        return left[order], score[order]


def _searched(blocks: DataFrame, shared, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(query, doc_id, score): each block's best for each query."""

    def run(batches):
        queries, weights = shared.value
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                block = BlockSearch(row, weights)
                names, docs, scores = [], [], []
                for name, terms, least in queries:
                    at, score = block.best(terms, k, least, n_docs, n_terms)
                    names += [name] * len(at)
                    docs += [row["docs"][i] for i in at.tolist()]
                    scores.append(score)
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(docs, pa.int64()), pa.array(np.concatenate(scores))], names=["query", "doc_id", "score"])

    read = ["docs", "n", "terms", "offsets", "slots", "bytes", "tf"]
    return blocks.select(*read).mapInArrow(run, "query string, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; Spark keeps k of each partition before it shuffles."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text", most: int = SHARD) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the k best documents with a score above 0 for each row of items."""
    spark = index.blocks.sparkSession
    terms = F.array_distinct(word_list(F.col(text).cast("string")))
    rows = written(items.select(F.col(item_id).alias("item_id"), F.array_sort(terms).alias("terms")).withColumn("query", F.md5(F.array_join("terms", " ").cast("binary"))), "queries")
    queries = rows.where(F.size("terms") > 0).groupBy("query").agg(F.first("terms").alias("terms"))
    weight_of, dealt = F.sum(F.size("terms") + 1), lambda n: F.pmod(F.xxhash64("query"), F.lit(n))
    total, largest = queries.agg(weight_of, F.max(F.size("terms") + 1)).first()
    n = max(1, -(-(total or 0) // most))
    while (queries.groupBy(dealt(n).alias("shard")).agg(weight_of.alias("weight")).agg(F.max("weight")).first()[0] or 0) > max(most, largest or 0):
        n *= 2
    made = []
    for shard in range(n) if index.n_docs else ():
        mine = [(r["query"], [t.encode() for t in r.terms]) for r in queries.where(dealt(n) == shard).collect()]  # at most `most` terms
        df = document_frequencies(index.blocks, spark.sparkContext.broadcast({t for _, ts in mine for t in ts}))
        weights = {t: weight(f, index.n_docs) for t, f in df.items()}
        first = spark.sparkContext.broadcast(([(q, ts, 0) for q, ts in mine], weights))
        sampled = _ranked(_searched(index.blocks.where("sample"), first, k, index.n_docs, index.n_terms), k)
        least = {r["query"]: r.score for r in sampled.where(F.col("rank") == k).select("query", "score").collect()}
        shared = spark.sparkContext.broadcast(([(q, ts, least.get(q, 0)) for q, ts in mine], weights))
        made.append(_searched(index.blocks, shared, k, index.n_docs, index.n_terms))
    if not made:
        return rows.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    found = made[0]
    for more in made[1:]:
        found = found.unionByName(more)
    return rows.select("item_id", "query").join(_ranked(found, k), "query").select("item_id", "rank", "doc_id", "score")
