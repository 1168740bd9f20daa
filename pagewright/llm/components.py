"""Connected components of a graph of links.

Links are dealt to tasks of about HELD. Each task replaces those it reads by links of every
id to the least one they connect it to: as many at most, and connected alike. Then
large-star and small-star take turns, with that step after each turn, until all links are
stars: no id has two links downwards, and none that has one is the end of another. There is
one way for all sizes. A centre that very many links share is pre-aggregated in its
minimum; its joins are between written tables, which Spark splits where a key is skewed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import written


#: Links that a task holds at a time (16 bytes each).
HELD = 1_000_000


def least_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of links, and the least id that each is connected to."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, label[one], low)
        np.minimum.at(new, label[two], low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) as links of each id to the least that its batch connects it to."""

    def stars(held: list) -> pa.RecordBatch:
        ids, label = least_connected(*(np.concatenate(x) for x in zip(*held, strict=True)))
        other = ids != label
        return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(label[other])], names=["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n >= HELD:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def _tidy(links: DataFrame, tasks: int) -> DataFrame:
    """Links from the larger id to the smaller, each once, contracted, as a table."""
    plain = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(tasks)
    return written(_contracted(plain), "links")


def _least(pairs: DataFrame) -> DataFrame:
    """(x, m): for each a of the pairs, the least of it and its neighbours b."""
    return written(pairs.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")


def _settled(links: DataFrame) -> bool:
    """Whether every id has one link at most, and those that links end in have none."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("from"), F.lit(0).alias("to")).unionByName(links.select(F.col("b").alias("id"), F.lit(0).alias("from"), F.lit(1).alias("to")))
    seen = ends.groupBy("id").agg(F.sum("from").alias("n"), F.max("to").alias("to"))
    return seen.where("n > 1 or (n = 1 and to = 1)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): every id of the links (a, b) with the least id it is connected to.

    Links only ever shrink towards the least ids; rounds grow with the logarithm of the
    longest path.
    """
    links = written(links.select("a", "b"), "raw")
    tasks = max(1, -(-links.count() // HELD))
    links = _tidy(links, tasks)
    for _ in range(most_rounds):
        if _settled(links):
            ends = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(ends)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: the larger neighbours of each a go to the least of a and all its neighbours
        large = both.join(_least(both), F.col("a") == F.col("x")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _tidy(large, tasks)
        # small star: the smaller neighbours of each a, and a itself, go to the least of them
        small = large.join(_least(large), F.col("a") == F.col("x")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        links = _tidy(small, tasks)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
