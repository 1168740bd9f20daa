"""Fuzzy joins: texts within a few edits of each other.

Candidates share a key, so the join is an equi-join and never tries all pairs; the edit
distance then decides. Texts of up to SHORT characters have the hashes of all that is left
of them by at most `most` deletions as keys: two texts within `most` edits have one in
common. Longer texts would have too many; of those the right one is cut into most + 1
segments, one of which an alike text holds unchanged, at most `most` characters away. Each
text of one side counts once, however many rows have it. Keys are made in Arrow batches
and travel with a hash of the text, not with the text. A text has hundreds of keys, which
the planner's guess by the size of the files does not see, so neither keys nor texts are
ever broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters up to which deletions are the keys.
SHORT = 40
#: Keys of a batch, about.
BATCH = 200_000


def deletions(text: str, most: int) -> set[str]:
    """The text and all that at most `most` deletions leave of it."""
    made = last = {text}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        made = made | last
    return made


def _segments(length: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Number, start and end of the segments of a text."""
    for i in range(most + 1):
        yield i, i * length // (most + 1), (i + 1) * length // (most + 1)


def own_segments(text: str, most: int) -> set[str]:
    return {f"{len(text)}:{i}:{text[s:e]}" for i, s, e in _segments(len(text), most)}


def sought_segments(text: str, most: int) -> set[str]:
    """What own_segments of an alike text of any fitting length may have that this text holds."""
    out = set()
    for length in range(len(text) - most, len(text) + most + 1):
        for i, s, e in _segments(length, most):
            for at in range(max(s - most, 0), min(s + most, len(text) - (e - s)) + 1):
                out.add(f"{length}:{i}:{text[at : at + e - s]}")
    return out


def keys_of(text: str, most: int, sought: bool, short: int) -> set[str]:
    made = {f"-{x}" for x in deletions(text, most)} if len(text) <= short + most else set()
    if len(text) > short:
        made |= sought_segments(text, most) if sought else own_segments(text, most)
    return made


def _keyed(texts: DataFrame, most: int, sought: bool, short: int, name: str) -> DataFrame:
    """(name, length, key) of texts (id, text): the id under that name."""
    names = [name, f"{name}_length", "key"]

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        ids, lengths, keys = [], [], []

        def made() -> pa.RecordBatch:
            columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), pa.array(keys, pa.uint64()).view(pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = [digest(k.encode()) for k in keys_of(text, most, sought, short)]
                ids += [i] * len(mine)
                lengths += [len(text)] * len(mine)
                keys += mine
                if len(keys) >= BATCH:
                    yield made()
                    ids, lengths, keys = [], [], []
        if keys:
            yield made()

    return texts.select("id", "text").mapInArrow(run, f"{name} long, {name}_length int, key long")


def candidates(left: DataFrame, right: DataFrame, most: int, short: int = SHORT) -> DataFrame:
    """(l, r): the pairs of ids of texts (id, text) that share a key, each once."""
    if short < 2 * most:
        raise ValueError("texts beyond `short` must be longer than twice the edits")
    one, two = _keyed(left, most, True, short, "l"), _keyed(right, most, False, short, "r")
    return one.join(two.hint("merge"), "key").where(F.abs(F.col("l_length") - F.col("r_length")) <= most).select("l", "r").distinct()


def texts_of(rows: DataFrame, on: str) -> DataFrame:
    """(id, text): the distinct texts of a column, with a hash; of equal hashes all texts are compared.

    They are few bytes but much work, so they are dealt to as many tasks as the session has.
    """
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = rows.select(F.col(on).cast("string").alias("text")).where("text is not null").distinct()
    return distinct.select(F.xxhash64("text").alias("id"), "text").repartition(tasks, "id")


def fuzzy_pairs(left: DataFrame, right: DataFrame, left_on: str, right_on: str, most: int = 2, short: int = SHORT) -> DataFrame:
    """(left_text, right_text, edits): distinct texts within `most` edits of each other. Nulls match nothing."""
    one, two = texts_of(left, left_on), texts_of(right, right_on)
    pairs = candidates(one, two, most, short)
    pairs = pairs.join(one.select(F.col("id").alias("l"), F.col("text").alias("left_text")).hint("merge"), "l").join(two.select(F.col("id").alias("r"), F.col("text").alias("right_text")).hint("merge"), "r")
    return pairs.select("left_text", "right_text", F.levenshtein("left_text", "right_text", most).alias("edits")).where("edits >= 0")


def fuzzy_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, most: int = 2, short: int = SHORT) -> DataFrame:
    """Rows of left and right whose texts are within `most` edits, with `edits`. Column names of the two must differ."""
    pairs = fuzzy_pairs(left, right, left_on, right_on, most, short).withColumnsRenamed({"left_text": "__l", "right_text": "__r"})
    both = left.join(pairs, F.col(left_on).cast("string") == F.col("__l")).join(right, F.col("__r") == F.col(right_on).cast("string"))
    return both.drop("__l", "__r")
