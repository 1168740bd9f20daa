"""Vectors in blocks: how a set of queries meets all rows without a broadcast and without a pair of rows.

Rows are packed, where they lie, into blocks of at most BLOCK rows. Queries are dealt by a
hash of row into chunks of about CHUNK. A tile is one chunk and one shelf of blocks; a
block's shelf is a hash of its ids, and there are as many shelves as keep one at about
SHELF rows, or as many as the session has cores, if that is more. A tile is one task: it
holds the queries of its chunk and lets the blocks of its shelf pass by, one at a time.
So a block is shuffled once for each chunk, a query once for each shelf: for up to CHUNK
queries every row travels once, and in general the traffic is rows times queries over the
size of a tile. Vectors travel in the type they are stored in.

Fetching only the survivors of a search by code instead would move more: of vectors of 64
dimensions and nearly equal spread, the error bounds leave several in a hundred of all rows
to each query, and a fetched vector serves one query, a block all those of a chunk.

Rows without an id, and vectors that are null, empty, or hold a null or a component that
is not finite, take no part. Only vectors of equal length meet. Each row that is a query
has a list of its own, also where rows repeat an id or are alike throughout: rows that are
alike are searched once and their list is given once for each. Rows that bear a query's id
are never its candidates; candidates that repeat an id count each. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, CHUNK, SHELF = 4096, 32768, 131072


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id long, v array<float or double>) of the rows that take part."""
    stored = vectors.select(F.col(vector)).schema[0].dataType
    single = isinstance(stored, T.ArrayType) and isinstance(stored.elementType, T.FloatType)
    v = F.col(vector).cast("array<float>" if single else "array<double>")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & (F.size("v") > 0)).where(F.coalesce(sound, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(rows: DataFrame, extra: str = "", build: Callable[[np.ndarray], list[bytes]] | None = None) -> DataFrame:
    """Rows (chunk int, longs..., v) packed by chunk and dimension: chunk, dim, longs, data, and what build makes of a block's doubles, as binary columns named in extra."""
    names, at_v = extra.split(), len(rows.columns) - 1
    kind = np.float32 if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held: dict[tuple[int, int], list] = {}

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            parts = held.pop(key)
            longs, data = np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])
            made = build(data.astype(np.float64)) if build else []
            columns = [[key[0]], [key[1]], [longs.tobytes()], [data.tobytes()], *[[x] for x in made]]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (2 + len(names))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "dim", "longs", "data", *names])

        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                chunks, dims = part.column(0).to_numpy(), np.asarray(pa.compute.list_value_length(part.column(at_v)))
                longs = np.stack([part.column(i).to_numpy() for i in range(1, at_v)], 1)
                for key in sorted(set(zip(chunks.tolist(), dims.tolist(), strict=True))):
                    mine = np.flatnonzero((chunks == key[0]) & (dims == key[1]))
                    x = matrix(part.column(at_v).take(pa.array(mine))).astype(kind)
                    if key in held and sum(len(i) for i, _ in held[key]) + len(mine) > BLOCK:
                        yield block(key)
                    held.setdefault(key, []).append((longs[mine], x))
        for key in sorted(held):
            yield block(key)

    return rows.mapInArrow(pack, "chunk int, dim int, longs binary, data binary" + "".join(f", {n} binary" for n in names))


def search(rows: DataFrame, is_query: Column, k: int, extra: str, build: Callable, find: Callable, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query row, ties to the smaller id.

    find(queries, query_ids, block, state) gives, for the queries of a tile and a block
    (ids, x, and the columns named in extra), arrays (query row, vec_id, score) with the
    best k of each query at least; state is a dict that lives as long as the tile. score
    is its type.
    """
    names, double = extra.split(), not isinstance(rows.schema["v"].dataType.elementType, T.FloatType)
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    chunks = max(1, -(-size["q"] // CHUNK))
    shelves = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // SHELF))
    chosen = rows.where(is_query).groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("key", F.xxhash64("id", "v"))
    chosen = blocks(chosen.select(F.pmod("key", F.lit(chunks)).cast("int").alias("chunk"), "id", "key", "copies", "v"))
    chosen = chosen.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1)))).withColumns({n: F.lit(None).cast("binary") for n in names})
    packed = blocks(rows.select(F.lit(0).alias("chunk"), "id", "v"), extra, build).withColumn("shelf", F.pmod(F.xxhash64("longs"), F.lit(shelves)).cast("int"))
    packed = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    both = chosen.withColumn("is_row", F.lit(False)).unionByName(packed.withColumn("is_row", F.lit(True)))
    both = both.select((F.col("chunk") * shelves + F.col("shelf")).alias("tile"), "dim", "is_row", "longs", "data", *names)
    dealt = both.repartitionById(chunks * shelves, F.col("tile")).sortWithinPartitions("tile", "dim", "is_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, at = np.float64 if double else np.float32, None
        for batch in batches:
            for row in range(len(batch)):
                get = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                if at != (tile := (get["tile"].as_py(), get["dim"].as_py())):
                    at, parts, queries, state = tile, [], None, {}
                longs = np.frombuffer(get["longs"].as_buffer(), np.int64)
                data = np.frombuffer(get["data"].as_buffer(), kind).reshape(-1, at[1])
                if not get["is_row"].as_py():
                    parts.append((longs.reshape(-1, 3), data.astype(np.float64)))
                    continue
                if not parts:  # no query of this dimension
                    continue
                if queries is None:
                    own, queries = (np.concatenate(x) for x in zip(*parts, strict=True))
                block = {"ids": longs, "x": data.astype(np.float64)} | {name: get[name].as_buffer() for name in names}
                q, ids, scores = find(queries, own[:, 0], block, state)
                if len(q):
                    columns = [*own[q].T, ids, scores]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["query_id", "key", "copies", "vec_id", "score"])

    found = dealt.mapInArrow(run, f"query_id long, key long, copies long, vec_id long, score {score}")
    best = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    each = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the smaller id; -inf is never kept."""
    order = np.argsort(ids, kind="stable")
    turned = scores[:, order]
    if turned.shape[1] > k:
        line = np.partition(turned, -k, axis=1)[:, -k, None]
        above, level = turned > line, turned == line
        room = k - above.sum(1, keepdims=True)
        keep = above | (level & (np.cumsum(level, axis=1) <= room))
    else:
        keep = np.ones(turned.shape, bool)
    keep &= turned > -np.inf
    out = np.zeros_like(keep)
    out[:, order] = keep
    return out
