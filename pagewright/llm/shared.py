"""What the operators have in common: shared scratch space, batching by bytes, hashed splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one Python step holds at a time.
STEP_BYTES = 4 << 20

#: Numbers of 64 bits in a map of ids that is broadcast, at most; ids that share a number, about.
WORDS, SHARE = 1 << 22, 4

_U = np.uint64
#: An odd number with bits set all over.
SPREAD = _U(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of its own where that is unset, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and outlives executors."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, tag))
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """For slim tables: a reliable checkpoint, which Spark deletes when it is no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def marked(rows: DataFrame, key: str, ids: DataFrame, most: int = WORDS) -> DataFrame:
    """rows with `may`: true for all whose key is one of ids (id), false for most others. No shuffle of rows.

    A map of bits, one for each id's hash, is broadcast. It has a number of 64 bits for each
    SHARE ids, so one other key in 16 passes at most, up to `most` numbers; beyond
    64 * most ids it lets most keys through. ids, which may repeat, is read twice: pass a written table.
    """
    distinct = ids.agg(F.approx_count_distinct("id")).first()[0]
    words = min(most, 1 << max(4, (distinct // SHARE).bit_length()))
    place = lambda c: F.pmod(F.shiftrightunsigned(F.xxhash64(c), 6), F.lit(words))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(xxhash64({c}) & 63 as int))")
    found = written(ids.groupBy(place("id").alias("__word")).agg(F.bit_or(bit("id")).alias("__bits")), "bits")
    both = rows.join(F.broadcast(found), place(key) == F.col("__word"), "left")
    return both.withColumn("may", F.coalesce(F.col("__bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("__word", "__bits")


def held_out(doc_id: Column) -> Column:
    """Rows from which no label may be learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pieces(batch: pa.RecordBatch, text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    start, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < len(lengths):
        yield batch.slice(start)


def append_columns(df: DataFrame, fields: list[T.StructField], start: Callable[[], Callable[[list], list[pa.Array]]], text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with columns computed from whole texts in Arrow batches.

    start() runs once in each task and returns a function from the texts of a slice
    (None for null) to one Arrow array for each field. Columns of df that bear the
    name of a new one (in any case) are replaced; those in `drop` are not returned.
    """
    new = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType(keep + fields)
    names = [f.name for f in keep]
    source = df if text.lower() not in new else df.withColumn("__text", F.col(text))
    read = text if text.lower() not in new else "__text"
    source = source.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*names, read])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        step = start()
        for batch in batches:
            for part in pieces(batch, read):
                made = step(part.column(part.schema.get_field_index(read)).to_pylist())
                kept = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, in order, from batches sorted by key. A run keeps the chunks it came in, however large."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != keys[-1]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of equal keys, and the places behind them."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.append(starts[1:], len(keys))
