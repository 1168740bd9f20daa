"""Token counts by separator scan over flat token files.

A flat file is nothing but token ids of fixed width, one document after another, each
closed by an end-of-document id; there is no index. The file is cut into blocks of
BLOCK ids wherever they fall; each block is read by its place and searched for the
separator in one vectorised comparison. A document that began blocks ago is stitched by
a prefix scan over blocks, of the number of separators (its ordinal) and the place of
the last one (its start). The scan has two levels: over the SPAN blocks of a stretch, and
over stretches, so that a file of any size is no single task's work.

Documents without tokens count 0. What follows the last separator of a file is a
document that is not closed, if it has any token. A file whose size is no multiple of
the width is an error, and so is a separator that is a token. Files without ids give no
row. Null texts have no tokens; repeated rows and rows without an id are documents each;
extra columns are not read; empty tables give no file that is mentioned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import written

#: Ids in a block, blocks in a stretch, and bytes of texts between two writes.
BLOCK, SPAN, STEP = 1 << 20, 1024, 4 << 20


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def flat_ids(made: list[list[int]], end: int, width: int) -> np.ndarray:
    """Lists of ids one after another, each closed by end. An id that the width cannot hold, or that is end, is an error."""
    sizes = np.fromiter(map(len, made), np.int64, len(made))
    out = np.full(int(sizes.sum()) + len(made), end, np.int64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    out[inside] = np.fromiter(chain.from_iterable(made), np.int64, int(sizes.sum()))
    if len(out) and (out.min() < 0 or out.max() >= 1 << 8 * width):
        raise ValueError(f"an id does not fit in {width} bytes")
    if (out[inside] == end).any():
        raise ValueError(f"the separator {end} is a token")
    return out.astype(f"<u{width}")


def write_flat(docs: DataFrame, encoder: Callable[[], Callable[[list], list[list[int]]]], end: int, folder: str, width: int = 2, text: str = "text") -> DataFrame:
    """Encodes docs (doc_id, text) into flat files in a shared folder; returns their manifest (file, bytes, ordinal, doc_id).

    encoder() makes, once in a task, what turns texts into lists of ids. Each attempt of
    a task writes a file of its own name, and the manifest names those of the attempts
    that count, so lost executors leave at worst a file that nothing mentions.
    """
    def run(batches):
        encode = encoder()
        uri = f"{folder}/{uuid.uuid4().hex}.bin"
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        ids, ordinal = [], 0
        with store.open_output_stream(f"{path}/{uri.rpartition('/')[2]}") as out:
            def put(keys: list, texts: list) -> None:
                out.write(flat_ids(encode(texts), end, width).tobytes())
                ids.extend(keys)

            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                at = size = 0
                for i, x in enumerate(texts):
                    size += len(x or "")
                    if size >= STEP:
                        put(keys[at : i + 1], texts[at : i + 1])
                        at, size = i + 1, 0
                if at < len(texts):
                    put(keys[at:], texts[at:])
            total = out.tell()
        for ordinal in range(0, len(ids), 20000):
            part = ids[ordinal : ordinal + 20000]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array([total] * n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.array(part, pa.int64())], names=["file", "bytes", "ordinal", "doc_id"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
    return written(slim.mapInArrow(run, "file string, bytes long, ordinal long, doc_id long"), "manifest")


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files at a path or pattern; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def separators(files: DataFrame, end: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, first, n, seps) for each block: its first id's place, its ids, and where separators are in it."""
    count = F.ceil(F.col("bytes") / (width * block)).cast("long")
    sound = F.when(F.col("bytes") % width != 0, F.raise_error(F.concat(F.col("file"), F.lit(": not a whole number of ids")))).otherwise(count)
    cut = files.select("file", "bytes", sound.alias("blocks")).where("bytes > 0")
    cut = cut.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).repartition("file", "block")

    def run(batches):
        name, source = None, None
        for batch in batches:
            for file, size, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file != name:
                    store, path = _open(file)
                    name, source = file, store.open_input_file(path)
                first = k * block
                ids = np.frombuffer(source.read_at(min(block * width, size - first * width), first * width), f"<u{width}")
                found = np.flatnonzero(ids == end).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k]), pa.array([first]), pa.array([len(ids)], pa.int64()), lists], names=["file", "block", "first", "n", "seps"])

    return cut.mapInArrow(run, "file string, block long, first long, n long, seps array<int>")


def token_counts(files: DataFrame, end: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, ordinal, start, n_tokens, closed for each document of flat files (file, bytes)."""
    found = written(separators(files, end, width, block), "separators")
    found = found.withColumn("stretch", F.floor(F.col("block") / SPAN)).withColumn("last", F.col("first") + F.try_element_at("seps", F.lit(-1)))
    stretches = found.groupBy("file", "stretch").agg(F.sum(F.size("seps")).alias("k"), F.max("last").alias("l"))
    over = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("file", "stretch", F.coalesce(F.sum("k").over(over), F.lit(0)).alias("k"), F.coalesce(F.max("l").over(over), F.lit(-1)).alias("l"))
    within = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.join(stretches, ["file", "stretch"])
    carried = carried.withColumn("ordinal", F.col("k") + F.coalesce(F.sum(F.size("seps")).over(within), F.lit(0))).withColumn("before", F.greatest("l", F.max("last").over(within)))
    each = carried.select("file", "first", "ordinal", "before", F.posexplode(F.arrays_zip("seps", F.concat(F.array(F.lit(None).cast("int")), F.col("seps")).alias("prior"))).alias("i", "x"))
    each = each.where(F.col("x.seps").isNotNull())
    start = F.coalesce(F.col("first") + F.col("x.prior"), F.col("before")) + 1
    closed = each.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("first") + F.col("x.seps") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = found.groupBy("file").agg(F.sum("n").alias("n"), F.sum(F.size("seps")).alias("k"), F.coalesce(F.max("last"), F.lit(-1)).alias("l")).where("n > l + 1")
    return closed.unionByName(ends.select("file", F.col("k").alias("ordinal"), (F.col("l") + 1).alias("start"), (F.col("n") - F.col("l") - 1).alias("n_tokens"), F.lit(False).alias("closed")))
