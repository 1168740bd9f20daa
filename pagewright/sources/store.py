"""A folder of documents as a data source with commits: format("pagewright_store"), for batches and streams.

A write's tasks put Parquet files under the folder that nobody reads yet; the commit, on the
driver, makes all of them visible at once by one small file, a manifest, that appears whole
or not at all. A task that fails, or is run again, leaves at most files that no manifest
names; an abort deletes those that tasks reported. Readers see the files of the manifests
there are when they begin, and nothing else.

A stream's micro-batch has a manifest named by the query and the batch, so a batch that is
run again after a restart changes nothing. A stream that reads has the number of manifests
as its offset. Manifests are numbered in the order of their commits, and of two writers
that commit at once the later one fails, and is to be run again: the name of a manifest is
taken once (on a store that can replace files by moving, by one writer at a time).

Folders are paths or URIs of a file system that Arrow knows and all executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "pagewright_store"


def _published(store: fs.FileSystem, aside: str, whole: str) -> None:
    """Gives a file its name, unless there is one of that name: a link on a local disk, else a move, which HDFS refuses then."""
    if isinstance(store, fs.LocalFileSystem):
        os.link(aside, whole)
    elif store.get_file_info(whole).type != fs.FileType.NotFound:
        raise FileExistsError(whole)
    else:
        store.move(aside, whole)


class Folder:
    """The files of a store."""

    def __init__(self, path: str):
        self.path = path

    def _at(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return store, root.rstrip("/")

    def _numbers(self) -> list[int]:
        store, root = self._at()
        found = store.get_file_info(fs.FileSelector(f"{root}/_manifests", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def manifests(self, start: int = 0, end: int | None = None) -> list[dict]:
        """Manifests start to end - 1, in the order of their commits."""
        return [self._manifest(n) for n in self._numbers()[start:end]]

    def _manifest(self, number: int) -> dict:
        store, root = self._at()
        with store.open_input_stream(f"{root}/_manifests/{number:012d}.json") as f:
            return json.loads(f.read())

    def size(self) -> int:
        return len(self._numbers())

    def commit(self, files: list[str], schema: str, query: str | None = None, batch: int | None = None, replaces: bool = False) -> None:
        """Makes files visible, at once; nothing happens if the query's batch is there already. A query's batches only rise, so its last manifest tells."""
        store, root = self._at()
        numbers = self._numbers()
        if query is not None:
            last = next((m for m in map(self._manifest, reversed(numbers)) if m["query"] == query), None)
            if last is not None and last["batch"] >= batch:
                return
        store.create_dir(f"{root}/_manifests", recursive=True)
        n = numbers[-1] + 1 if numbers else 0
        whole, aside = f"{root}/_manifests/{n:012d}.json", f"{root}/_manifests/{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(aside) as f:
            f.write(json.dumps({"files": files, "schema": schema, "query": query, "batch": batch, "replaces": replaces}).encode())
        try:
            _published(store, aside, whole)
        except OSError as e:
            raise RuntimeError(f"another write has committed to {self.path} meanwhile") from e
        finally:
            if store.get_file_info(aside).type != fs.FileType.NotFound:
                store.delete_file(aside)

    def put(self, batches: Iterator[pa.RecordBatch]) -> list[str]:
        """Writes batches to one file that nobody reads yet; gives its name, or none for no rows."""
        store, root = self._at()
        writer, name = None, f"part-{uuid.uuid4().hex}.parquet"
        store.create_dir(root, recursive=True)
        try:
            for batch in batches:
                writer = writer or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=store)
                writer.write_batch(batch)
        finally:
            if writer is not None:
                writer.close()
        return [name] if writer is not None else []

    def drop(self, files: list[str]) -> None:
        store, root = self._at()
        for name in files:
            if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")

    def read(self, name: str) -> Iterator[pa.RecordBatch]:
        store, root = self._at()
        with pq.ParquetFile(f"{root}/{name}", filesystem=store) as file:
            yield from file.iter_batches()


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


@dataclass
class File(InputPartition):
    name: str


def _named(messages: list) -> list[str]:
    return [name for m in messages if m is not None for name in m.names]


class _Writer:
    def __init__(self, path: str, schema: StructType, replaces: bool = False, query: str | None = None):
        self.path, self.schema, self.replaces, self.query = path, schema.json(), replaces, query

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        return Files(Folder(self.path).put(iterator))


class StoreWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        Folder(self.path).commit(_named(messages), self.schema, replaces=self.replaces)

    def abort(self, messages: list) -> None:
        Folder(self.path).drop(_named(messages))


class StoreStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        Folder(self.path).commit(_named(messages), self.schema, self.query, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        Folder(self.path).drop(_named(messages))


def visible(manifests: list[dict]) -> list[str]:
    """Files of manifests in order, from the last that replaces what was before."""
    out: list[str] = []
    for m in manifests:
        out = [*([] if m["replaces"] else out), *m["files"]]
    return out


class StoreReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        return [File(name) for name in visible(Folder(self.path).manifests())]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return Folder(self.path).read(partition.name) if partition is not None else iter(())


class StoreStreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        return {"n": Folder(self.path).size()}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(name) for m in Folder(self.path).manifests(start["n"], end["n"]) for name in m["files"]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return Folder(self.path).read(partition.name)


class Store(DataSource):
    """Options: path; for a stream that writes, query: a name that it keeps over restarts."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        found = Folder(self.options["path"]).manifests()
        if not found:
            raise ValueError(f"nothing has been committed to {self.options['path']}: give a schema")
        return StructType.fromJson(json.loads(found[-1]["schema"]))

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(self.options["path"])

    def streamReader(self, schema: StructType) -> StoreStreamReader:
        return StoreStreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StoreStreamWriter:
        return StoreStreamWriter(self.options["path"], schema, query=self.options["query"])


def register(spark: SparkSession) -> None:
    """Makes format("pagewright_store") known to this session."""
    spark.dataSource.register(Store)
