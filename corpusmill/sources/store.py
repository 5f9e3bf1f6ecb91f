"""A table of Parquet files whose batches appear whole and once, as a Spark data source for batch and stream writes.

    spark.dataSource.register(CorpusStore)
    documents.write.format("corpus_store").option("path", path).option("batch", "2024-05").mode("append").save()
    documents.writeStream.format("corpus_store").option("path", path).option("batch", "inbox").option("checkpointLocation", place).start()
    spark.read.format("corpus_store").option("path", path).load()

Tasks write files below ``data`` that nobody reads yet; the commit names those of the tasks that won in one manifest below ``log``, which
is moved to its place when it is complete. The name of a batch is the name of its manifest, so a batch that is written
again, after a lost driver or by a stream that restarts, changes nothing: its new files are deleted. (A stream that lost its checkpoint must
cut the same micro-batches again, since these are known by their numbers.) A reader sees the manifests there at its start. Files of attempts that failed are never named; a batch deletes its own, ``sweep`` those that a lost driver left.
"""

from __future__ import annotations

import datetime
import json
import math
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Arrow bytes after which a task begins another file, and bytes of files that one task reads.
FILE_BYTES, TASK_BYTES = 128 << 20, 64 << 20
#: Arrow bytes of a row group, which is what a writer or a reader holds of a file, and bytes that a reader fetches at once.
GROUP_BYTES, FETCH_BYTES = 8 << 20, 1 << 20


@dataclass
class Staged(WriterCommitMessage):
    """Files of one task: name below ``data``, rows and bytes."""

    files: list[tuple[str, int, int]] = field(default_factory=list)


@dataclass
class Share(InputPartition):
    """Files that one task reads."""

    files: list[str]


class Folder:
    """Manifests and files below a path that every executor can open: a shared folder, or a URI of a store that Arrow knows."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        local = re.sub(r"^file:/+", "/", self.path)
        files, root = fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), local)
        return files, posixpath.join(root, *parts)

    def names(self, *parts: str) -> list[fs.FileInfo]:
        files, root = self._at(*parts)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)

    def manifests(self) -> list[dict]:
        """In order of the batches' names."""
        files, _ = self._at()
        found = []
        for info in self.names("log"):
            if info.path.endswith(".json"):
                with files.open_input_stream(info.path) as source:
                    found.append(json.loads(source.read()))
        return found

    def holds(self, batch: str) -> bool:
        files, place = self._at("log", f"{quote(batch, safe='')}.json")
        return files.get_file_info(place).type == fs.FileType.File

    def publish(self, batch: str, schema: StructType, staged: list[tuple[str, int, int]]) -> None:
        """Two drivers that publish one batch at once leave the manifest of the later: the batch is there once."""
        files, place = self._at("log", f"{quote(batch, safe='')}.json")
        files.create_dir(posixpath.dirname(place), recursive=True)
        draft = f"{place}.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": batch, "schema": schema.jsonValue(), "files": staged}).encode())
        files.move(draft, place)

    def writer(self, name: str, schema: pa.Schema) -> pq.ParquetWriter:
        files, place = self._at("data", name)
        return pq.ParquetWriter(place, schema, filesystem=files, compression="zstd")

    def begin(self, prefix: str) -> None:
        files, place = self._at("data", prefix)
        files.create_dir(place, recursive=True)

    def discard(self, prefix: str) -> None:
        """Without its folder, tasks that still run can add no file there (in stores that make folders by themselves, ``sweep`` deletes these)."""
        files, place = self._at("data", prefix)
        for attempt in range(5):
            if files.get_file_info(place).type != fs.FileType.Directory:
                return
            try:
                return files.delete_dir(place)
            except OSError:  # a task began a file meanwhile
                if attempt == 4:
                    raise

    def size(self, name: str) -> int:
        files, place = self._at("data", name)
        return files.get_file_info(place).size

    def batches(self, name: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
        files, place = self._at("data", name)
        with files.open_input_file(place) as source:
            parquet = pq.ParquetFile(source, buffer_size=FETCH_BYTES)
            for group in range(parquet.num_row_groups):
                yield from parquet.iter_batches(batch_size=4096, row_groups=[group], columns=columns, use_threads=False)

    def delete(self, names: Iterable[str]) -> None:
        for name in names:
            files, place = self._at("data", name)
            if files.get_file_info(place).type == fs.FileType.File:
                files.delete_file(place)


def _schema(manifests: list[dict]) -> StructType | None:
    return StructType.fromJson(manifests[0]["schema"]) if manifests else None


class Reader(DataSourceReader):
    """Rows of all manifests; of a schema given by the caller only those columns are read."""

    def __init__(self, folder: Folder, schema: StructType) -> None:
        self.folder, self.columns = folder, schema.names

    def partitions(self) -> list[Share]:
        shares, room = [], 0
        for name, _rows, size in (f for m in self.folder.manifests() for f in m["files"]):
            if not shares or room < size:
                shares.append(Share([]))
                room = TASK_BYTES
            shares[-1].files.append(name)
            room -= size
        return shares or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for name in partition.files:
            for batch in self.folder.batches(name, self.columns):
                yield batch.select(self.columns)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of equal numbers of rows, of half a row group at least where there are several."""
    step = max(1, math.ceil(batch.num_rows / max(1, math.ceil(batch.nbytes / GROUP_BYTES))))
    return (batch.slice(start, step) for start in range(0, batch.num_rows, step))


class _Staging:
    """What batch and stream writers share: files of a task, and their way into a manifest."""

    def __init__(self, folder: Folder, schema: StructType, batch: str) -> None:
        self.folder, self.schema, self.batch = folder, schema, batch
        self.prefix = uuid.uuid4().hex
        folder.begin(self.prefix)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        staged, out, name, rows, size, group = Staged(), None, "", 0, 0, []

        def flush() -> None:
            if group:
                out.write_table(pa.Table.from_batches(group))
                group.clear()

        def close() -> None:
            flush()
            out.close()
            staged.files.append((name, rows, self.folder.size(name)))

        def add(batch: pa.RecordBatch) -> None:
            nonlocal out, name, rows, size
            if out is not None and size >= FILE_BYTES:
                close()
                out = None
            if out is None:
                name, rows, size = f"{self.prefix}/{uuid.uuid4().hex}.parquet", 0, 0
                out = self.folder.writer(name, batch.schema)
            group.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if sum(b.nbytes for b in group) >= GROUP_BYTES // 2:
                flush()

        for batch in iterator:
            for part in _parts(batch):
                add(part)
            batch = part = None  # else they stay while the next batch is read
        if out is not None:
            close()
        return staged

    def _publish(self, batch: str, messages: list[Staged | None]) -> None:
        staged = [f for m in messages if m is not None for f in m.files]
        if self.folder.holds(batch):
            self.folder.delete(name for name, _, _ in staged)
        else:
            self.folder.publish(batch, self.schema, staged)


class Writer(_Staging, DataSourceArrowWriter):
    """One batch: its own folder of files, so what failed attempts left there is deleted with the commit."""

    def _left(self, kept: set[str]) -> list[str]:
        found = [f"{self.prefix}/{posixpath.basename(f.path)}" for f in self.folder.names("data", self.prefix)]
        return [name for name in found if name not in kept]

    def commit(self, messages: list[Staged | None]) -> None:
        self._publish(self.batch, messages)
        self.folder.delete(self._left({name for m in messages if m is not None for name, _, _ in m.files}))

    def abort(self, messages: list[Staged | None]) -> None:
        self.folder.discard(self.prefix)


class StreamWriter(_Staging, DataSourceStreamArrowWriter):
    """Micro-batches, each a batch named by the option ``batch`` and its number."""

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self._publish(f"{self.batch}-{batchId:012d}", messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.folder.delete(name for m in messages if m is not None for name, _, _ in m.files)


class CorpusStore(DataSource):
    """Options: ``path``, and for writes ``batch``, the name under which a repeated write is known (a new one each time if not given).

    A read of a store without batches needs a schema. All batches have one schema, by names and types; writes append only.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus_store"

    @property
    def folder(self) -> Folder:
        if not self.options.get("path"):
            raise ValueError("the option path is missing")
        return Folder(self.options["path"])

    def schema(self) -> StructType:
        known = _schema(self.folder.manifests())
        if known is None:
            raise ValueError(f"no batch in {self.options['path']}; give a schema to read an empty store")
        return known

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.folder, schema)

    def _checked(self, schema: StructType, overwrite: bool) -> tuple[Folder, StructType, str]:
        if overwrite:
            raise ValueError("batches are only appended; write to a new path instead")
        known = _schema(self.folder.manifests())
        types = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
        if known is not None and types(known) != types(schema):
            raise ValueError(f"the store holds {known.simpleString()}, not {schema.simpleString()}")
        return self.folder, schema, self.options.get("batch") or uuid.uuid4().hex

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(*self._checked(schema, overwrite))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(*self._checked(schema, overwrite))


def sweep(path: str, older: datetime.timedelta = datetime.timedelta(days=7)) -> int:
    """Delete files that no manifest names and that are older than any write still running; returns how many."""
    folder = Folder(path)
    known = {name for m in folder.manifests() for name, _, _ in m["files"]}
    limit = datetime.datetime.now(datetime.timezone.utc) - older
    lost = ["/".join(f.path.split("/")[-2:]) for f in folder.names("data") if f.mtime <= limit]
    lost = [name for name in lost if name not in known]
    folder.delete(lost)
    return len(lost)
