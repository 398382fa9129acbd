"""A data source of files that are one page or document each: ``format("turnloom_documents")``.

Reading lists the files below a folder, deals them out by size and gives ``path, size, html``. Writing takes
``name, document`` and makes one file of each row. A task writes below a folder of its attempt; the driver
moves files of the attempts that Spark has committed into place, so that a failed or repeated task shows
nothing, and takes the staging folder away if the job aborts; what a task still writes there after that
is not read, like anything whose name begins with a dot or an underscore. Paths go through Arrow's file systems, so
any folder that driver and executors share will do (file, HDFS, S3, GCS).
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

NAME = "turnloom_documents"
#: Bytes of files that make a partition, about.
PARTITION_BYTES = 64 << 20
#: Bytes of rows that a reader hands over at once, about.
BATCH_BYTES = 4 << 20
#: Names that a document's file may have.
SAFE_NAME = re.compile(r"[\w.-]+")


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, size: int):
        self.path, self.suffix, self.size = path, suffix, size

    def partitions(self) -> list[Files]:
        system, top = _system(self.path)
        found = sorted(((f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file and f.path.endswith(self.suffix) and "/." not in f.path[len(top) :] and "/_" not in f.path[len(top) :]), key=lambda x: x[0])
        parts, held, size = [], [], 0
        for path, n in found:
            if held and size + n > self.size:
                parts.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*parts, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_stream(path) as file:
                body = file.read()
            # bytes that are no UTF-8 become replacement characters, as browsers show them
            rows.append((path, len(body), body.decode("utf-8", "replace")))
            size += len(body)
            if size > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "size", "html"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.job = path, suffix, overwrite, uuid.uuid4().hex

    def _staging(self, top: str) -> str:
        return posixpath.join(top, f"_job-{self.job}")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, top = _system(self.path)
        folder, names = posixpath.join(self._staging(top), f"attempt-{TaskContext.get().taskAttemptId()}"), []
        for row in iterator:
            if row.name is None or not SAFE_NAME.fullmatch(row.name) or row.name.startswith((".", "_")):
                raise ValueError(f"no name for a file: {row.name!r}")
            if not names:
                system.create_dir(folder, recursive=True)
            with system.open_output_stream(posixpath.join(folder, row.name + self.suffix)) as file:
                file.write((row.document or "").encode())
            names.append(row.name)
        if len(set(names)) < len(names):
            raise ValueError("names repeat")
        return Written(folder, tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, top = _system(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("names repeat")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if f.is_file and f.path.endswith(self.suffix):
                    system.delete_file(f.path)
        for message in done:
            for name in message.names:
                system.move(posixpath.join(message.folder, name + self.suffix), posixpath.join(top, name + self.suffix))
        self._clean(system, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_system(self.path))

    def _clean(self, system: fs.FileSystem, top: str) -> None:
        if system.get_file_info(self._staging(top)).type != fs.FileType.NotFound:
            system.delete_dir(self._staging(top))


class Documents(DataSource):
    """Options: path; suffix of the files (.html); partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, size long, html string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("suffix", ".html"), int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if {f.name for f in schema.fields} != {"name", "document"}:
            raise ValueError("documents are written from the columns name and document")
        return _Writer(self.options["path"], self.options.get("suffix", ".html"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)
