"""A sink that writes one file a document, as a Python data source: spark.dataSource.register(DocumentFiles), then

    documents.write.format("document_files").option("column", "html").option("extension", "html").mode("overwrite").save(path)

Layout below path, which is a folder or any address that pyarrow.fs knows:

    _current                       the name of the write that counts, and its parts
    part-<write>-<task>/_index     doc_id, file, bytes and crc32 of each document, a line of JSON each
    part-<write>-<task>/<ff>/...   the files, at most FOLDER to a folder

A task attempt writes to a folder of its own below _writing-<write>. Its commit message names it; commit() moves the named
folders into place, a rename a task, then replaces _current, and only then removes what it replaces. So a reader sees the
old files or the new ones, attempts that were killed or lost leave nothing behind, and abort() removes all of a write.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files of a folder at most.
FOLDER = 1000
CURRENT, INDEX = "_current", "_index"
FILES = "doc_id string, file string, bytes long, crc32 long, content binary"


def file_system(path: str):
    """The file system of an address or a local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][\w+.-]+://|file:/", path) else (fs.LocalFileSystem(), path)


def _read(system, path: str) -> bytes | None:
    from pyarrow import fs

    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_stream(path) as f:
        return f.read()


def _write(system, path: str, content: bytes) -> None:
    with system.open_output_stream(path) as f:
        f.write(content)


def live_parts(system, root: str) -> list[str]:
    """The parts that count, in order."""
    held = _read(system, f"{root}/{CURRENT}")
    return json.loads(held)["parts"] if held else []


@dataclass
class Written(WriterCommitMessage):
    folder: str
    task: int
    files: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.column, self.key = options["path"], options.get("column", "html"), options.get("key", "doc_id")
        self.extension, self.overwrite, self.write_id = options.get("extension", self.column), overwrite, uuid.uuid4().hex
        self.folder = int(options.get("folder", FOLDER))
        # made here, on the driver, and never by a task: one that still runs when the write is given up can't leave files
        system, root = file_system(self.path)
        system.create_dir(f"{root}/_writing-{self.write_id}", recursive=True)

    def _name(self, value, taken: dict) -> str:
        """A file name in letters, digits, _ and -; repeated and null keys get numbers."""
        base = re.sub("[^A-Za-z0-9_-]+", "_", str(value))[:100] if value is not None else "none"
        taken[base] = n = taken.get(base, 0) + 1
        return f"{base}.{self.extension}" if n == 1 else f"{base}.{n}.{self.extension}"

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = file_system(self.path)
        task = TaskContext.get().partitionId()
        own = f"{root}/_writing-{self.write_id}/{task}-{uuid.uuid4().hex}"
        system.create_dir(own, recursive=False)
        n, taken, index = 0, {}, []
        with system.open_output_stream(f"{own}/{INDEX}") as listing:
            for batch in iterator:
                for key, content in zip(batch.column(self.key), batch.column(self.column)):
                    key, content = key.as_py(), content.as_py()
                    if content is None:
                        index.append({"doc_id": key, "file": None, "bytes": None, "crc32": None})
                    else:
                        raw = content.encode() if isinstance(content, str) else bytes(content)
                        folder = f"{n // self.folder:02x}"
                        if n % self.folder == 0:
                            system.create_dir(f"{own}/{folder}", recursive=False)
                        name = f"{folder}/{self._name(key, taken)}"
                        _write(system, f"{own}/{name}", raw)
                        index.append({"doc_id": key, "file": name, "bytes": len(raw), "crc32": zlib.crc32(raw)})
                        n += 1
                listing.write("".join(json.dumps(x) + "\n" for x in index).encode())
                index = []
        return Written(own, task, n)

    def commit(self, messages):
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        old, new = live_parts(system, root), []
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            new.append(f"part-{self.write_id}-{m.task:05d}")
            system.move(m.folder, f"{root}/{new[-1]}")
        parts = new if self.overwrite else old + new
        _write(system, f"{root}/{CURRENT}-{self.write_id}", json.dumps({"write": self.write_id, "parts": parts}).encode())
        system.move(f"{root}/{CURRENT}-{self.write_id}", f"{root}/{CURRENT}")
        self._remove(system, root, [f"_writing-{self.write_id}", *(set(old) - set(parts))])

    def abort(self, messages):
        from pyarrow import fs

        system, root = file_system(self.path)
        system.move(f"{root}/_writing-{self.write_id}", f"{root}/_given-up-{self.write_id}")  # tasks find their folders gone
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        live = set(live_parts(system, root))
        self._remove(system, root, [x.base_name for x in found if self.write_id in x.base_name and x.base_name not in live])

    def _remove(self, system, root: str, names) -> None:
        from pyarrow import fs

        for name in names:
            kind = system.get_file_info(f"{root}/{name}").type
            if kind == fs.FileType.Directory:
                system.delete_dir(f"{root}/{name}")
            elif kind == fs.FileType.File:
                system.delete_file(f"{root}/{name}")


@dataclass
class Part(InputPartition):
    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class DocumentReader(DataSourceReader):
    """The files that count, a partition a part. A file whose bytes are not those that were written is an error."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        system, root = file_system(self.path)
        return [Part(p) for p in live_parts(system, root)]

    def read(self, partition):
        if not isinstance(partition, Part):  # nothing was written
            return
        system, root = file_system(self.path)
        with system.open_input_stream(f"{root}/{partition.name}/{INDEX}") as f:
            lines = f.read().decode().splitlines()
        for x in map(json.loads, lines):
            raw = None if x["file"] is None else _read(system, f"{root}/{partition.name}/{x['file']}")
            if x["file"] is not None and (raw is None or zlib.crc32(raw) != x["crc32"]):
                raise ValueError(f"{partition.name}/{x['file']} is not what was written")
            yield None if x["doc_id"] is None else str(x["doc_id"]), x["file"] and f"{partition.name}/{x['file']}", x["bytes"], x["crc32"], raw


class DocumentFiles(DataSource):
    @classmethod
    def name(cls):
        return "document_files"

    def schema(self):
        return FILES

    def reader(self, schema: StructType):
        return DocumentReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        names = schema.fieldNames()
        w = DocumentWriter(self.options, overwrite)
        if missing := [c for c in (w.key, w.column) if c not in names]:
            raise ValueError(f"no column {', '.join(missing)}")
        return w


def _ready(spark: SparkSession) -> None:
    from quire import ship

    ship(spark)
    spark.dataSource.register(DocumentFiles)


def write_files(documents: DataFrame, column: str, path: str, extension: str | None = None, key: str = "doc_id", mode: str = "overwrite") -> None:
    """A file a row with the text (as UTF-8) or bytes of a column; null ones are listed and have no file."""
    _ready(documents.sparkSession)
    w = documents.select(key, column).write.format("document_files").option("column", column).option("key", key)
    w.option("extension", extension or column).mode(mode).save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """FILES of what write_files() has written."""
    _ready(spark)
    return spark.read.format("document_files").load(path)
