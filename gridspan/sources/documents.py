"""Folders of text documents as a data source, for tables and for streams.

    spark.dataSource.register(Documents)
    spark.read.format("documents").option("path", folder).load()
    spark.readStream.format("documents").option("path", folder).load()

Any store that Arrow's file systems know will do. Files are dealt out by size; a filter on the path
is settled before any file is opened. A file that can't be read as text is a row
whose ``problem`` says why. A stream's offset is the time and path of the last file, so that one that
is stopped goes on behind it.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from ..session import importable

SCHEMA = "path string, size long, modified timestamp, text string, problem string"
#: Bytes of a partition, and files that a batch of a stream takes at most.
PARTITION_BYTES, BATCH_FILES = 64 << 20, 10_000


@dataclass(frozen=True)
class File:
    path: str
    size: int
    ns: int

    @property
    def place(self) -> tuple[int, str]:
        """What a stream's files are in order of."""
        return self.ns, self.path


@dataclass
class Files(InputPartition):
    """The files of one task."""

    files: list[File]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def found(path: str) -> list[File]:
    """The files below a folder; hidden ones, and those in hidden folders, are left out."""
    from pyarrow import fs

    store, root = _store(path)
    infos = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
    return [File(i.path, i.size, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File and not hidden(i.path)]


def dealt(files: list[File], most: int) -> list[Files]:
    """Files in partitions of about ``most`` bytes; a longer file is a partition of its own."""
    out: list[Files] = []
    size = most
    for f in sorted(files, key=lambda f: f.path):
        if size + f.size > most and (size or not out):
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f.size
    return out


def rows_of(path: str, files: list[File]) -> Iterator[tuple]:
    store, _ = _store(path)
    for f in files:
        text, problem = None, None
        try:
            with store.open_input_stream(f.path) as opened:
                text = opened.read().decode()
        except (OSError, UnicodeDecodeError) as e:
            problem = f"{type(e).__name__}: {e}"
        yield f.path, f.size, datetime.datetime.fromtimestamp(f.ns / 1e9, datetime.UTC), text, problem


class _Table(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.tests = path, most, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the path are settled on the listing; all others are Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, (EqualTo, In, StringEndsWith, StringStartsWith)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, file: File) -> bool:
        tests = {EqualTo: lambda f: file.path == f.value, In: lambda f: file.path in f.value, StringEndsWith: lambda f: file.path.endswith(f.value), StringStartsWith: lambda f: file.path.startswith(f.value)}
        return all(tests[type(f)](f) for f in self.tests)

    def partitions(self) -> list[Files]:
        return dealt([f for f in found(self.path) if self._wanted(f)], self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.path, partition.files)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, most: int, batch: int):
        self.path, self.most, self.batch = path, most, batch
        self.given = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"ns": "-1", "path": ""}

    @staticmethod
    def _place(offset: dict) -> tuple[int, str]:
        return int(offset["ns"]), offset["path"]

    def latestOffset(self) -> dict:
        """Behind what was given out, as many files as a batch takes."""
        after = self._place(self.given)
        later = sorted(f.place for f in found(self.path) if f.place > after)[: self.batch]
        if later:
            self.given = {"ns": str(later[-1][0]), "path": later[-1][1]}
        return self.given

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.given = max(self.given, end, key=self._place)
        low, high = self._place(start), self._place(end)
        return dealt([f for f in found(self.path) if low < f.place <= high], self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.path, partition.files)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def _option(self, name: str, default: int) -> int:
        n = int(self.options.get(name, default))
        if n < 1:
            raise ValueError(f"{name} must be 1 at least")
        return n

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("documents are read from a path")
        return self.options["path"]

    def reader(self, schema: StructType) -> _Table:
        return _Table(self._path(), self._option("partitionBytes", PARTITION_BYTES))

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(self._path(), self._option("partitionBytes", PARTITION_BYTES), self._option("maxFilesPerTrigger", BATCH_FILES))


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
