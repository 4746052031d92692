"""A data source of its own for catalogues of files: ``spark.read.format("file_catalogue").load(folder)``.

Reading lists the files below a folder, a partition for each group of its sub-folders. With the option ``filters`` set to
``pushed`` it takes filters on the columns, so that what a filter leaves out isn't sent to Spark. Spark keeps filters that a source took with the
frame that was loaded, so such a frame must be used for one condition only: :func:`files` loads anew for each. Writing appends rows of a catalogue as JSON lines: tasks write drafts, which
become visible together when the job commits. Paths are of any file system that Arrow knows.
"""

from __future__ import annotations

import json
import operator
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage

COLUMNS = ["path", "folder", "name", "suffix", "size", "modified"]
SCHEMA = "path string, folder string, name string, suffix string, size long, modified timestamp"
FOLDERS = 64  # at most so many partitions
COMPARED: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda v, among: v in among, StringStartsWith: str.startswith, StringEndsWith: str.endswith}


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Folders(InputPartition):
    """Sub-folders whose files are listed at any depth, and whether the top folder's own files belong to the partition."""

    names: list[str]
    top: bool


@dataclass
class Draft(WriterCommitMessage):
    path: str | None
    rows: int


class CatalogueReader(DataSourceReader):
    def __init__(self, path: str, takes: bool):
        self.path, self.takes, self.filters = path, takes, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Filters that :meth:`read` applies are kept, the others go back to Spark."""
        for f in filters:
            if self.takes and type(f) in COMPARED and len(f.attribute) == 1 and f.attribute[0] in ("path", "folder", "name", "suffix", "size"):
                self.filters.append((type(f), COLUMNS.index(f.attribute[0]), f.value))
            elif not (self.takes and isinstance(f, IsNotNull)):  # no column is ever null
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = file_system(self.path)
        below = sorted(x.path for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory)
        return [Folders([], True)] + [Folders(part, False) for k in range(FOLDERS) if (part := below[k::FOLDERS])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = file_system(self.path)
        tests = [(COMPARED[kind], at, value) for kind, at, value in self.filters]
        for folder in [root] if partition.top else partition.names:
            for x in system.get_file_info(fs.FileSelector(folder, recursive=not partition.top)):
                if x.type != fs.FileType.File or x.base_name.startswith((".", "_")):
                    continue
                row = x.path, x.path[len(root):].strip("/").rpartition("/")[0], x.base_name, "." + x.extension.lower() if x.extension else "", x.size, x.mtime
                if all(f(row[at], value) for f, at, value in tests):
                    yield row


class CatalogueWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Draft:
        system, root = file_system(self.path)
        system.create_dir(root)
        at, n, out = f"{root}/_draft-{self.job}-{uuid.uuid4().hex}", 0, None
        for r in rows:
            out = out or system.open_output_stream(at)
            out.write(json.dumps(r.asDict(), ensure_ascii=False, default=str).encode() + b"\n")
            n += 1
        if out:
            out.close()
        return Draft(at if out else None, n)

    def commit(self, messages: list[Draft | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        old = [x.path for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.endswith(".jsonl")] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m and m.path):
            system.move(m.path, f"{root}/{self.job}-{k:05d}.jsonl")
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[Draft | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


class FileCatalogue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogueReader:
        return CatalogueReader(self.options["path"], self.options.get("filters") == "pushed")

    def writer(self, schema, overwrite: bool) -> CatalogueWriter:
        return CatalogueWriter(self.options["path"], overwrite)


def files(spark: SparkSession, path: str, condition: str | Column = "true") -> DataFrame:
    """Files below ``path`` that fulfil a condition, which the source applies as far as it can."""
    register(spark)
    return spark.read.format("file_catalogue").option("filters", "pushed").load(path).where(condition)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileCatalogue)
