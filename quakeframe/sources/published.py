"""Published tables as a data source: ``spark.read.format("published_table")`` and ``readStream``.

Options: ``path`` (a folder or a file, any file system that Arrow opens), ``table`` (summary,
levels, or spectrum), ``encoding`` (CP932, else UTF-8, where none is given).  A file is a
partition; only the columns of the given schema are cut out of its lines, as strings, blank
and "-" being null.  The stream takes files in the order of their time and name, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .records import LEVELS, SUMMARY

#: Position of each column; the spectrum table's columns beyond the period are asked for by schema as p1, p2, ...
TABLES = {"summary": SUMMARY, "levels": LEVELS, "spectrum": {"period": 0}}
BATCH = 1 << 14


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(uri: str) -> list[tuple[int, str]]:
    """(time, path) of the files under a path, in order; hidden ones left out."""
    where, path = pafs.FileSystem.from_uri(uri)
    info = where.get_file_info(path)
    found = [info] if info.type == pafs.FileType.File else where.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


class _Cut:
    """Reads one file's lines into the columns of the schema."""

    def __init__(self, schema: StructType, options: dict):
        self.uri, self.table, self.encoding = options["path"], options.get("table", "summary"), options.get("encoding")
        if self.table not in TABLES:
            raise ValueError(f"table must be one of {', '.join(TABLES)}, not {self.table!r}")
        place = TABLES[self.table]
        self.names = schema.fieldNames()
        self.at = [None if n == "source" else place[n] if n in place else int(n[1:]) for n in self.names]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        where, _ = pafs.FileSystem.from_uri(self.uri)
        with where.open_input_stream(partition.path) as f:
            data = f.read()
        text = self.decoded(data, partition.path)
        lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
        head = next((k for k, x in enumerate(lines) if x.startswith("period,")), None) if self.table == "spectrum" else 0
        body = [] if head is None else lines[head + 1 :]
        for start in range(0, len(body), BATCH):
            rows = [x.split(",") for x in body[start : start + BATCH]]
            columns = [[partition.path] * len(rows) if k is None else [self.cell(r, k) for r in rows] for k in self.at]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=self.names)

    def decoded(self, data: bytes, path: str) -> str:
        for name in (self.encoding,) if self.encoding else ("utf-8-sig", "cp932"):
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
        raise ValueError(f"{path} doesn't decode")

    @staticmethod
    def cell(row: list[str], k: int) -> str | None:
        value = row[k].strip() if k < len(row) else ""
        return None if value in ("", "-") else value


class Reader(_Cut, DataSourceReader):
    def partitions(self) -> list[File]:
        return [File(path) for _, path in _files(self.uri)]


class StreamReader(_Cut, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": len(_files(self.uri))}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(path) for _, path in _files(self.uri)[start["files"] : end["files"]]]

    def commit(self, end: dict) -> None:
        pass


class PublishedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published_table"

    def schema(self) -> StructType:
        table = self.options.get("table", "summary")
        return StructType([StructField(n, StringType()) for n in [*TABLES.get(table, SUMMARY), "source"]])

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PublishedTable)
