"""Editions as a data source of its own: batch reads open only the files that a filter on date and edition leaves, streams go on from an offset.

Editions lie below a path as ``<date>/<edition>.json``, one JSON document each. They are immutable and appear in the order of their names, so
that a name is a stream's offset. Register once with ``spark.dataSource.register(EditionSource)``; then ``spark.read.format("editions").load(path)``
or ``spark.readStream.format("editions")``. Pushed filters need ``spark.sql.python.filterPushdown.enabled``. The path may be in any store that
Arrow's file systems know.

Defined cases: other files are passed over; a missing path has no editions; a document that isn't JSON or isn't an object is a row whose ``body`` is null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = re.compile(r"(\d{4}-\d{2}-\d{2})/([a-z]+)\.json")
SCHEMA = "date string, edition string, file string, id string, body string"
#: How a filter on a value is tried.
TRIED = {
    EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value,
}


class File(InputPartition):
    """One edition's file."""

    def __init__(self, name: str):
        super().__init__(name)


def _names(path: str, dates=lambda date: True) -> list[str]:
    """Names of edition files in order; folders of dates that aren't asked for aren't listed."""
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    folders = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    out = []
    for folder in folders:
        if folder.type == fs.FileType.Directory and dates(folder.base_name):
            out += [f"{folder.base_name}/{f.base_name}" for f in store.get_file_info(fs.FileSelector(folder.path)) if f.type == fs.FileType.File]
    return sorted(n for n in out if NAME.fullmatch(n))


def _row(path: str, name: str) -> tuple:
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with store.open_input_stream(f"{root}/{name}") as f:
        text = f.read().decode("utf-8", "replace")
    date, edition = NAME.fullmatch(name).groups()
    try:
        found = json.loads(text)
        made = (str(found.get("id", f"{date}-{edition}")), text) if isinstance(found, dict) else (None, None)
    except ValueError:
        made = (None, None)
    return (date, edition, name, *made)


def _batch(path: str, name: str) -> pa.RecordBatch:
    columns = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in _row(path, name)], names=columns)


class EditionReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on date and edition are answered here; the others are left to Spark."""
        for f in filters:
            if type(f) in TRIED and f.attribute in (("date",), ("edition",)) and f.value is not None:
                self.filters.append((f.attribute[0], type(f), f))
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return all(TRIED[kind](value, f) for c, kind, f in self.filters if c == column)

    def partitions(self) -> list[File]:
        names = _names(self.path, lambda date: self._wanted("date", date))
        return [File(n) for n in names if self._wanted("edition", NAME.fullmatch(n)[2])]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # where there are no files, Spark asks once all the same
            yield _batch(self.path, partition.value)


class EditionStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"name": ""}

    def latestOffset(self) -> dict:
        return {"name": max(_names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[File]:
        first = start["name"][:10]
        return [File(n) for n in _names(self.path, lambda date: date >= first) if start["name"] < n <= end["name"]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        yield _batch(self.path, partition.value)

    def commit(self, end: dict) -> None:
        """Nothing is kept: an offset is a name, and files stay."""


class EditionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "editions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EditionReader:
        return EditionReader(self.options["path"])

    def streamReader(self, schema) -> EditionStream:
        return EditionStream(self.options["path"])
