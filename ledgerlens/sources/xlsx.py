"""``spark.read.format("xlsx")``: workbooks as a data source, a partition a file; filters on sheets, rows and columns are pushed into the reader.

    register(spark)
    spark.read.format("xlsx").option("range", "A1:C20").load(folder).where("sheet_name = 'Sheet1'")

Sheets that no filter asks for stay zipped. Files are listed and opened through Arrow's file systems, so local paths and the stores
that these know by their address will do; for a store that only Spark reads there is ``workbooks.workbook_cells``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import quote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from ledgerlens.errors import ConfigurationError, FileReadError
from ledgerlens.sources import workbooks

#: Bounds of a place that leave all in.
OPEN = {"row_idx": (0, 1 << 31), "col_idx": (0, 1 << 31)}


def range_bounds(text: str) -> dict[str, tuple[int, int]]:
    """Rows and columns of a range such as ``A1:C20`` or ``B:D``, from 0."""
    found = re.fullmatch(r"([A-Za-z]+)(\d*)(?::([A-Za-z]+)(\d*))?", text.strip())
    if not found:
        raise ConfigurationError(f"no range: {text}")
    c0, r0, c1, r1 = found.groups()
    column = lambda c: workbooks.column_index(c)
    first = int(r0) - 1 if r0 else 0
    last = int(r1) - 1 if r1 else (first if r0 and c1 is None else OPEN["row_idx"][1])
    return {"row_idx": (first, last), "col_idx": (column(c0), column(c1 or c0))}


class XlsxSource(DataSource):
    """Options: ``path``, ``pattern`` of file names (``*.xlsx``), ``sheet`` and ``range``. The rows are those of ``workbooks.workbook_cells``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return workbooks.CELLS

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(dict(self.options))


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ConfigurationError("no path")
        self.path, self.pattern = options["path"], options.get("pattern", "*.xlsx")
        self.sheets = {options["sheet"]} if "sheet" in options else None
        self.bounds = dict(OPEN) | (range_bounds(options["range"]) if "range" in options else {})

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what narrows sheets, rows and columns down; Spark applies the rest."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "sheet_name" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sheets = asked if self.sheets is None else self.sheets & asked
            elif name in self.bounds and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low, high = self.bounds[name]
                at = f.value
                low = max(low, at + isinstance(f, GreaterThan)) if not isinstance(f, (LessThan, LessThanOrEqual)) else low
                high = min(high, at - isinstance(f, LessThan)) if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else high
                self.bounds[name] = low, high
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileReadError(f"no such folder or file: {self.path}")
        # an address has its blanks and the like spelt out, a plain path has not; a bucket is in the path, a host is not
        at = urlsplit(self.path)
        named = (lambda p: f"{at.scheme}://{at.netloc if p.startswith('/') else ''}{quote(p)}") if ":" in self.path else str
        if found.type == fs.FileType.File:
            return [File(self.path)]
        inside = system.get_file_info(fs.FileSelector(path, recursive=False))
        return [File(named(x.path)) for x in sorted(inside, key=lambda x: x.path) if x.type == fs.FileType.File and fnmatch(x.base_name, self.pattern)]

    def read(self, partition: File) -> Iterator[tuple]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path) if ":" in partition.path else (fs.LocalFileSystem(), partition.path)
        (top, bottom), (left, right) = self.bounds["row_idx"], self.bounds["col_idx"]
        narrowed = self.bounds != OPEN or self.sheets is not None
        try:
            with system.open_input_file(path) as file:
                for sheet, row, col, value, kind in workbooks.book_cells(file, self.sheets):
                    if top <= row <= bottom and left <= col <= right:
                        yield partition.path, sheet, row, col, value, kind
        except workbooks.BROKEN as e:
            # an error has neither sheet nor place, so a filter on them leaves it out
            if not narrowed:
                yield partition.path, None, None, None, f"{type(e).__name__}: {e}", "error"


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XlsxSource)
