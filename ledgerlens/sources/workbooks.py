"""Workbooks (xlsx) as cells: files are listed and read by Spark, so any store will do; a task unzips one at a time."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file_path string, sheet_name string, row_idx int, col_idx int, value string, vtype string"
#: Cells of a batch that goes from Python to Spark.
BATCH = 50_000
#: Bytes of a sheet that is parsed at once.
SMALL_SHEET = 1 << 16
# Fixed values of the file format: name spaces, and the built-in number formats that are dates.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: What reading a file raises that is no workbook, or a broken one.
BROKEN = (zipfile.BadZipFile, KeyError, TypeError, AttributeError, ValueError, EOFError, zlib.error, ElementTree.ParseError)
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def listing(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """(path, modificationTime, length, content) of the files in a folder; an empty folder gives no rows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def file_metadata(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("file_extension"))


def is_date_code(code: str) -> bool:
    """Whether a number format shows a date or a time."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower()
    return bool(re.search("[ymdhs]", bare)) and bare != "general"


def moment(day: float) -> datetime:
    """The moment of a day's number; the format counts a 29 February 1900 that never was."""
    return datetime(1899, 12, 31 if day < 60 else 30) + timedelta(seconds=round(day * 86400))


def _dates(book: zipfile.ZipFile) -> list[bool]:
    """Of each cell style, whether it shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = DATE_FORMATS | {int(n.get("numFmtId")) for n in root.iter(f"{MAIN}numFmt") if is_date_code(n.get("formatCode", ""))}
    styles = root.find(f"{MAIN}cellXfs")
    return [int(x.get("numFmtId", 0)) in dated for x in styles] if styles is not None else []


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in order."""
    return _named_parts(book.read("xl/_rels/workbook.xml.rels"), book.read("xl/workbook.xml"))


@lru_cache(64)
def _named_parts(rels: bytes, told: bytes) -> list[tuple[str, str]]:
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(rels)}
    found = ElementTree.fromstring(told).iter(f"{MAIN}sheet")
    return [(s.get("name"), t.lstrip("/") if (t := links[s.get(f"{LINK}id")]).startswith("/") else f"xl/{t}") for s in found]


def column_index(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _value(cell, shared: list[str], dated: list[bool]) -> tuple[str, str] | None:
    kind, raw = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t")), "text"
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)], "text"
    if kind == "b":
        return ("True" if raw == "1" else "False"), "boolean"
    if kind in ("str", "e", "d"):
        return raw, {"str": "text", "e": "error", "d": "date"}[kind]
    style = int(cell.get("s", 0))
    if style < len(dated) and dated[style]:
        return moment(float(raw)).isoformat(), "date"
    return raw, "number"


def _elements(book: zipfile.ZipFile, part: str) -> Iterator[ElementTree.Element]:
    """A sheet's elements as they end; of a small one its rows at once, unless it is broken."""
    if book.getinfo(part).file_size <= SMALL_SHEET:
        try:
            root = ElementTree.fromstring(book.read(part))
        except ElementTree.ParseError:
            pass
        else:
            yield from root.iter(f"{MAIN}row")
            return
    for _, x in ElementTree.iterparse(book.open(part)):
        yield x


def book_cells(content, wanted=None) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, column, value, kind) of a workbook's cells, from bytes or an open file; sheets that are not ``wanted`` stay zipped."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        shared, dated = [], _dates(book)
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        for name, part in _sheets(book):
            if wanted is not None and name not in wanted:
                continue
            row = -1
            for x in _elements(book, part):
                if x.tag == f"{MAIN}row":
                    row = int(x.get("r", row + 2)) - 1
                    for k, c in enumerate(x.iter(f"{MAIN}c")):
                        if found := _value(c, shared, dated):
                            yield name, row, column_index(c.get("r")) if c.get("r") else k, *found
                    x.clear()


def cell_batches(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    """Batches of the cells that ``rows`` (path, content) gives of each file; small files share a batch."""
    every = (cell for b in batches for path, content in zip(b.column("path"), b.column("content")) for cell in rows(path.as_py(), content.as_py()))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
    while some := list(islice(every, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names=[c.split()[0] for c in CELLS.split(", ")])


def workbook_cells(files: DataFrame) -> DataFrame:
    """A row for each cell that holds something, of all sheets, from (path, content).

    Dates are ISO text. A file that is no workbook gives one row with the error in ``value``, ``error`` in
    ``vtype`` and nulls between, as does null content; other files are read all the same. Empty sheets give no rows.
    """
    def rows(path, content):
        try:
            for cell in book_cells(content):
                yield path, *cell
        except BROKEN as e:
            yield path, None, None, None, f"{type(e).__name__}: {e}", "error"

    return files.select("path", "content").mapInArrow(lambda batches: cell_batches(batches, rows), CELLS)


# Rows and columns at the top left that are looked through for formulas.
FORMULA_CELLS = 9
FACTS = "file_path string, sheet_name string, n_rows int, n_cols int, has_formulas boolean, merged array<struct<range:string,min_row:int,max_row:int,min_col:int,max_col:int>>"


def _corner(ref: str) -> tuple[int, int]:
    """Row and column of a cell's name, from 0."""
    return int(re.sub("[^0-9]", "", ref)) - 1, column_index(ref)


def _facts(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for name, part in _sheets(book):
            rows = cols = 0
            formulas, merged = False, []
            for _, x in ElementTree.iterparse(book.open(part)):
                if x.tag == f"{MAIN}c" and x.get("r"):
                    r, c = _corner(x.get("r"))
                    rows, cols = max(rows, r + 1), max(cols, c + 1)
                    formulas |= r < FORMULA_CELLS and c < FORMULA_CELLS and x.find(f"{MAIN}f") is not None
                elif x.tag == f"{MAIN}mergeCell":
                    first, _, last = x.get("ref").partition(":")
                    (r0, c0), (r1, c1) = _corner(first), _corner(last or first)
                    merged.append({"range": x.get("ref"), "min_row": r0, "max_row": r1, "min_col": c0, "max_col": c1})
                elif x.tag == f"{MAIN}row":
                    x.clear()
            yield name, rows, cols, formulas, merged


def sheet_facts(files: DataFrame) -> DataFrame:
    """A row a sheet, empty ones too, from (path, content): its size, whether its corner has formulas, and its merged ranges.

    Files that are no workbooks give no row here; ``workbook_cells`` tells of them.
    """
    names = ["file_path", "sheet_name", "n_rows", "n_cols", "has_formulas", "merged"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, *f) for f in list(_facts(content))]
                except BROKEN:
                    continue
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, FACTS)


def column_range(cells: DataFrame, first: int, last: int) -> DataFrame:
    return cells.where(F.col("col_idx").between(first, last))
