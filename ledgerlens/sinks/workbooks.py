"""Workbooks from cells: files are sorted within tasks and made one after the other, as bytes in a row."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.store import dealt

# Fixed values of the file format: the parts that every workbook has.
TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Columns of a workbook's cells.
CELL = ["sheet_name", "row_idx", "col_idx", "value", "vtype"]
#: Bytes of workbooks that go from Python to Spark together.
BATCH_BYTES = 1 << 22


@lru_cache(1024)
def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(row: int, col: int, value: str, kind: str) -> str:
    at = f'r="{_letters(col)}{row + 1}"'
    if kind == "number":
        return f"<c {at}><v>{value}</v></c>"
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def _book(cells: pd.DataFrame) -> bytes:
    """A workbook of cells in any order."""
    return _made(list(cells.sort_values(["sheet_name", "row_idx", "col_idx"])[CELL].itertuples(index=False, name=None)))


def _made(cells: list[tuple]) -> bytes:
    """A workbook of (sheet, row, column, value, kind), which come in order of sheets, rows and columns."""
    sheets = [(name, list(own)) for name, own in groupby(cells, lambda c: c[0])]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _fixed_parts(tuple(name for name, _ in sheets)):
            z.writestr(name, text)
        for k, (_, own) in enumerate(sheets, 1):
            rows = "".join(f'<row r="{r + 1}">' + "".join(_cell(r, c, v, t) for _, _, c, v, t in g) + "</row>" for r, g in groupby(own, lambda c: c[1]) if r is not None)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{SHEET}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


@lru_cache(64)
def _fixed_parts(names: tuple[str, ...]) -> list[tuple[str, str]]:
    """The parts of a workbook that its sheets' names say."""
    over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{TYPES}.worksheet+xml"/>' for k in range(1, len(names) + 1))
    sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
    return [
        ("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
         f'<Override PartName="/xl/workbook.xml" ContentType="{TYPES}.sheet.main+xml"/>{over}</Types>'),
        ("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets>{sheets}</sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>'),
    ]


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Workbooks of cells that come in order of their files; a task holds one workbook's cells and some made workbooks."""
    cells = (c for b in batches for c in zip(*[b.column(n).to_pylist() for n in ("file_path", *CELL)]))
    made, size = [], 0
    for path, own in groupby(cells, lambda c: c[0]):
        made.append((path, _made([c[1:] for c in own])))
        size += len(made[-1][1])
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.binary()))], names=["path", "content"])
            made, size = [], 0
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.string(), pa.binary()))], names=["path", "content"])


def workbooks(cells: DataFrame) -> DataFrame:
    """(path, content) of one workbook for each ``file_path`` of cells; cells without a value are left out.

    A workbook is made in one task; the format bounds it, and one that is larger than a task should not be made. Files
    are sorted within their partition and made one after the other, so small ones cost no call each.
    """
    told = cells.where(F.col("value").isNotNull()).select("file_path", *CELL)
    return dealt(told, "file_path").sortWithinPartitions("file_path", "sheet_name", "row_idx", "col_idx").mapInArrow(_books, "path string, content binary")
