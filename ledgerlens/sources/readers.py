"""Files of any kind as cells: a reader by the file's name, others in turn where it fails, and what went wrong as rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.errors import FileReadError
from ledgerlens.sources import old_workbooks, separated, workbooks

# Name endings of each reader.
WORKBOOKS, OLD_WORKBOOKS, TEXTS = [".xlsx", ".xlsm", ".xlsb"], [".xls"], [".csv"]
#: Name endings of files in a folder that are read.
PATTERN = "*.{xlsx,xls}"


ReadError = FileReadError


def kind_of(path) -> F.Column:
    """``workbook``, ``old_workbook``, ``text`` or ``other``, by a path's ending."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ending.isin(WORKBOOKS), "workbook").when(ending.isin(OLD_WORKBOOKS), "old_workbook").when(ending.isin(TEXTS), "text").otherwise("other")


def _kind(path: str) -> str:
    """What ``kind_of`` says of a path."""
    ending = path.lower()[path.rfind(".") :] if "." in path.rsplit("/", 1)[-1] else ""
    return "workbook" if ending in WORKBOOKS else "old_workbook" if ending in OLD_WORKBOOKS else "text" if ending in TEXTS else "other"


def _text_rows(path: str, content: bytes):
    good = 0
    for values, error in separated.whole_rows(content):
        yield from separated.row_cells(path, good - bool(error), values, error)
        good += not error


def _is_text(content) -> bool:
    try:
        return isinstance(content, bytes) and b"\x00" not in content and content.decode("utf-8") is not None
    except UnicodeDecodeError:
        return False


def _file_rows(path: str, content):
    """The cells of one file by the reader of its kind, by the next one where that fails, and what went wrong as the last row."""
    error = lambda e: (path, None, None, None, e if isinstance(e, str) else f"{type(e).__name__}: {e}", "error")
    kind = _kind(path)
    # a workbook's ending may be that of the other format
    old = kind != "text" and old_workbooks.is_old(content)
    if kind == "old_workbook" and not old and not (isinstance(content, bytes) and content.startswith(b"PK")):
        yield error("ReadError: no reader for this format")
        return
    try:
        if kind == "text":
            yield from _text_rows(path, content)
        else:
            for cell in (old_workbooks if old else workbooks).book_cells(content):
                yield path, *cell
    except workbooks.BROKEN as e:
        if kind == "text" or not _is_text(content):
            yield error(e)
        else:
            # what is text is no part of a workbook that could be read, so nothing came before this
            yield from _text_rows(path, content)


def cells(files: DataFrame) -> DataFrame:
    """Cells of (path, content) files by the reader of their kind. A workbook that cannot be read as one is tried as text, if it is
    text; what no reader reads gives an error row.

    Each file is read once, in the task that has its content; text files of any size are read by ``separated.cells``.
    """
    return files.select("path", "content").mapInArrow(lambda batches: workbooks.cell_batches(batches, _file_rows), workbooks.CELLS)


def folder(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """(path, content and sizes) of a folder's files by their names; an empty folder gives no rows, one that is not there is a ``FileReadError``."""
    try:
        return workbooks.listing(spark, path, pattern)
    except AnalysisException as e:
        raise FileReadError(f"no such folder or file: {path}") from e


def file_status(found: DataFrame) -> DataFrame:
    """(file_path, status, n_sheets, n_cells, error) of cells: a row a file."""
    bad = F.col("vtype").eqNullSafe("error") & F.col("sheet_name").isNull()
    g = found.groupBy("file_path").agg(F.bool_or(bad).alias("bad"), F.count_distinct("sheet_name").alias("n_sheets"), F.count_if(~bad).alias("n_cells"), F.max(F.when(bad, F.col("value"))).alias("error"))
    return g.select("file_path", F.when(F.col("bad"), "error").otherwise("success").alias("status"), "n_sheets", "n_cells", "error")
