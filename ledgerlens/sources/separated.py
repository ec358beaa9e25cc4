"""Separated values of any file: each has its own delimiter and encoding, quoted cells may hold line ends, and one file is read by many tasks.

Spark splits files at line ends, also at those within quotes. Each task goes through the lines of its splits twice at once, as if
the split began outside and inside of a quote; the small table of how splits end then tells, split by split, which was right, and
only lines of cells that go over line ends are shuffled to be put together.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.sources.workbooks import CELLS
from ledgerlens.store import written

# Delimiters in the order in which they are tried.
DELIMITERS = [",", ";", "\t", "|"]
#: Lines of a file's head in which its first record is looked for.
HEAD = 1000
#: Files whose facts go to all tasks; with more of them lines are joined to the facts by a shuffle.
FILES = 200_000
#: Rows of a batch that goes back to Spark.
ROWS = 5000
SHEET = "Sheet1"
AT = ["file_path", "block"]


# ---- one record, one line


def fields(record: str, sep: str) -> list[str]:
    """The cells of one record. Its size has no limit."""
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=sep), [])


def quoted_after(line: str, sep: str, quoted: bool) -> bool:
    """Whether a quoted cell is open at the line's end, if one was (or was not) at its start. Quotes open a cell only at its start."""
    if '"' not in line:
        return quoted
    at = 0
    if not quoted:
        if line.startswith('"'):
            at = 1
        elif (at := line.find(f'{sep}"') + 2) == 1:
            return False
    while True:
        end = line.find('"', at)
        if end < 0:
            return True
        if line.startswith('"', end + 1):
            at = end + 2
        elif (at := line.find(f'{sep}"', end + 1) + 2) == 1:
            return False


def delimiter_of(head: str) -> tuple[str | None, int]:
    """The first delimiter that gives the first record more than one cell, and how many; None where none does."""
    csv.field_size_limit(sys.maxsize)
    for sep in DELIMITERS:
        try:
            first = next((r for r in csv.reader(io.StringIO(head, newline=""), delimiter=sep) if r), [])
        except csv.Error:
            continue
        if len(first) > 1:
            return sep, len(first)
    return None, 1


def encoding_name(start: bytes, valid: bool) -> str:
    """By the mark at a file's start, else UTF-8 if its bytes are valid, else windows-1252."""
    if start.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if start.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16le" if start[0] == 0xFF else "utf-16be"
    return "utf-8" if valid else "windows-1252"


def decoded(content: bytes, encoding: str) -> str:
    """Text of bytes, without the mark of the encoding; what is no text in it is replaced."""
    return content.decode("utf-8" if encoding == "utf-8-sig" else encoding, "replace").removeprefix("﻿")


def whole_rows(content: bytes) -> Iterator[tuple[list[str], str | None]]:
    """(cells, error) of the records of a file that is at hand as a whole. Blank lines are left out, and a record with more
    cells than the first one has an error."""
    try:
        content.decode("utf-8")
        valid = True
    except UnicodeDecodeError:
        valid = False
    text = decoded(content, encoding_name(content[:3], valid))
    sep, width = delimiter_of(text)
    open_, parts = False, []
    # a line end is a line feed, with or without a carriage return before it; no other character ends a line
    for line in text.split("\n"):
        if not parts and not line.strip("\r"):
            continue
        parts.append(line)
        open_ = quoted_after(line, sep or "|", open_)
        if not open_:
            yield _row("\n".join(parts), sep, width)
            parts = []
    for k, line in enumerate(parts):
        row = _row(line, sep, width)
        yield (row[0], UNCLOSED) if k == 0 else row


UNCLOSED = "BadRecord: a quote is not closed"


def _row(record: str, sep: str | None, width: int) -> tuple[list[str], str | None]:
    record = record.removesuffix("\r")
    if sep is None:
        own = fields(record, "|") if record.startswith('"') else [record]
        return [x.strip() for x in own[:1]], None
    try:
        found = fields(record, sep)
    except csv.Error as e:
        return [record], f"BadRecord: {e}"
    return found, f"BadRecord: {len(found)} cells, the first record has {width}" if len(found) > width else None


def cell_kind(value: str) -> str:
    try:
        float(value)
        return "number"
    except ValueError:
        return "text"


def row_cells(path: str, row: int, values: list[str], error: str | None) -> Iterator[tuple]:
    """The cells of a row that hold something; a bad record is one cell that tells what is wrong, without a column."""
    if error:
        yield path, SHEET, row, None, error, "error"
        return
    for c, v in enumerate(values):
        if v != "":
            yield path, SHEET, row, c, v, cell_kind(v)


# ---- files of any size


def _lines(spark: SparkSession, path, **options) -> DataFrame:
    """(file_path, block, value): the lines of files as bytes, in the order in which a task reads them; ``block`` is where a split starts."""
    at = F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.options(lineSep="\n", **options).text(path).select(*at, F.col("value").cast("binary").alias("value"))


def _runs(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[bool, dict]]:
    """The rows in order, and whether each is the first of its split."""
    last = None
    for batch in batches:
        for values in zip(*[batch.column(c).to_pylist() for c in columns]):
            yield values[:2] != last, values
            last = values[:2]


FACTS = "file_path string, block long, valid boolean, head binary"


def _facts(batches):
    """Of each split: are its bytes UTF-8, and, if it starts its file, the file's first lines."""
    def out(row):
        return pa.RecordBatch.from_pylist([row], pa.schema([("file_path", pa.string()), ("block", pa.int64()), ("valid", pa.bool_()), ("head", pa.binary())]))

    now, head = None, []
    for first, (path, block, value) in _runs(batches, [*AT, "value"]):
        if first:
            if now:
                yield out(now | {"head": b"\n".join(head)})
            now, head = {"file_path": path, "block": block, "valid": True}, []
        if block == 0 and len(head) < HEAD:
            head.append(value)
        if now["valid"] and not value.isascii():
            try:
                value.decode("utf-8")
            except UnicodeDecodeError:
                now["valid"] = False
    if now:
        yield out(now | {"head": b"\n".join(head)})


def _described(batches):
    import pandas as pd

    for g in batches:
        encodings = [encoding_name(h, v) for h, v in zip(g["head"], g["valid"])]
        found = [delimiter_of(decoded(h, e)) for h, e in zip(g["head"], encodings)]
        yield pd.DataFrame({"file_path": g["file_path"], "encoding": encodings, "sep": [f[0] for f in found], "width": [f[1] for f in found]})


def file_facts(spark: SparkSession, path) -> DataFrame:
    """(file_path, encoding, sep, width) of text files: a row for each that is not empty; no delimiter is null.

    Files are read once, split by split. All bytes decide whether a file is UTF-8; the first record, if it ends within
    ``HEAD`` lines, decides its delimiter and how many cells a record may have.
    """
    splits = _lines(spark, path).mapInArrow(_facts, FACTS)
    g = splits.groupBy("file_path").agg(F.bool_and("valid").alias("valid"), F.max(F.when(F.col("block") == 0, F.col("head"))).alias("head"))
    return g.select("file_path", "valid", F.coalesce("head", F.lit(b"")).alias("head")).mapInPandas(_described, "file_path string, encoding string, sep string, width int")


LINES = "file_path string, block long, line long, text string, sep string, width int, before array<boolean>, after array<boolean>, record array<long>"


def _both_ways(batches):
    """Lines with the state before and after them and the number of their record in the split, had the split begun outside and
    inside of a quoted cell. Blank lines that are in no cell either way are left out."""
    names = [c.split()[0] for c in LINES.split(", ")]
    schema = pa.schema([(names[0], pa.string()), (names[1], pa.int64()), (names[2], pa.int64()), (names[3], pa.string()), (names[4], pa.string()), (names[5], pa.int32()),
                        (names[6], pa.list_(pa.bool_())), (names[7], pa.list_(pa.bool_())), (names[8], pa.list_(pa.int64()))])
    rows, state, record, line = [], [False, True], [0, 0], 0
    for first, (path, block, value, encoding, sep, width) in _runs(batches, [*AT, "value", "encoding", "sep", "width"]):
        if first:
            state, record, line = [False, True], [0, 0], 0
        text = decoded(value, encoding) if line == 0 and block == 0 else value.decode("utf-8" if encoding == "utf-8-sig" else encoding, "replace")
        line += 1
        blank = not text.strip("\r")
        before = state
        state = [quoted_after(text, sep or "|", s) for s in before]
        record = [r + (not s and not blank) for r, s in zip(record, before)]
        if not blank or any(before):
            rows.append((path, block, line, text, sep, width, before, state, record))
        if len(rows) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _starts(lines: DataFrame) -> DataFrame:
    """(file_path, block, start, offset, open, last): in which state each split really begins, the number of records before it, and whether its
    file ends within a quote, with the number of its last record.

    A split keeps the state, turns it, or ends in one state whatever it was; so the state is that of the last split
    that sets it, turned as often as splits since then turn it. A file has a row a split here.
    """
    ends = lines.groupBy(*AT).agg(F.max_by(F.struct("after", "record"), "line").alias("e")).select(*AT, F.col("e.after").alias("after"), F.col("e.record").alias("record"))
    a0, a1 = F.col("after")[0], F.col("after")[1]
    w = Window.partitionBy("file_path").orderBy("block")
    earlier, every = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file_path")
    turned = F.coalesce(F.sum((a0 & ~a1).cast("int")).over(earlier), F.lit(0))
    ends = ends.withColumn("turned", turned)
    ends = ends.withColumn("set", F.last(F.when(a0 == a1, F.struct(a0.cast("int").alias("v"), "turned")), ignorenulls=True).over(earlier))
    start = F.when(F.col("set").isNull(), F.col("turned")).otherwise(F.col("set.v") + F.col("turned") - F.col("set.turned")) % 2
    ends = ends.withColumn("start", start.cast("int"))
    own = F.get("record", F.col("start"))
    ends = ends.withColumn("offset", F.coalesce(F.sum(own).over(earlier), F.lit(0)))
    ends = ends.withColumn("open", F.max_by(F.get("after", F.col("start")), "block").over(every)).withColumn("last", F.sum(own).over(every))
    return ends.select(*AT, "start", "offset", "open", "last")


PARSED = "file_path string, block long, line long, cells array<string>, error string"


def _parsed(batches):
    schema = pa.schema([("file_path", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
    for batch in batches:
        got = {c: batch.column(c).to_pylist() for c in ("text", "sep", "width", "lost")}
        rows = [_row(*r[:3]) for r in zip(got["text"], got["sep"], got["width"])]
        errors = [UNCLOSED if lost else e for (_, e), lost in zip(rows, got["lost"])]
        own = [batch.column(k) for k in ("file_path", "block", "line")]
        yield pa.RecordBatch.from_arrays([*own, pa.array([r for r, _ in rows], pa.list_(pa.string())), pa.array(errors, pa.string())], schema=schema)


def records(spark: SparkSession, path) -> DataFrame:
    """(file_path, row_no, cells, error) of text files in a folder, or of a list of them; rows are numbered from 0 in each.

    Each file has its own delimiter and encoding. Quoted cells are whole, with line ends and delimiters in them, however long
    they are. Blank lines and empty files give no rows. A record that has more cells than its file's first, or that can't be
    read, keeps its place by an ``error``; its number is that of the good row before it, so good rows are numbered without gaps.
    Where a file ends within a quote, the record with that quote is such a row, and each line after it is read as a record.
    In UTF-16 the two characters U+0A00 to U+0AFF and U+xx00 after each other are taken for a line end.
    """
    facts = written(file_facts(spark, path))
    small = facts.count() <= FILES

    def seen(lines: DataFrame, own: DataFrame) -> DataFrame:
        if small:
            return lines.join(F.broadcast(own), "file_path").select(*AT, "value", "encoding", "sep", "width").mapInArrow(_both_ways, LINES)
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(own, "file_path")
        placed = placed.repartition(*AT).sortWithinPartitions(*AT, "at")
        return placed.select(*AT, "value", "encoding", "sep", "width").mapInArrow(_both_ways, LINES)

    lines = seen(_lines(spark, path), facts.where("encoding not like 'utf-16%'"))
    # in UTF-16 a line end is two bytes; such files are named one by one
    for encoding in ("utf-16le", "utf-16be"):
        if wide := [unquote(r["file_path"]) for r in facts.where(F.col("encoding") == encoding).select("file_path").collect()]:
            lines = lines.unionByName(seen(_lines(spark, wide, encoding=encoding.upper()), facts.where(F.col("encoding") == encoding)))
    lines = written(lines)
    at = lines.join(_starts(lines), AT)
    state = lambda c: F.get(c, F.col("start"))
    at = at.select(*AT, "line", "text", "sep", "width", state("before").alias("before"), state("after").alias("after"), (F.col("offset") + state("record")).alias("record"), "open", "last")
    at = at.where(F.col("before") | (F.rtrim(F.col("text"), F.lit("\r")) != ""))
    lost = F.col("open") & (F.col("record") == F.col("last"))
    at = at.withColumn("tail", lost)
    alone = at.where(F.col("tail") | ~(F.col("before") | F.col("after"))).withColumn("lost", F.col("tail") & ~F.col("before"))
    parts = at.where(~F.col("tail") & (F.col("before") | F.col("after"))).groupBy("file_path", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("p"), F.any_value("sep").alias("sep"), F.any_value("width").alias("width"))
    glued = parts.select("file_path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["line"].alias("line"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), "sep", "width", F.lit(False).alias("lost"))
    parsed = written(alone.select(*AT, "line", "text", "sep", "width", "lost").unionByName(glued).mapInArrow(_parsed, PARSED))
    # good rows are counted in each split, and splits of a file after each other
    own = parsed.groupBy(*AT).agg(F.count_if(F.col("error").isNull()).alias("n"))
    before = own.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    good = F.sum(F.col("error").isNull().cast("int")).over(Window.partitionBy(*AT).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    numbered = parsed.withColumn("k", good).join(before, AT)
    return numbered.select("file_path", (F.col("first") + F.col("k") - 1).cast("long").alias("row_no"), "cells", "error")


def _cells_of(batches):
    import pandas as pd

    names = [c.split()[0] for c in CELLS.split(", ")]
    for g in batches:
        rows = [x for path, row, values, error in zip(g["file_path"], g["row_no"], g["cells"], g["error"]) for x in row_cells(path, row, values, error)]
        yield pd.DataFrame(rows, columns=names).astype({"row_idx": "Int32", "col_idx": "Int32"})


def cells(spark: SparkSession, path) -> DataFrame:
    """The cells of text files of any size, as ``CELLS``; a bad record is a cell without a column, of the kind ``error``."""
    found = records(spark, path)
    return found.select("file_path", "row_no", F.coalesce("cells", F.array().cast("array<string>")).alias("cells"), "error").mapInPandas(_cells_of, CELLS)


def table(spark: SparkSession, path, header: bool = True) -> DataFrame:
    """The files of a folder that have one shape as one table of text; bad records are left out, short ones have nulls at the end.

    With a header the columns have the names in the first row of the file that is first by its name (one row comes to the driver).
    """
    found = records(spark, path).where("error is null")
    first = found.where("row_no = 0").orderBy("file_path").limit(1).select("cells").collect()
    if not first:
        return spark.createDataFrame([], "value string")
    names = first[0]["cells"] if header else [f"_c{k}" for k in range(len(first[0]["cells"]))]
    body = found.where("row_no > 0") if header else found
    return body.select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])
