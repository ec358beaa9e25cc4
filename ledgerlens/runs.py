"""Whole runs: files to sheets, columns and keys, requirements to verdicts, answers to request lists. What is wrong with a file is a row."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.errors import ConfigurationError
from ledgerlens.functions import cleaning, dates, terms
from ledgerlens.operators import compare, grid, metadata, nested, requests, requirements, states
from ledgerlens.operators.grid import SHEET
from ledgerlens.sinks import reports
from ledgerlens.sources import readers
from ledgerlens.store import written


@dataclass(frozen=True)
class Settings:
    """How files are looked at; what is out of range is a ``ConfigurationError``."""

    scan_rows: int = grid.SCAN
    scan_cols: int = grid.SCAN
    header_score: float = grid.HEADER_SCORE
    remove_duplicates: bool = False
    infer_types: bool = True

    def __post_init__(self):
        wrong = [n for n in ("scan_rows", "scan_cols") if getattr(self, n) < 1] + ([] if 0 <= self.header_score <= 1 else ["header_score"])
        if wrong:
            raise ConfigurationError(f"out of range: {', '.join(wrong)}")


# What the named profiles change.
PROFILES = {
    "default": {},
    "fast": {"scan_rows": 10, "scan_cols": 10, "infer_types": False},
    "thorough": {"scan_rows": 50, "scan_cols": 50, "remove_duplicates": True},
    "large": {},
    "unstructured": {"scan_rows": 100, "scan_cols": 20, "header_score": 0.5, "infer_types": False},
}


def settings(profile: str = "default", **changes) -> Settings:
    """The settings of a profile with some of them changed."""
    if profile not in PROFILES:
        raise ConfigurationError(f"no such profile: {profile}")
    unknown = set(changes) - {f.name for f in fields(Settings)}
    if unknown:
        raise ConfigurationError(f"no such setting: {', '.join(sorted(unknown))}")
    return Settings(**(PROFILES[profile] | changes))


class Run(NamedTuple):
    """The tables of a run, all written, and what was counted while they were.

    ``files``: (file_path, file_name, status, n_sheets, n_cells, error), a row a file. ``sheets``: (file_path, sheet_name, structure,
    confidence, mixed, header_row, bounds, n_rows, n_columns, completeness). ``columns``: the profile of each column of a table, and
    ``states``, what it was made from and can be merged. ``values``: the cells of tables under their columns' names. ``keys``: the
    trees of key-value regions, also of those beside a table, and of whole sheets that have neither. ``entities`` and ``periods``: what columns name, and the days that they span.
    """

    files: DataFrame
    sheets: DataFrame
    columns: DataFrame
    states: DataFrame
    values: DataFrame
    keys: DataFrame
    entities: DataFrame
    periods: DataFrame
    summary: dict


COLUMN = [*SHEET, "column_name"]


def validate_files(files: DataFrame, how: Settings = Settings()) -> Run:
    """A run over (path, content) files of any kind. Files are read once; all later steps read what was written of them.

    A file that can't be read is a row of ``files`` with its error, a bad record of a text file is left out, and a sheet without
    cells is not listed. ``summary`` is observed while files and sheets are written, so it costs no job: total_files, successful,
    failed, sheets_processed and the number of sheets of each structure; all 0 for an empty folder.
    """
    cells = written(readers.cells(files))
    seen = Observation()
    status = files.select(F.col("path").alias("file_path")).join(readers.file_status(cells), "file_path", "left")
    ok = F.coalesce("status", F.lit("success"))
    status = status.select("file_path", F.regexp_extract("file_path", r"([^/]*)$", 1).alias("file_name"), ok.alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sheets", "n_cells")], "error")
    status = written(status.observe(seen, F.count("*").alias("total_files"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") != "success").alias("failed")))
    good = cells.where("sheet_name is not null and col_idx is not null")
    regions = written(grid.region_types(good, scan=how.scan_rows, scan_cols=how.scan_cols, header_score=how.header_score))
    kinds = written(grid.structures(good, found=regions))
    values = written(_table_values(good, kinds, how.remove_duplicates))
    found = written(states.column_states(values, SHEET))
    sheets, columns = _measured(kinds, values, found, how)
    kinds_seen = Observation()
    sheets = written(sheets.observe(kinds_seen, F.count("*").alias("sheets_processed"), *[F.count_if(F.col("structure") == k).alias(k) for k in ("structured", "unstructured", "unknown")]))
    keys = written(nested.region_keys(good, regions, kinds.where("structure <> 'structured'")))
    named = values.where("value is not null")
    entities = metadata.entity_analysis(named.join(metadata.entity_columns(named, SHEET), COLUMN, "left_semi"), COLUMN)
    dated = named.join(metadata.date_columns(named, SHEET), COLUMN, "left_semi").withColumn("day", dates.lenient_date(F.col("value"), serial=False).cast("date"))
    periods = metadata.period_info(dated, COLUMN, "day")
    return Run(status, sheets, columns, found, values, keys, written(entities), written(periods), seen.get | kinds_seen.get)


def _table_values(cells: DataFrame, kinds: DataFrame, remove_duplicates: bool) -> DataFrame:
    """(file_path, sheet_name, col_idx, column_name, row_no, value) of the tables of sheets; names are clean and different in a sheet.

    Columns without a name in the header are no columns. Each column has a row 0 without a value, so that empty ones are there too.
    """
    at = cells.join(kinds.where("structure = 'structured'").select(*SHEET, "min_row", "max_row", "min_col", "max_col", "header_row"), SHEET)
    at = at.where(F.col("row_idx").between(F.col("header_row"), F.col("max_row")) & F.col("col_idx").between(F.col("min_col"), F.col("max_col")))
    head = at.where((F.col("row_idx") == F.col("header_row")) & grid.filled(F.col("value"))).select(*SHEET, "col_idx", cleaning.column_name(F.col("value"), F.col("col_idx") - F.col("min_col") + 1).alias("name"))
    head = compare.numbered_duplicates(head, "name", ["col_idx"], SHEET).select(*SHEET, "col_idx", F.col("unique_name").alias("column_name"))
    body = at.where("row_idx > header_row").join(head, [*SHEET, "col_idx"]).select(*SHEET, "col_idx", "column_name", (F.col("row_idx") - F.col("header_row")).alias("row_no"), "value")
    if remove_duplicates:
        # rows are alike if all their cells are; the first one stays
        row = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("col_idx", "value")))), 256)
        first = body.groupBy(*SHEET, "row_no").agg(row.alias("h")).groupBy(*SHEET, "h").agg(F.min("row_no").alias("row_no")).drop("h")
        body = body.join(first, [*SHEET, "row_no"], "left_semi").select(*body.columns)
    return body.unionByName(head.select(*SHEET, "col_idx", "column_name", F.lit(0).alias("row_no"), F.lit(None).cast("string").alias("value")))


def _measured(kinds: DataFrame, values: DataFrame, found: DataFrame, how: Settings) -> tuple[DataFrame, DataFrame]:
    """Sheets with their size and completeness, and the profile of their columns; a row that lacks a column's cell lacks its value."""
    counted = values.where("row_no > 0").groupBy(*SHEET).agg(F.count_distinct("row_no").alias("n_rows"))
    named = values.groupBy(*COLUMN).agg(F.min("col_idx").alias("pos"))
    columns = named.join(states.described(found, SHEET, how.infer_types), COLUMN).join(counted, SHEET, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    missing = F.col("n_rows") - F.col("non_null")
    columns = columns.withColumn("n_missing", missing).withColumn("missing_pct", F.round(cleaning.safe_percentage(missing, F.col("n_rows")), 2))
    if not how.infer_types:
        columns = columns.withColumn("data_type", F.lit("text"))
    columns = written(columns)
    per_sheet = columns.groupBy(*SHEET).agg(F.max("n_rows").alias("n_rows"), F.count("*").alias("n_columns"), F.round(F.lit(100.0) - F.avg("missing_pct"), 2).alias("completeness"))
    return kinds.join(per_sheet, SHEET, "left"), columns


def validate_directory(spark: SparkSession, path: str, pattern: str = readers.PATTERN, how: Settings = Settings()) -> Run:
    """A run over the files of a folder; a folder that is not there is a ``FileReadError``, an empty one a run without rows.

    Spark lists no files without a byte, so these have no row.
    """
    return validate_files(readers.folder(spark, path, pattern), how)


def validate_file(spark: SparkSession, path: str, how: Settings = Settings()) -> Run:
    return validate_files(readers.folder(spark, path, "*"), how)


FILES_IN = "path string, modificationTime timestamp, length bigint, content binary"


def validate_new_files(spark: SparkSession, path: str, store: str, pattern: str = readers.PATTERN, how: Settings = Settings()) -> DataFrame:
    """Profiles the files of a folder that are new since the last time, and gives the profile of all so far.

    (column_name, and what ``states.described`` tells), from the states of all files in ``store``. A stream over the folder
    with a checkpoint there takes what is available and ends; each of its batches is a run, whose ``files`` and ``states`` are
    written under the batch's number, so a batch that is repeated after a failure replaces itself. Files that change are not read again.
    """
    def add(files: DataFrame, batch: int) -> None:
        run = validate_files(files, how)
        run.files.write.mode("overwrite").parquet(f"{store}/files/batch={batch}")
        run.states.write.mode("overwrite").parquet(f"{store}/states/batch={batch}")

    found = spark.readStream.format("binaryFile").schema(FILES_IN).option("pathGlobFilter", pattern).load(path)
    found.writeStream.foreachBatch(add).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return states.described(states.merged(stored(spark, store, "states"), []), [])


def stored(spark: SparkSession, store: str, table: str) -> DataFrame:
    """``files`` or ``states`` of all runs in a store; without rows before the first run."""
    if table == "files":
        empty = spark.createDataFrame([], "file_path string, file_name string, status string, n_sheets bigint, n_cells bigint, error string")
    else:
        empty = states.column_states(spark.createDataFrame([], "file_path string, sheet_name string, column_name string, value string"), SHEET)
    try:
        return spark.read.schema(empty.schema).parquet(f"{store}/{table}")
    except AnalysisException:
        return empty.limit(0)


def required(asked: DataFrame, request: str = "request", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What requirements ask for: (request, expected_files), (request, entity) and (request, year). A range of years stands for all of them."""
    found = requirements.template(asked.withColumn("r", terms.requirement(F.col(text))), [request], "r")
    files = asked.select(request).distinct().join(found.where("kind = 'file'").groupBy(request).agg(F.count("*").alias("n")), request, "left")
    named = F.transform(F.regexp_extract_all("value", F.lit(r"(20\d{2})"), 1), lambda y: y.cast("int"))
    years = found.where("kind = 'period'").select(request, named.alias("y")).where(F.size("y") > 0)
    years = years.select(request, F.explode(F.sequence(F.array_min("y"), F.array_max("y"))).alias("year")).distinct()
    return files.select(request, F.coalesce("n", F.lit(0)).alias("expected_files")), found.where("kind = 'entity'").select(request, F.col("value").alias("entity")), years


def verdicts(run: Run, asked: DataFrame, belongs: DataFrame, request: str = "request") -> DataFrame:
    """One row of checks a request, of a run's files against requirements (request, text).

    ``belongs`` has (file_path, request), a row a file. Submitted files are those with a sheet that could be read.
    """
    template, entities, years = required(asked, request)
    sheets = run.sheets.join(belongs, "file_path").select(request, F.col("file_path").alias("file_name"), "structure", "completeness")
    found = run.entities.where("primary_entity is not null").join(belongs, "file_path").select(request, F.col("primary_entity").alias("entity"))
    spans = run.periods.join(belongs, "file_path").select(request, F.explode("fiscal_years").alias("year")).distinct()
    return compare.rule_checks(sheets, template, found, spans, entities, years, request)


def validate_against_requirements(files: DataFrame, asked: DataFrame, belongs: DataFrame, request: str = "request", how: Settings = Settings()) -> tuple[Run, DataFrame]:
    """Files to verdicts: the run, and a row of checks for each request of ``asked`` (request, text)."""
    run = validate_files(files, how)
    return run, verdicts(run, asked, belongs, request)


def records(run: Run) -> DataFrame:
    """(file_path, sheet_name, row_no, record): the rows of all tables of a run, typed, as VARIANT objects."""
    return nested.records(run.values, run.columns)


# Names in a file's result, and the columns that they tell.
IN_FILE = {"file_name": "file_name", "status": "status", "sheets_count": "n_sheets", "cells_count": "n_cells", "error": "error"}
IN_SHEET = {"structure_type": "structure", "confidence": "confidence", "mixed": "mixed"}
IN_TABLE = {"header_row": "header_row", "data_start_row": "data_start_row", "row_count": "n_rows", "column_count": "n_columns", "completeness": "completeness"}
IN_COLUMN = {"position": "pos", "data_type": "data_type", "non_null": "non_null", "missing_values": "n_missing", "missing_percentage": "missing_pct", "distinct_values": "distinct_values", "min": "min_value", "max": "max_value", "mean": "mean_value"}


def results(run: Run) -> DataFrame:
    """(file_path, result): all that a run tells of a file as one VARIANT: the file, its ``sheets`` by name, and of each its structure, for a table its
    ``metadata`` with its ``columns`` by name, and the ``content`` of its keys as deep as it goes.

    A file that failed has its error and no sheets. The rows of tables are not in it, for a table may be of any length: they are ``records``.
    """
    file, sheet = ["file_path"], [F.lit("sheets"), F.col("sheet_name")]
    measured = run.sheets.where("structure = 'structured'")
    parts = [
        nested.told(run.files, file, [], IN_FILE), nested.told(run.sheets, file, sheet, IN_SHEET), nested.told(measured, file, [*sheet, F.lit("metadata")], IN_TABLE),
        nested.told(run.columns, file, [*sheet, F.lit("metadata"), F.lit("columns"), F.col("column_name")], IN_COLUMN),
        nested.key_rows(run.keys.withColumn("sheet_path", F.array(*sheet, F.lit("content"))), file, above=F.col("sheet_path")),
    ]
    return nested.nested(reduce(DataFrame.unionByName, parts), file, 3 + nested.TREE_DEPTH).withColumnRenamed("tree", "result")


def html_report(run: Run) -> DataFrame:
    """(file_path, file_name, html): the report of each file: its sheets with their columns and first rows; a file that failed says why."""
    places = run.columns.select(*COLUMN, F.dense_rank().over(_by_place()).alias("col_no"))
    shown = run.values.where("row_no > 0").join(places, COLUMN)
    preview = reports.preview_rows(shown.select(*SHEET, "row_no", "col_no", "value"), SHEET)
    described = reports.column_rows(run.columns.withColumnRenamed("data_type", "inferred_type"), SHEET)
    parts = described.withColumnRenamed("html", "c").join(preview.withColumnRenamed("html", "p"), SHEET, "left").select(*SHEET, F.concat_ws("", "c", "p").alias("html"))
    sheets = run.files.join(run.sheets.select(*SHEET, "structure"), "file_path").join(parts, SHEET, "left").select("file_path", "file_name", "status", "sheet_name", "structure", "html")
    read = reports.file_report(sheets.drop("html"), sheets.select("file_path", "file_name", "sheet_name", "html"), ["file_path"])
    return read.unionByName(reports.failed_report(run.files.where("n_sheets = 0"), ["file_path"]))


def _by_place():
    from pyspark.sql.window import Window

    return Window.partitionBy(*SHEET).orderBy("pos")


def request_documents(scopes: DataFrame, answers: DataFrame, heads: DataFrame, tracker: DataFrame, doc: str, kind: str = "IRL") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scopes and the answers to them to request lists: texts with their next versions, workbook cells, and sections with their counts.

    ``scopes`` and ``answers`` have (doc, text), ``heads`` what ``reports.request_list`` needs, ``tracker`` (name, version). An answer without any
    request gives the stock requests of its scope's sections. All documents are made in the same few joins.
    """
    sections = written(requests.scope_sections(scopes, doc, "text"))
    told = written(requests.requests(answers, doc, "text"))
    stock = requests.stock_requests(sections, doc).join(told.select(doc).distinct(), doc, "left_anti")
    listed = written(told.unionByName(stock.select(*told.columns)))
    lists = requests.with_headers(listed, sections, doc)
    made = reports.request_list(lists, heads, doc).join(heads.select(doc, "company"), doc)
    saved = reports.versioned(made, tracker, "company", "text", kind)
    sheet = requests.section_sheet(lists, doc)
    return saved, reports.request_cells(sheet, heads, doc), requests.scope_analysis(sections, doc)
