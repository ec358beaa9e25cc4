"""Whole runs: a broken file among good ones, settings, verdicts, reports, and request lists from scopes."""

import pytest

from ledgerlens import runs
from ledgerlens.errors import ConfigurationError, FileReadError, ValidationError
from ledgerlens.sinks import reports
from ledgerlens.sinks import workbooks as sink

CELLS = "file_path string, sheet_name string, row_idx int, col_idx int, value string, vtype string"
TABLE = [["Company", "Revenue", "Booking Date", "Revenue", "Empty"], ["Alpha Holdings Ltd", 10, "05/03/2021", 1.5], ["Alpha Holdings Ltd", 20, "06/03/2022", "N/A"], ["Beta Bank", None, "07/03/2022", 2.5], ["Beta Bank", None, "07/03/2022", 2.5]]


def _files(spark):
    kind = lambda v: "number" if isinstance(v, (int, float)) else "text"
    cells = [("a.xlsx", "t", r + 1, c, str(v), kind(v)) for r, row in enumerate(TABLE) for c, v in enumerate(row) if v is not None]
    cells += [("a.xlsx", "k", 0, 0, "Name:", "text"), ("a.xlsx", "k", 1, 0, "Alpha", "text"), ("a.xlsx", "k", 2, 0, "Id: 7", "text"), ("a.xlsx", "k", 3, 0, "words", "text"), ("lone.xlsx", "s", 3, 3, "word", "text")]
    books = [tuple(r) for r in sink.workbooks(spark.createDataFrame(cells, CELLS)).collect()]
    plain = [("p/b.csv", 'Key,Note\n1,"two\nlines"\n2,x\n3,4,5\n'.encode()), ("broken.xlsx", b"PK\x03\x04\xff\x00"), ("old.xls", b"\xd0\xcf"), ("none.xlsx", None), ("empty.csv", b"")]
    return spark.createDataFrame(books + plain, "path string, content binary")


@pytest.fixture(scope="module")
def run(spark):
    return runs.validate_files(_files(spark))


def test_files_that_fail_are_rows(run):
    got = {r.file_name: (r.status, r.n_sheets, r.error is not None) for r in run.files.collect()}
    assert got == {
        "a.xlsx": ("success", 2, False), "lone.xlsx": ("success", 1, False), "b.csv": ("success", 1, False), "broken.xlsx": ("error", 0, True), "old.xls": ("error", 0, True),
        "none.xlsx": ("error", 0, True), "empty.csv": ("success", 0, False),
    }
    assert run.summary == {"total_files": 7, "successful": 4, "failed": 3, "sheets_processed": 4, "structured": 2, "unstructured": 1, "unknown": 1}


def test_columns_and_keys(run):
    got = {r.column_name: r for r in run.columns.collect() if r.file_path == "a.xlsx"}
    assert {k: (r.data_type, r.non_null, r.n_rows, r.missing_pct) for k, r in got.items()} == {
        "Company": ("categorical", 4, 4, 0.0) if got["Company"].data_type == "categorical" else ("text", 4, 4, 0.0), "Revenue": ("integer", 2, 4, 50.0), "Booking_Date": ("date", 4, 4, 0.0),
        "Revenue_1": ("float", 3, 4, 25.0), "Empty": ("unknown", 0, 4, 100.0),
    }
    sheet = next(r for r in run.sheets.collect() if r.sheet_name == "t")
    assert (sheet.structure, sheet.n_rows, sheet.n_columns, sheet.completeness) == ("structured", 4, 5, 65.0)
    assert {(r.key, r.value) for r in run.keys.collect() if r.sheet_name == "k"} >= {("Name", None), ("Id", "7")}
    note = {r.row_no: r.value for r in run.values.collect() if r.column_name == "Note" and r.row_no > 0}
    assert note == {1: "two\nlines", 2: "x"}


def test_verdicts(spark, run):
    asked = spark.createDataFrame([("one", "a) Revenue book for 2021 to 2022, b) Key sheet"), ("two", "a) Notes of the company 2030"), ("idle", None)], "request string, text string")
    belongs = spark.createDataFrame([("a.xlsx", "one"), ("broken.xlsx", "one"), ("p/b.csv", "two")], "file_path string, request string")
    got = {r.request: r for r in runs.verdicts(run, asked, belongs).collect()}
    assert (got["one"].submitted, got["one"].expected, got["one"].file_status, got["one"].year_coverage, got["one"].consistency) == (1, 2, "INSUFFICIENT", "FULL", "MIXED")
    assert (got["two"].submitted, got["two"].file_status, got["two"].year_coverage, got["two"].entity_coverage) == (1, "SUFFICIENT", "MISSING", 0.0)
    assert (got["idle"].submitted, got["idle"].expected, got["idle"].completeness_level) == (0, 0, "LOW")


def test_reports(spark, run):
    html = {r.file_path: r.html for r in runs.html_report(run).collect()}
    assert "<td>Booking_Date</td><td>date</td>" in html["a.xlsx"] and "Sheet: k" in html["a.xlsx"] and "BadZipFile" in html["broken.xlsx"] and "<td>two\nlines</td>" in html["p/b.csv"]
    pages = runs.html_report(run).selectExpr("'g' AS g", "file_path", "file_name", "html")
    summary = spark.createDataFrame([("g", run.summary["total_files"]), ("h", 0)], "g string, total_files long")
    whole = {r.g: r.html for r in reports.whole_report(summary, pages, "g").collect()}
    assert whole["g"].count("class='file'") == 7 and "<td>total_files</td><td>7</td>" in whole["g"] and whole["h"].startswith("<html><body>")


def test_settings(spark):
    assert runs.settings("unstructured", scan_rows=7) == runs.Settings(7, 20, 0.5, False, False)
    for wrong in ({"profile": "quick"}, {"scan_rows": 0}, {"header_score": 2}, {"depth": 1}):
        with pytest.raises(ConfigurationError):
            runs.settings(**wrong)
    once = runs.validate_files(_files(spark), runs.settings("thorough"))
    assert next(r.n_rows for r in once.sheets.collect() if r.sheet_name == "t") == 3
    # a header that scores less than is asked for is no header
    strict = runs.validate_files(_files(spark), runs.settings(header_score=1.0))
    assert strict.summary["structured"] == 0


def test_folders(spark, tmp_path):
    with pytest.raises(FileReadError) as e:
        runs.validate_directory(spark, str(tmp_path / "gone"))
    assert isinstance(e.value, ValidationError)
    empty = runs.validate_directory(spark, str(tmp_path))
    assert empty.files.count() == 0 and set(empty.summary.values()) == {0}
    (tmp_path / "x.csv").write_text("Name,Amount\nFirst,1\nSecond,2\n")
    one = runs.validate_file(spark, str(tmp_path / "x.csv"))
    assert [r.status for r in one.files.collect()] == ["success"] and one.columns.count() == 2


def test_request_documents(spark):
    table = "| Analysis Area | Detailed Procedures |\n|---|---|\n| **Quality of Earnings** | 1. Test revenue<br>2. Read contracts |\n| **Tax Matters** | 1. List filings |\n\n" + "x" * 200
    scopes = spark.createDataFrame([(1, table), (2, table)], "scope_id long, text string")
    answers = spark.createDataFrame([(1, "1. (a) Revenue by month\n(b) Contracts (Priority: High)\n2. (a) Filings (Priority: Low)"), (2, "nothing that is numbered")], "scope_id long, text string")
    heads = spark.sql("SELECT scope_id, concat('Co ', scope_id) AS company, date'2024-03-05' AS generated, '2023-24' AS current_year, '2022-23' AS previous_year, 'March 31, 2024' AS balance_sheet_date FROM VALUES (1L), (2L) AS t(scope_id)")
    tracker = spark.createDataFrame([("Co_1", 4)], "name string, version int")
    saved, cells, analysed = runs.request_documents(scopes, answers, heads, tracker, "scope_id")
    got = {r.name: r for r in saved.collect()}
    assert got["Co_1"].file_name == "Co_1_IRL_v5.txt" and "Revenue by month" in got["Co_1"].text and got["Co_2"].version == 1 and "Quality of Earnings".lower() in got["Co_2"].text.lower()
    assert {r.file_path for r in cells.collect()} == {"1", "2"} and {r.total_areas for r in analysed.collect()} == {2}


def test_only_new_files_are_profiled(spark, tmp_path):
    (tmp_path / "in").mkdir()
    into, store = tmp_path / "in", str(tmp_path / "store")
    assert runs.validate_new_files(spark, str(into), store, "*.csv").collect() == [] and runs.stored(spark, store, "files").count() == 0
    (into / "a.csv").write_text("Name,Amount\nFirst,1\nSecond,2\n")
    one = {r.column_name: r.non_null for r in runs.validate_new_files(spark, str(into), store, "*.csv").collect()}
    assert one["Amount"] == 2
    (into / "b.csv").write_text("Name,Amount\nThird,5\nFourth,6\nFifth,7\n")
    (into / "c.csv").write_bytes(b"")
    both = {r.column_name: r for r in runs.validate_new_files(spark, str(into), store, "*.csv").collect()}
    assert (both["Amount"].non_null, both["Amount"].max_value, both["Amount"].mean_value) == (5, 7.0, 4.2)
    # nothing new: nothing is read
    again = runs.validate_new_files(spark, str(into), store, "*.csv")
    assert {r.column_name: r.non_null for r in again.collect()}["Amount"] == 5
    files = runs.stored(spark, store, "files").collect()
    # Spark lists no file without a byte
    assert sorted(r.file_name for r in files) == ["a.csv", "b.csv"]


def test_results_by_path(run):
    got = {r.file_path: r.result.toPython() for r in runs.results(run).collect()}
    assert len(got) == 7 and got["broken.xlsx"]["status"] == "error" and "sheets" not in got["broken.xlsx"] and got["broken.xlsx"]["error"]
    book = got["a.xlsx"]
    assert (book["sheets_count"], book["error"], book["sheets"]["t"]["structure_type"], book["sheets"]["t"]["metadata"]["row_count"]) == (2, None, "structured", 4)
    column = book["sheets"]["t"]["metadata"]["columns"]["Revenue_1"]
    assert (column["data_type"], column["missing_values"], column["max"]) == ("float", 1, 2.5) and "metadata" not in book["sheets"]["k"]
    assert book["sheets"]["k"]["content"]["Region_1"]["Id"] == "7" and got["lone.xlsx"]["sheets"]["s"]["content"] == {"_content": ["word"]}
    rows = {r.row_no: r.record.toPython() for r in runs.records(run).collect() if r.file_path == "a.xlsx"}
    assert rows[1]["Revenue"] == 10 and rows[1]["Revenue_1"] == 1.5 and rows[2]["Revenue_1"] is None and "Revenue" not in rows[3]
