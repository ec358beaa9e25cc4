"""Results as files: JSON, flat summaries, request lists and reports. A document is one row of text, so Spark writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import cleaning
from ledgerlens.operators import compare

# What a report shows of a table, and of a tree of keys.
SHOWN_ROWS, SHOWN_COLUMNS, SHOWN_CHARS, LABEL_CHARS = 5, 10, 1000, 20
RULE = "=" * 50


def as_json(df: DataFrame) -> DataFrame:
    """(value): each row as JSON, nulls left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def result_json(results: DataFrame, result: str = "result") -> DataFrame:
    """(value): nested results as JSON, one line each, names in order; a null stays as null."""
    return results.select(F.to_json(F.col(result)).alias("value"))


def sheet_summary(files: DataFrame, sheets: DataFrame, columns: DataFrame) -> DataFrame:
    """A flat row a sheet: its file, status, the file's number of sheets, structure, errors, rows, and its columns' names in order.

    ``files`` has (file_path, file_name, status), ``sheets`` (file_path, sheet_name, structure, n_errors, n_rows),
    ``columns`` (file_path, sheet_name, pos, column_name). Files without sheets give no row.
    """
    n = sheets.groupBy("file_path").agg(F.count("*").alias("sheets_count"))
    names = columns.groupBy("file_path", "sheet_name").agg(F.array_sort(F.collect_list(F.struct("pos", "column_name"))).alias("c"))
    out = sheets.join(files, "file_path").join(n, "file_path").join(names, ["file_path", "sheet_name"], "left")
    joined = F.array_join(F.transform("c", lambda x: x["column_name"]), ", ")
    return out.select("file_name", "file_path", "status", "sheets_count", "sheet_name", F.col("structure").alias("structure_type"), F.col("n_errors").alias("errors"), F.col("n_rows").alias("row_count"), F.size("c").alias("column_count"), joined.alias("columns"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, doc: str, text: str, path: str) -> None:
    """One text file under a folder for each document, its lines in order: files are partitions by the document's name."""
    df.select(F.col(doc).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def versioned(documents: DataFrame, tracker: DataFrame, company: str, text: str, kind: str) -> DataFrame:
    """(name, version, file_name, text) of documents to save: the version after the tracker's last, in a file-safe name."""
    named = documents.select(cleaning.file_safe(F.col(company)).alias("name"), F.col(text).alias("text"))
    out = compare.next_versions(named, tracker)
    return out.select("name", "version", F.concat("name", F.lit(f"_{kind}_v"), F.col("version").cast("string"), F.lit(".txt")).alias("file_name"), "text")


def extracted_dump(text: Column, method: Column, at: Column) -> Column:
    """A text under a header that says how and when it was taken."""
    return F.format_string("Extracted Text from PDF\nExtraction Method: %s\nExtraction Date: %s\n" + RULE + "\n\n%s", method, F.date_format(at, "yyyy-MM-dd HH:mm:ss"), text)


def request_list(structured: DataFrame, heads: DataFrame, doc: str) -> DataFrame:
    """(doc, text): a request list under its header. ``heads`` has (doc, company, generated, current_year, previous_year, balance_sheet_date)."""
    tag = F.when(F.col("priority") != "", F.concat(F.lit(" (Priority: "), "priority", F.lit(")"))).otherwise("")
    line = F.when(F.col("id") != "", F.concat("id", F.lit(". "), "info_request", tag)).otherwise(F.col("info_request"))
    body = structured.where("info_request <> ''").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    head = F.concat_ws(
        "\n", F.lit("INFORMATION REQUIREMENTS LIST"), F.lit(RULE), F.concat(F.lit("Company: "), "company"), F.concat(F.lit("Generated: "), F.date_format("generated", "MMMM dd, yyyy")), F.lit(""),
        F.concat(F.lit("Historical period: FY"), "current_year", F.lit(", FY"), "previous_year"), F.concat(F.lit("Balance sheet date: "), "balance_sheet_date"), F.lit("Information on consolidated basis wherever applicable"), F.lit(""), F.lit(RULE), F.lit(""),
    )
    lines = F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), "\n")
    return heads.join(body, doc, "left").select(doc, F.concat_ws("\n", head, F.coalesce(lines, F.lit(""))).alias("text"))


# The first rows of a sheet of requests, and its columns.
SHEET_TITLE, SHEET_NOTE, SHEET_COLUMNS, FIRST_ROW = "INFORMATION REQUIREMENTS LIST", "Information on consolidated basis wherever applicable", ["S.No.", "Section", "Information Requirement", "Priority", "Comments"], 8


def request_cells(sheet: DataFrame, heads: DataFrame, doc: str) -> DataFrame:
    """Cells of a workbook of requests for each document: its head in rows 1 to 7, column names in row 9, a row a section below."""
    after = lambda label, *names: F.concat(F.lit(label), F.concat_ws(", ", *names))
    top = [
        (0, F.lit(SHEET_TITLE)), (1, after("Company: ", "company")), (2, F.concat(F.lit("Generated: "), F.date_format("generated", "MMMM dd, yyyy"))),
        (4, after("Historical period: ", "previous_year", "current_year")), (5, after("Balance sheet date: ", "balance_sheet_date")), (6, F.lit(SHEET_NOTE)),
    ]
    cell = lambda r, c, v, t="text": F.struct(F.lit(r).cast("int").alias("row_idx") if isinstance(r, int) else r.cast("int").alias("row_idx"), F.lit(c).alias("col_idx"), v.cast("string").alias("value"), F.lit(t).alias("vtype"))
    head = heads.select(doc, F.explode(F.array(*[cell(r, 0, v) for r, v in top], *[cell(FIRST_ROW, k, F.lit(c)) for k, c in enumerate(SHEET_COLUMNS)])).alias("x"))
    at = F.col("item") + FIRST_ROW
    body = sheet.select(doc, F.explode(F.array(cell(at, 0, F.col("item"), "number"), cell(at, 1, F.col("section")), cell(at, 2, F.col("requirement")), cell(at, 3, F.col("priority")))).alias("x"))
    every = head.unionByName(body)
    return every.select(F.col(doc).cast("string").alias("file_path"), F.lit("Information Requirements List").alias("sheet_name"), "x.*")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(tag: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *inner, F.lit(f"</{tag.split()[0]}>"))


def shortened(text: Column, chars: int = SHOWN_CHARS) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def column_rows(profile: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html): the table of a sheet's columns, in the order of ``pos``."""
    row = _element("tr", *[_element("td", _escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in ("column_name", "inferred_type", "missing_pct")])
    g = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))).alias("r"))
    return g.select(*keys, _element("table", F.lit("<tr><th>Column</th><th>Type</th><th>Missing</th></tr>"), F.array_join(F.transform("r", lambda x: x["row"]), "")).alias("html"))


def preview_rows(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html): the first rows and columns of a table, from (row_no, col_no, value) cells: a bounded number of them a table."""
    shown = values.where((F.col("row_no") <= SHOWN_ROWS) & (F.col("col_no") <= SHOWN_COLUMNS))
    rows = shown.groupBy(*keys, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", _element("td", _escaped(F.coalesce("value", F.lit("")))).alias("c")))).alias("c"))
    row = _element("tr", F.array_join(F.transform("c", lambda x: x["c"]), ""))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_no", row.alias("row")))).alias("r"))
    return g.select(*keys, _element("table", F.array_join(F.transform("r", lambda x: x["row"]), "")).alias("html"))


def file_report(sheets: DataFrame, parts: DataFrame | None = None, keys: list[str] = []) -> DataFrame:
    """(keys, file_name, html): a report of each file, from (keys, file_name, status, sheet_name, structure) rows and, by sheet, parts that are HTML
    already. ``keys`` tell files of one name apart."""
    rows = sheets if parts is None else sheets.join(parts, [*keys, "file_name", "sheet_name"], "left")
    inner = F.coalesce("html", F.lit("")) if parts is not None else F.lit("")
    one = _element("div class='sheet'", _element("h4", F.lit("Sheet: "), _escaped(F.col("sheet_name"))), _element("p", F.lit("Structure Type: "), F.col("structure")), inner)
    g = rows.groupBy(*keys, "file_name", "status").agg(F.array_sort(F.collect_list(F.struct("sheet_name", one.alias("h")))).alias("s"))
    head = _element("h3", _escaped(F.col("file_name")), F.lit(" - "), F.upper("status"))
    return g.select(*keys, "file_name", _element("div class='file'", head, F.array_join(F.transform("s", lambda x: x["h"]), "")).alias("html"))


def failed_report(files: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, file_name, html): the report of each file without a sheet, from (keys, file_name, status, error) rows."""
    head = _element("h3", _escaped(F.col("file_name")), F.lit(" - "), F.upper("status"))
    return files.select(*keys, "file_name", _element("div class='file'", head, F.when(F.col("error").isNull(), "").otherwise(_element("p", _escaped(F.col("error"))))).alias("html"))


def whole_report(summary: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """(group, html): one page for each group of files: the figures of its run, then its files by name. ``files`` has (group, file_name, html).

    A page is a document, so the files of a group have to fit in a row.
    """
    body = files.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("file_name", "html"))).alias("f"))
    page = _element("body", _element("h1", F.lit("Validation Report")), F.col("s"), F.array_join(F.transform(F.coalesce("f", F.array().cast("array<struct<file_name:string,html:string>>")), lambda x: x["html"]), ""))
    both = summary_report(summary, group).withColumnRenamed("html", "s").join(body, group, "left")
    return both.select(group, _element("html", page).alias("html"))


def summary_report(summary: DataFrame, group: str) -> DataFrame:
    """(group, html): the figures of a run as a table."""
    names = [c for c in summary.columns if c != group]
    rows = [_element("tr", _element("td", F.lit(c)), _element("td", F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in names]
    return summary.select(group, _element("table", *rows).alias("html"))


def verdict_report(checks: DataFrame, group: str) -> DataFrame:
    """(group, html): the checks of a validation, a line each; what fails is marked."""
    good = ["SUFFICIENT", "FULL", "CONSISTENT", "HIGH"]
    names = [c for c in checks.columns if c != group]
    rows = []
    for c in names:
        value = F.coalesce(F.col(c).cast("string"), F.lit(""))
        mark = F.when(value.isin("INSUFFICIENT", "MISSING", "MIXED", "LOW", "PARTIAL", "MEDIUM"), " class='error'").when(value.isin(good), " class='success'").otherwise("")
        rows.append(F.concat(F.lit("<li"), mark, F.lit(f">{c}: "), _escaped(value), F.lit("</li>")))
    return checks.select(group, _element("ul", *rows).alias("html"))


def status_share(files: DataFrame, group: str) -> DataFrame:
    """(group, label, n): the data of a chart of files that went well and of others."""
    label = F.when(F.col("status") == "success", "Successful").otherwise("Failed")
    return files.groupBy(group, label.alias("label")).agg(F.count("*").alias("n"))


def status_bars(files: DataFrame) -> DataFrame:
    """(label, ok): the data of a chart with a bar a file, names cut short."""
    return files.select(shortened(F.col("file_name"), LABEL_CHARS).alias("label"), (F.col("status") == "success").cast("int").alias("ok"))


def user_export(files: DataFrame) -> DataFrame:
    return files.select(F.col("file_name").alias("File"), F.col("status").alias("Status"), F.coalesce("error", F.lit("")).alias("Error"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"))
