"""Text sources: whole files, separated values of an unknown delimiter, requirement maps, version trackers, joined documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.sources import separated as separated_files
from ledgerlens.store import dealt, written

def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, text), a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed column, for files that no delimiter splits."""
    return spark.read.text(path).select(F.trim("value").alias("value"))


def delimiters(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, sep) of each file that is not empty: the first delimiter that splits its first record; null where none does."""
    return separated_files.file_facts(spark, path).select("file_path", "sep")


def encoding_of(content: Column) -> Column:
    """By the mark at a file's start, else UTF-8 if its bytes are valid, else ``windows-1252``."""
    head = F.hex(F.substring(content, 1, 3))
    valid = F.try_validate_utf8(content.cast("string")).isNotNull()
    return F.when(F.startswith(head, F.lit("EFBBBF")), "utf-8-sig").when(F.startswith(head, F.lit("FFFE")), "utf-16le").when(F.startswith(head, F.lit("FEFF")), "utf-16be").when(valid, "utf-8").otherwise("windows-1252")


def encodings(files: DataFrame) -> DataFrame:
    """(path, encoding) of (path, content) files."""
    return files.select("path", encoding_of(F.col("content")).alias("encoding"))


def separated(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Separated values as a table of text, bad records left out; each file of the folder has its own delimiter and encoding."""
    return separated_files.table(spark, path, header)


def as_cells(df: DataFrame, file_path: str, sheet: str = "Sheet1") -> DataFrame:
    """A table of text as cells, its header in row 0. Rows are numbered in the order of their partitions.

    The rows are written with their partition and place first, and counted and numbered as they were written.
    """
    names = df.sparkSession.createDataFrame([(0, k, c) for k, c in enumerate(df.columns)], "row_idx int, col_idx int, value string")
    place = F.monotonically_increasing_id()
    rows = written(df.select(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]).cast("array<string>").alias("v"), F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a partition
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    body = rows.join(F.broadcast(starts), "part").select((F.col("before") + F.col("at") + 1).cast("int").alias("row_idx"), F.posexplode("v").alias("col_idx", "value"))
    kind = F.when(F.col("value").try_cast("double").isNotNull(), "number").otherwise("text")
    return names.unionByName(body).where("value is not null").select(F.lit(file_path).alias("file_path"), F.lit(sheet).alias("sheet_name"), "row_idx", "col_idx", "value", kind.alias("vtype"))


# Pages that are looked at, and characters a page under which a document was scanned.
SCANNED_PAGES, SCANNED = 3, 100
# Names that the columns of a request list go by, in the order in which they are tried.
ALIASES = {
    "requirement": ["Information Requirement", "Info Requirement", "Requirement", "Description"], "section": ["Section", "Category", "Area"],
    "id": ["S.No."], "priority": ["Priority"],
}
DEFAULT_PRIORITY = "Medium"


def request_values(cells: DataFrame) -> DataFrame:
    """(file_path, sheet_name, row_no, column, value): cells of request lists under their columns' names, rows numbered from the header.

    The header is the first row of a sheet that has one of the names that requirements go by, wherever it is; sheets
    without such a row give nothing.
    """
    sheet, name = ["file_path", "sheet_name"], F.trim("value")
    # cells are made once and move once; both windows run along rows
    at = cells.where("file_path is not null and sheet_name is not null and row_idx is not null and col_idx is not null")
    at = dealt(at.select(*sheet, "row_idx", "col_idx", "value"), *sheet)
    at = at.withColumn("head", F.min(F.when(name.isin(ALIASES["requirement"]), F.col("row_idx"))).over(Window.partitionBy(*sheet).orderBy("row_idx"))).where("head is not null")
    down = Window.partitionBy(*sheet, "col_idx").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("named", F.first(F.when(F.col("row_idx") == F.col("head"), F.struct(name.alias("column"))), ignorenulls=True).over(down))
    return at.where("row_idx > head and named is not null").select(*sheet, (F.col("row_idx") - F.col("head")).alias("row_no"), "named.column", "value")


def requirement_rows(values: DataFrame, keys: list[str], row: str = "row_no", column: str = "column", value: str = "value") -> DataFrame:
    """(keys, id, section, requirement, priority) of a request list's cells (a row a cell, under its column's name).

    Of each field the first of its columns that has a value counts. Rows without a requirement go; a missing
    number is the row's place, a missing priority is Medium.
    """
    def field(name: str) -> Column:
        return F.coalesce(*[F.max(F.when((F.col(column) == c) & (F.trim(F.col(value)) != ""), F.col(value))) for c in ALIASES[name]])

    # an aggregate of texts sorts its rows, so they are dealt before it
    g = dealt(values.select(*keys, row, column, value), *keys, row).groupBy(*keys, row).agg(*[field(n).alias(n) for n in ALIASES])
    return g.where("requirement is not null").select(
        *keys, F.coalesce("id", F.col(row).cast("string")).alias("id"), F.coalesce("section", F.lit("")).alias("section"), "requirement", F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("priority"), row,
    )


def ordered_sections(rows: DataFrame, keys: list[str], row: str = "row_no") -> DataFrame:
    """(keys, section, place): the different sections of request lists in the order in which they first come."""
    first = rows.where("section <> ''").groupBy(*keys, "section").agg(F.min(row).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first", "section"))).drop("first")


def requirements(df: DataFrame, json_col: str, keys: list[str] = []) -> DataFrame:
    """(keys, category, text) of JSON maps; what is no map gives no rows."""
    return df.select(*keys, F.explode(F.from_json(F.col(f"`{json_col}`"), "map<string,string>")).alias("category", "text"))


def tracked_versions(df: DataFrame, json_col: str) -> DataFrame:
    """(name, version) of a version tracker; missing or broken JSON counts as an empty tracker."""
    return df.select(F.explode(F.from_json(F.col(f"`{json_col}`"), "map<string,int>", {"mode": "PERMISSIVE"})).alias("name", "version"))


def file_version(path: Column, suffix: str = "xlsx") -> Column:
    """The number in ``…_v<number>.<suffix>``; 0 where there is none."""
    found = F.regexp_extract(path, rf"_v(\d+)\.{suffix}$", 1)
    return F.coalesce(found.try_cast("int"), F.lit(0))


def latest_file(files: DataFrame, name_col: str, path_col: str = "path", suffix: str = "xlsx") -> DataFrame:
    """Of each name the path with the highest version; of ties the last path."""
    best = F.max_by(path_col, F.struct(file_version(F.col(path_col), suffix), F.col(path_col)))
    return files.groupBy(name_col).agg(best.alias(path_col), F.max(file_version(F.col(path_col), suffix)).alias("version"))


def consolidated(documents: DataFrame, group: str, name: str, text: str, order: str) -> DataFrame:
    """(group, text): the documents of a group in order, each under a line that names it. A group has to fit in a row."""
    part = F.concat(F.lit("\n--- Document: "), F.col(name), F.lit(" ---\n"), F.coalesce(F.col(text), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), part.alias("part"))))
    return documents.groupBy(group).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("text"))


def page_texts(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, text, page_count, character_count, scanned) of the pages of documents: texts under page lines, in order.

    ``scanned`` says that the first three pages have under SCANNED characters each on average, so
    that their text has to be recognised first. Pages without text add no line.
    """
    filled = F.when(F.trim(F.col(text)) != "", F.concat(F.lit("\n--- Page "), F.col(page).cast("string"), F.lit(" ---\n"), F.col(text)))
    g = pages.groupBy(doc).agg(
        F.array_sort(F.collect_list(F.struct(F.col(page), filled.alias("t")))).alias("p"), F.count("*").alias("page_count"),
        F.avg(F.when(F.col(page) <= SCANNED_PAGES, F.length(F.trim(F.coalesce(F.col(text), F.lit("")))))).alias("mean"),
    )
    whole = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return g.select(doc, whole.alias("text"), "page_count", F.length(whole).alias("character_count"), (F.coalesce("mean", F.lit(0.0)) < SCANNED).alias("scanned"))
