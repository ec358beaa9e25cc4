"""Queries of files written and read by Spark's own and this library's formats, and DuckDB SQL for the same rows."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import scope
from ledgerlens.operators import requests
from ledgerlens.plans import old_books
from ledgerlens.plans.folders import scratch
from ledgerlens.plans.registry import query, table
from ledgerlens.plans.sheets import CELL_SQL, _cells, _request_heads, _request_rows
from ledgerlens.sinks import committed, reports
from ledgerlens.sinks import workbooks as book_sink
from ledgerlens.sources import readers, texts, workbooks, xlsx


def _local(spark: SparkSession) -> str:
    """A scratch folder by an address that Arrow's file systems know, too."""
    path = scratch(spark)
    return path if ":" in path else f"file://{path}"


@query("SELECT 'line ' || n_nationkey || ' of ' || n_name AS value FROM nation UNION ALL SELECT 'end of ' || r_name FROM region")
def src_raw_lines(spark, sf_dir):
    path = f"{scratch(spark)}/lines"
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("  line "), F.col("n_nationkey").cast("string"), F.lit(" of "), "n_name", F.lit("\t ")).alias("value"))
    lines.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("end of "), "r_name").alias("value"))).repartition(3).write.text(path)
    return texts.raw_lines(spark, path).select(F.btrim("value", F.lit(" \t")).alias("value"))


@query("SELECT r_name AS name, 'scope of ' || r_name || chr(10) || 'number ' || r_regionkey AS text FROM region")
def src_whole_texts(spark, sf_dir):
    path = f"{scratch(spark)}/texts"
    docs = table(spark, sf_dir, "region").select("r_name", F.concat(F.lit("scope of "), "r_name", F.lit("\nnumber "), F.col("r_regionkey").cast("string")).alias("text"))
    reports.write_documents(docs, "r_name", "text", path)
    found = texts.whole_texts(spark, path)
    return found.select(F.replace(F.regexp_extract("file_path", r"name=([^/]*)/", 1), F.lit("%20"), F.lit(" ")).alias("name"), F.regexp_replace("text", r"\n$", "").alias("text"))


@query(CELL_SQL + " SELECT file_path, sheet_name, row_idx, col_idx, value FROM cells WHERE col_idx BETWEEN 1 AND 2")
def src_column_range(spark, sf_dir):
    made = book_sink.workbooks(_cells(spark, sf_dir))
    return workbooks.column_range(workbooks.workbook_cells(made), 1, 2).drop("vtype")


@query("""
SELECT c_custkey % 7 AS k, unnest(['Revenue', 'Debt ' || (c_custkey % 5)]) AS category, unnest(['Sales of ' || c_name, 'Loans of ' || c_mktsegment]) AS text FROM customer WHERE c_custkey % 3 <> 0""")
def req_requirement_map(spark, sf_dir):
    k = F.col("c_custkey")
    told = F.when(k % 3 != 0, F.to_json(F.create_map(F.lit("Revenue"), F.concat(F.lit("Sales of "), "c_name"), F.concat(F.lit("Debt "), (k % 5).cast("string")), F.concat(F.lit("Loans of "), "c_mktsegment")))).when(k % 2 == 0, "not json")
    maps = table(spark, sf_dir, "customer").select((k % 7).alias("k"), told.alias("j"))
    return texts.requirements(maps, "j", ["k"])


@query("""
WITH n AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size < 4 GROUP BY 1)
SELECT p_brand AS name, n::INT AS version, (SELECT count(*) FROM part WHERE p_size < 4)::BIGINT AS n_files FROM n""")
def snk_committed_versions(spark, sf_dir):
    path = _local(spark) + "/documents"
    small = table(spark, sf_dir, "part").where("p_size < 4")
    docs = small.select(F.col("p_brand").alias("name"), F.concat("p_name", F.lit("\n"), "p_type").alias("content"), "p_size")
    # two runs: the second goes on from the numbers that the first has stored
    committed.save(docs.where("p_size = 1").drop("p_size"), path, "PART")
    committed.save(docs.where("p_size > 1").drop("p_size"), path, "PART")
    files = readers.folder(spark, path, "*_PART_v*.txt").agg(F.count("*").alias("n_files"))
    return committed.tracker(spark, path).join(F.broadcast(files)).select("name", "version", "n_files")


@query(CELL_SQL + " SELECT file_path, sheet_name, row_idx, col_idx, value, vtype FROM cells WHERE sheet_name = 't' AND row_idx >= 3 AND col_idx <> 2")
def src_xlsx_format(spark, sf_dir):
    path = _local(spark) + "/books"
    made = book_sink.workbooks(_cells(spark, sf_dir)).select(F.col("path").alias("name"), "content")
    committed.save(made, path, "BOOK", "xlsx")
    xlsx.register(spark)
    found = spark.read.format("xlsx").load(path).where("sheet_name = 't' and row_idx >= 3 and col_idx <> 2")
    return found.withColumn("file_path", F.replace(F.regexp_extract("file_path", r"/([^/]*)_BOOK_v1\.xlsx$", 1), F.lit("%20"), F.lit(" ")))


@query("""
SELECT source || '-' || lang || '.xlsx' AS "File", CASE WHEN n > 3 THEN 'success' ELSE 'error' END AS "Status", CASE WHEN n > 3 THEN '' ELSE 'only ' || n END AS "Error", strftime(timestamp '2024-03-05 00:00:00' + to_hours(n::INT % 24), '%Y-%m-%d %H:%M:%S') AS "Timestamp"
FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)""")
def snk_user_export(spark, sf_dir):
    n = F.col("n")
    files = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).select(
        F.concat("source", F.lit("-"), "lang", F.lit(".xlsx")).alias("file_name"), F.when(n > 3, "success").otherwise("error").alias("status"), F.when(n <= 3, F.concat(F.lit("only "), n.cast("string"))).alias("error"),
        (F.lit("2024-03-05 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(n % 24).cast("int"))).alias("at"))
    return reports.user_export(files)


@query("""
SELECT c_custkey::VARCHAR AS file_path, '1' AS id, 'TAX' AS section, '(a) Filings of ' || c_name || chr(10) || '(b) Audits' AS requirement, 'Low' AS priority, 1 AS row_no FROM customer""")
def src_request_workbook(spark, sf_dir):
    sheet = requests.section_sheet(_request_rows(spark, sf_dir), "c_custkey")
    made = book_sink.workbooks(reports.request_cells(sheet, _request_heads(spark, sf_dir), "c_custkey"))
    # the header is in row 9 of such a workbook
    return texts.requirement_rows(texts.request_values(workbooks.workbook_cells(made)), ["file_path"])


NAMED = "CASE {k} % 6 WHEN 0 THEN 'Quality of Earnings ' || {n} WHEN 1 THEN 'Employee cost and DEBT' WHEN 2 THEN 'General matters of ' || {n} WHEN 3 THEN 'Cash and receivables' WHEN 4 THEN 'Revenue, profit and inventory' ELSE {n} END"


@query(f"""
WITH s AS (SELECT p_partkey, lower({NAMED.format(k='p_partkey', n='p_name')}) AS x FROM part),
h AS (SELECT p_partkey, regexp_matches(x, 'financial statements|earnings|income statement|revenue|general') AS a, regexp_matches(x, 'profit|loss|revenue|cost|expense|employee|working capital') AS b, regexp_matches(x, 'balance sheet|assets|liabilities|cash|receivables|inventory|debt') AS c FROM s)
SELECT p_partkey, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END) AS parts FROM h""")
def prj_relevant_parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scope.relevant_parts(F.expr(NAMED.format(k="p_partkey", n="p_name"))), "").alias("parts"))


# ---- workbooks of the old format, of a thousand customers each

@query("""
SELECT 'book ' || (c_custkey // 1000) || '.xls' AS file_path, 'Clients' AS sheet_name, (c_custkey % 1000)::INT AS row_idx, c_name AS name, c_mktsegment AS segment, c_acctbal::DOUBLE AS balance, CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END AS owes,
       strftime(DATE '2020-01-01' + (c_custkey % 1000)::INT, '%Y-%m-%dT00:00:00') AS since, 'text,text,number,boolean,date' AS kinds FROM customer""")
def src_old_workbooks(spark, sf_dir):
    def book(key, rows):
        cells = []
        for r in rows.itertuples():
            row = r.c_custkey % 1000
            values = [r.c_name, r.c_mktsegment, float(r.c_acctbal), bool(r.c_acctbal < 0), datetime.date(2020, 1, 1) + datetime.timedelta(days=row)]
            cells += [(row, c, v) for c, v in enumerate(values)]
        return pd.DataFrame([(f"book {key[0]}.xls", old_books.old_book({"Clients": cells, "Notes": []}))], columns=["path", "content"])

    numbered = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.expr("c_custkey div 1000").alias("part"))
    cells = readers.cells(numbered.groupBy("part").applyInPandas(book, "path string, content binary"))
    at = lambda c: F.max(F.when(F.col("col_idx") == c, F.col("value")))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "vtype"))), lambda x: x["vtype"]), ",")
    return cells.groupBy("file_path", "sheet_name", "row_idx").agg(
        at(0).alias("name"), at(1).alias("segment"), at(2).cast("double").alias("balance"), at(3).alias("owes"), at(4).alias("since"), kinds.alias("kinds"))
