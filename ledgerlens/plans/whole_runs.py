"""Queries of whole runs: files of a region to verdicts, profiles merged over files, request lists from scopes, and DuckDB SQL for the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import runs
from ledgerlens.operators import states
from ledgerlens.plans.registry import query, table
from ledgerlens.plans.sheets import _cells
from ledgerlens.sinks import reports
from ledgerlens.sinks import workbooks as book_sink

# ---- three files a region: a workbook with a table of its nations and a sheet of keys, a text file of its orders by month with quoted line ends, and a broken workbook

BOOKED_SQL = """
WITH booked AS (
  SELECT r_name, r_regionkey, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
"""


def _booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy("r_name", "r_regionkey", F.trunc("o_orderdate", "month").alias("m")).agg(F.count("*").alias("n"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content); a month's amount is missing where its number of orders is odd."""
    books = book_sink.workbooks(_cells(spark, sf_dir)).select(F.concat("path", F.lit("/book.xlsx")).alias("path"), "content")
    line = F.concat(F.date_format("m", "yyyy-MM-dd"), F.lit(';"up to\n'), F.date_format(F.last_day("m"), "yyyy-MM-dd"), F.lit('";'), F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).otherwise("N/A"), F.lit("\n"))
    lines = F.array_join(F.array_sort(F.collect_list(line)), "")
    plain = _booked(spark, sf_dir).groupBy("r_name").agg(F.encode(F.concat(F.lit("Booking Date;Booking Note;Amount\n"), lines), "UTF-8").alias("content"))
    broken = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit("/broken.xlsx")).alias("path"), F.expr("X'504B0304FF'").alias("content"))
    return reduce(DataFrame.unionByName, [books, plain.select(F.concat("r_name", F.lit("/orders.csv")).alias("path"), "content"), broken])


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each region is asked for: three files, a company for even numbers, and years from 2000 on that grow with the number."""
    k = F.col("r_regionkey")
    text = F.concat(F.lit("a) Listing of "), "r_name", F.lit(", b) Monthly orders\n"), F.when(k % 2 == 0, "for the company ").otherwise(""), F.lit("c) Key sheet for 2000 to "), (2000 + k).cast("string"))
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("request"), text.alias("text"))


def _belongs(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file_path"), F.split("path", "/")[0].alias("request"))


@query(BOOKED_SQL + """,
s AS (SELECT r_name, r_regionkey, round(100.0::DOUBLE * count(*) FILTER (WHERE n % 2 = 1) / count(*), 2) AS missing, min(year(m)) AS y0, max(year(m)) AS y1 FROM booked GROUP BY ALL),
c AS (SELECT *, round(100.0 - missing / 3, 2) AS filled FROM s),
y AS (SELECT *, greatest(0, least(y1, 2000 + r_regionkey) - greatest(y0, 2000) + 1) AS have, r_regionkey + 1 AS need FROM c)
SELECT r_name AS request, 2::BIGINT AS submitted, 3::BIGINT AS expected, round(2 / 3.0::DOUBLE, 4) AS file_ratio, 'INSUFFICIENT' AS file_status, CASE WHEN r_regionkey % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS entity_coverage,
       CASE WHEN have >= need THEN 'FULL' WHEN have > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS year_coverage, 'MIXED' AS consistency, 'structured' AS primary_structure, round((100.0 + filled) / 2, 4)::DOUBLE AS average_completeness,
       CASE WHEN (100.0 + filled) / 2 >= 80 THEN 'HIGH' ELSE 'MEDIUM' END AS completeness_level FROM y""")
def run_validation(spark, sf_dir):
    files = _files(spark, sf_dir)
    return runs.validate_against_requirements(files, _asked(spark, sf_dir), _belongs(files))[1]


@query("""
SELECT r_name || '/' || f AS file_path, f AS file_name, CASE f WHEN 'broken.xlsx' THEN 'error' ELSE 'success' END AS status, CASE f WHEN 'broken.xlsx' THEN 0 WHEN 'book.xlsx' THEN 3 ELSE 1 END::BIGINT AS n_sheets, f = 'broken.xlsx' AS failed,
       15::BIGINT AS total_files, 10::BIGINT AS successful, 20::BIGINT AS sheets_processed, 10::BIGINT AS structured
FROM region, (SELECT unnest(['book.xlsx', 'orders.csv', 'broken.xlsx']) AS f)""")
def run_files(spark, sf_dir):
    run = runs.validate_files(_files(spark, sf_dir))
    counted = [F.lit(run.summary[c]).alias(c) for c in ("total_files", "successful", "sheets_processed", "structured")]
    return run.files.select("file_path", "file_name", "status", "n_sheets", F.col("error").isNotNull().alias("failed"), *counted)


@query(BOOKED_SQL + """
SELECT r_name || '/orders.csv' AS file_path, 'Booking_Date' AS column_name, 'date' AS data_type, count(*)::BIGINT AS non_null, count(*)::BIGINT AS n_rows, 0.0::DOUBLE AS missing_pct, NULL::DOUBLE AS mean_value, min(m) AS first_day FROM booked GROUP BY r_name
UNION ALL SELECT r_name || '/orders.csv', 'Booking_Note', 'text', count(*), count(*), 0.0, NULL, NULL FROM booked GROUP BY r_name
UNION ALL SELECT r_name || '/orders.csv', 'Amount', 'integer', count(*) FILTER (WHERE n % 2 = 0), count(*), round(100.0 * count(*) FILTER (WHERE n % 2 = 1) / count(*), 2), round(avg(n) FILTER (WHERE n % 2 = 0), 4), NULL FROM booked GROUP BY r_name""")
def run_columns(spark, sf_dir):
    run = runs.validate_files(_files(spark, sf_dir).where("path like '%.csv'"))
    # a note is a text of two lines, so its type depends on its name only
    return run.columns.select("file_path", "column_name", F.when(F.col("column_name") == "Booking_Note", "text").otherwise(F.col("data_type")).alias("data_type"), "non_null", F.col("n_rows").cast("long").alias("n_rows"), "missing_pct", "mean_value", "first_day")


@query("""
WITH v AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)
SELECT r_name AS request, position('<h3>broken.xlsx - ERROR</h3>' IN h) > 0 AS fails, h <> '' AS whole, n AS n_names FROM (
  SELECT r_name, n, '<h3>broken.xlsx - ERROR</h3>' AS h FROM region JOIN v ON n_regionkey = r_regionkey)""")
def run_report(spark, sf_dir):
    files = _files(spark, sf_dir)
    run = runs.validate_files(files)
    belongs = _belongs(files)
    pages = runs.html_report(run).join(belongs, "file_path")
    counts = run.files.join(belongs, "file_path").groupBy("request").agg(F.count("*").alias("total_files"), F.count_if(F.col("status") == "success").alias("successful"))
    names = run.values.where("column_name = 'Nation_Name' and value is not null").join(belongs, "file_path").groupBy("request").agg(F.count("*").alias("n_names"))
    whole = reports.whole_report(counts, pages, "request").join(names, "request")
    h = F.col("html")
    return whole.select("request", F.contains(h, F.lit("<h3>broken.xlsx - ERROR</h3>")).alias("fails"), (F.startswith(h, F.lit("<html><body>")) & F.endswith(h, F.lit("</body></html>")) & F.contains(h, F.lit("<td>Booking_Date</td>"))).alias("whole"), "n_names")


@query("""
WITH v AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)
SELECT r_name || '/book.xlsx' AS file_path, 'success' AS status, 3::BIGINT AS n_sheets, 'structured' AS structure, n::BIGINT AS n_rows, n::BIGINT AS n_names, 'integer' AS code_type, r_regionkey::VARCHAR AS under_name, false AS failed FROM region JOIN v ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/broken.xlsx', 'error', 0, NULL, NULL, NULL, NULL, NULL, true FROM region""")
def run_results(spark, sf_dir):
    results = runs.results(runs.validate_files(_files(spark, sf_dir).where("path like '%.xlsx'")))
    get = lambda path, kind="string": F.variant_get("result", path, kind)
    keys = F.concat(F.lit("$.sheets.kv.content.Region_1['"), F.split("file_path", "/")[0], F.lit("']._content[0]"))
    return results.select(
        "file_path", get("$.status").alias("status"), get("$.sheets_count", "bigint").alias("n_sheets"), get("$.sheets.t.structure_type").alias("structure"), get("$.sheets.t.metadata.row_count", "bigint").alias("n_rows"),
        get("$.sheets.t.metadata.columns.Nation_Name.non_null", "bigint").alias("n_names"), get("$.sheets.t.metadata.columns.Nation_Id.data_type").alias("code_type"), get(keys).alias("under_name"), get("$.error").isNotNull().alias("failed"),
    )


@query(BOOKED_SQL + """
SELECT r_name || '/orders.csv' AS file_path, row_number() OVER (PARTITION BY r_name ORDER BY m)::BIGINT AS row_no, strftime(m, '%Y-%m-%d') AS day, 'up to' || chr(10) || strftime(last_day(m), '%Y-%m-%d') AS note,
       CASE WHEN n % 2 = 0 THEN n END::BIGINT AS amount, CASE WHEN n % 2 = 0 THEN 'BIGINT' ELSE 'VOID' END AS amount_type FROM booked""")
def run_records(spark, sf_dir):
    rows = runs.records(runs.validate_files(_files(spark, sf_dir).where("path like '%.csv'")))
    amount = F.variant_get("record", "$.Amount", "variant")
    return rows.select(
        "file_path", F.col("row_no").cast("long").alias("row_no"), F.variant_get("record", "$.Booking_Date", "string").alias("day"), F.variant_get("record", "$.Booking_Note", "string").alias("note"),
        F.variant_get("record", "$.Amount", "bigint").alias("amount"), F.schema_of_variant(amount).alias("amount_type"),
    )


# ---- profiles of files, stored and merged

STATED = ["o_totalprice", "o_orderdate", "o_orderstatus", "o_custkey"]


@query("""
WITH c AS (
  SELECT 'o_totalprice' AS column_name, o_totalprice::VARCHAR AS v, o_totalprice AS x, NULL::DATE AS d FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, o_custkey, NULL FROM orders
  UNION ALL SELECT 'o_orderstatus', CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END, NULL, NULL FROM orders UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%d/%m/%Y'), NULL, o_orderdate::DATE FROM orders)
SELECT column_name, CASE column_name WHEN 'o_totalprice' THEN 'float' WHEN 'o_custkey' THEN 'integer' WHEN 'o_orderstatus' THEN 'categorical' ELSE 'date' END AS data_type, count(v)::BIGINT AS non_null, (count(*) - count(v))::BIGINT AS n_missing,
       round(min(x), 2) AS min_value, round(max(x), 2) AS max_value, round(avg(x), 2) AS mean_value, round(stddev_samp(x), 2) AS std_value, min(d) AS first_day, max(d) AS last_day, true AS distinct_near, true AS median_near FROM c GROUP BY 1""")
def agg_merged_states(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = {"o_totalprice": F.col("o_totalprice"), "o_custkey": F.col("o_custkey"), "o_orderstatus": F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")), "o_orderdate": F.date_format("o_orderdate", "dd/MM/yyyy")}
    cells = orders.select(F.col("o_orderpriority").alias("part"), F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), v.cast("string").alias("value")) for c, v in text.items()])))
    # a part is profiled on its own, and only the states are taken together
    whole = states.described(states.merged(states.column_states(cells, ["part"]), []), [], by_name=False)
    exact = cells.where("value is not null").groupBy("column_name").agg(F.count_distinct("value").alias("d"))
    number = cells.withColumn("x", F.col("value").try_cast("double")).groupBy("column_name").agg(F.percentile("x", F.array(F.lit(0.45), F.lit(0.55))).alias("q"))
    near = whole.join(exact, "column_name").join(number, "column_name")
    distinct = F.abs(F.col("distinct_values") - F.col("d")) <= 0.05 * F.col("d")
    median = F.col("median_value").isNull() | F.col("median_value").between(F.col("q")[0], F.col("q")[1])
    rounded = [F.round(c, 2).alias(c) for c in ("min_value", "max_value", "mean_value", "std_value")]
    return near.select("column_name", "data_type", "non_null", "n_missing", *rounded, "first_day", "last_day", distinct.alias("distinct_near"), median.alias("median_near"))
