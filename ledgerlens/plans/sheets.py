"""Queries of cell grids, key-value sheets, column metadata, validation, files read and written, and DuckDB SQL for the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions import cleaning
from ledgerlens.operators import compare, grid, keyvalue, metadata, nested, profile
from ledgerlens.plans.registry import query, table
from ledgerlens.sinks import reports
from ledgerlens.sinks import workbooks as book_sink
from ledgerlens.sources import readers, texts, workbooks
from ledgerlens.store import dealt

# ---- grids: a sheet a region with a title, a header and its nations below; one of keys; one with a blank cell

CELL_SQL = """
WITH n AS (SELECT r_name, n_name, n_nationkey, n_regionkey, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) + 2)::INT AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
cells AS (
  SELECT r_name AS file_path, 't' AS sheet_name, r AS row_idx, 1 AS col_idx, n_name AS value, 'text' AS vtype FROM n UNION ALL SELECT r_name, 't', r, 2, n_nationkey::VARCHAR, 'number' FROM n UNION ALL SELECT r_name, 't', r, 3, n_regionkey::VARCHAR, 'number' FROM n
  UNION ALL SELECT r_name, 't', 2, 1, 'Nation Name', 'text' FROM region UNION ALL SELECT r_name, 't', 2, 2, 'Nation Id', 'text' FROM region UNION ALL SELECT r_name, 't', 2, 3, 'Region Code', 'text' FROM region
  UNION ALL SELECT r_name, 't', 0, 1, 'Listing', 'text' FROM region
  UNION ALL SELECT r_name, 'kv', 0, 0, 'Name:', 'text' FROM region UNION ALL SELECT r_name, 'kv', 1, 0, r_name, 'text' FROM region UNION ALL SELECT r_name, 'kv', 2, 0, 'Id:', 'text' FROM region UNION ALL SELECT r_name, 'kv', 3, 0, r_regionkey::VARCHAR, 'number' FROM region
  UNION ALL SELECT r_name, 'blank', 5, 5, '  ', 'text' FROM region)
"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    cell = lambda sheet, r, c, v, kind: F.struct(
        F.lit(sheet).alias("sheet_name"), (F.lit(r) if isinstance(r, int) else r).cast("int").alias("row_idx"), F.lit(c).alias("col_idx"), v.cast("string").alias("value"), F.lit(kind).alias("vtype"))
    r = F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey")) + 2
    rows = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("r", r)
    body = rows.select("r_name", F.explode(F.array(cell("t", F.col("r"), 1, F.col("n_name"), "text"), cell("t", F.col("r"), 2, F.col("n_nationkey"), "number"), cell("t", F.col("r"), 3, F.col("n_regionkey"), "number"))).alias("x"))
    heads = region.select("r_name", F.explode(F.array(
        cell("t", 2, 1, F.lit("Nation Name"), "text"), cell("t", 2, 2, F.lit("Nation Id"), "text"), cell("t", 2, 3, F.lit("Region Code"), "text"), cell("t", 0, 1, F.lit("Listing"), "text"),
        cell("kv", 0, 0, F.lit("Name:"), "text"), cell("kv", 1, 0, F.col("r_name"), "text"), cell("kv", 2, 0, F.lit("Id:"), "text"), cell("kv", 3, 0, F.col("r_regionkey"), "number"), cell("blank", 5, 5, F.lit("  "), "text"),
    )).alias("x"))
    return body.unionByName(heads).select(F.col("r_name").alias("file_path"), "x.*")


@query(CELL_SQL + """,
s AS (SELECT * FROM cells WHERE sheet_name = 't' AND row_idx >= 2),
w AS (SELECT *, max(row_idx) OVER (PARTITION BY file_path) AS last, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN 'text' ELSE 'number' END AS kind FROM s),
b AS (SELECT a.*, z.kind AS below FROM w a LEFT JOIN w z ON a.file_path = z.file_path AND a.col_idx = z.col_idx AND z.row_idx = a.row_idx + 1),
g AS (SELECT file_path, row_idx, count(*) AS n, count(*) FILTER (WHERE vtype = 'text') AS texts, count(DISTINCT value) AS kinds, count(*) FILTER (WHERE regexp_matches(value, '^[A-Z]')) AS up, count(*) FILTER (WHERE kind <> below) AS change, max(last) AS last FROM b GROUP BY ALL)
SELECT file_path, row_idx, n::BIGINT AS n_filled, round(CASE WHEN row_idx < last THEN (texts / 3 + kinds / n + up / n + change / 3) / 4 ELSE (texts / 3 + kinds / n + up / n) / 3 END, 4) AS score FROM g""")
def str_header_score(spark, sf_dir):
    cells = _cells(spark, sf_dir).where("sheet_name = 't'")
    inside = grid.region_cells(cells, grid.regions(cells))
    return grid.header_scores(inside).select("file_path", "row_idx", "n_filled", F.round("score", 4).alias("score"))


@query(CELL_SQL + """
SELECT file_path, sheet_name, 0 AS region_id, min(row_idx) AS min_row, max(row_idx) AS max_row, min(col_idx) AS min_col, max(col_idx) AS max_col, count(*)::BIGINT AS area,
       CASE sheet_name WHEN 't' THEN 'table' ELSE 'key_value' END AS kind, CASE sheet_name WHEN 't' THEN 1.0 ELSE 0.2 END::DOUBLE AS confidence
FROM cells WHERE sheet_name = 'kv' OR (sheet_name = 't' AND row_idx >= 2) GROUP BY ALL""")
def str_region_types(spark, sf_dir):
    return grid.region_types(_cells(spark, sf_dir)).drop("header_row", "data_start_row").withColumn("confidence", F.round("confidence", 4))


HOLES = "(n_nationkey * 7 + n_regionkey * 3) % 4 <> 0"


@query(f"""
WITH RECURSIVE s AS (SELECT n_nationkey AS k, n_nationkey // 5 AS r, n_nationkey % 5 AS c FROM nation WHERE {HOLES}),
near AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
reach(a, b) AS (SELECT k, k FROM s UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
label AS (SELECT a AS k, min(b) AS root FROM reach GROUP BY 1),
g AS (SELECT root, min(r)::INT AS min_row, max(r)::INT AS max_row, min(c)::INT AS min_col, max(c)::INT AS max_col, count(*)::BIGINT AS area FROM label JOIN s USING (k) GROUP BY 1)
SELECT (row_number() OVER (ORDER BY root) - 1)::INT AS region_id, min_row, max_row, min_col, max_col, area FROM g WHERE area > 1""")
def str_regions(spark, sf_dir):
    k = F.col("n_nationkey")
    cells = table(spark, sf_dir, "nation").where(HOLES).select(F.lit("f").alias("file_path"), F.lit("s").alias("sheet_name"), F.floor(k / 5).cast("int").alias("row_idx"), (k % 5).cast("int").alias("col_idx"), F.col("n_name").alias("value"), F.lit("text").alias("vtype"))
    return grid.regions(cells).drop("file_path", "sheet_name")


@query("""
SELECT r_name AS file_path, unnest(['t', 'kv', 'blank', 'none']) AS sheet_name, unnest(['structured', 'unstructured', 'unknown', 'empty']) AS structure, unnest([1.0, 0.2, 0.0, 1.0])::DOUBLE AS confidence, false AS mixed,
       unnest([2, NULL, NULL, NULL])::INT AS header_row, unnest([3, NULL, NULL, NULL])::INT AS data_start_row FROM region""")
def str_classify(spark, sf_dir):
    sheets = table(spark, sf_dir, "region").select(F.col("r_name").alias("file_path"), F.explode(F.array(*[F.lit(x) for x in ("t", "kv", "blank", "none")])).alias("sheet_name"))
    found = grid.structures(_cells(spark, sf_dir), sheets)
    return found.select("file_path", "sheet_name", "structure", F.round("confidence", 4).alias("confidence"), "mixed", "header_row", "data_start_row")


@query("SELECT r_name AS file_path, unnest(['t', 'kv', 'blank']) AS sheet_name, unnest(['table', 'keys', 'keys']) AS way FROM region")
def str_routing(spark, sf_dir):
    as_table, as_keys = grid.routed(_cells(spark, sf_dir))
    return as_table.select("file_path", "sheet_name", F.lit("table").alias("way")).unionAll(as_keys.select("file_path", "sheet_name", F.lit("keys"))).distinct()


@query(CELL_SQL + """
SELECT file_path, (row_idx - 2)::INT AS row_no, CASE col_idx WHEN 1 THEN 'Nation Name' WHEN 2 THEN 'Nation Id' ELSE 'Region Code' END AS "column", value FROM cells WHERE sheet_name = 't' AND row_idx > 2""")
def prj_table_values(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    inside = grid.region_cells(cells, grid.regions(cells))
    return grid.table_values(inside, grid.tables(inside)).select("file_path", "row_no", "column", "value")


@query(CELL_SQL + " SELECT file_path, sheet_name, row_idx, col_idx, value FROM cells WHERE row_idx BETWEEN 2 AND 3 AND col_idx BETWEEN 1 AND 2 AND trim(value) <> ''")
def join_cell_region(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    boxes = cells.select("file_path", "sheet_name").distinct().select("*", F.lit(0).alias("region_id"), F.lit(2).alias("min_row"), F.lit(3).alias("max_row"), F.lit(1).alias("min_col"), F.lit(2).alias("max_col"))
    return grid.region_cells(cells, boxes).select("file_path", "sheet_name", "row_idx", "col_idx", "value")


@query(CELL_SQL + """
SELECT file_path, sheet_name, (dense_rank() OVER (PARTITION BY file_path, sheet_name ORDER BY row_idx) - 1)::INT AS row_idx, (dense_rank() OVER (PARTITION BY file_path, sheet_name ORDER BY col_idx) - 1)::INT AS col_idx, value FROM cells WHERE trim(value) <> ''""")
def prj_without_empty_lines(spark, sf_dir):
    return grid.without_empty_lines(_cells(spark, sf_dir)).select("file_path", "sheet_name", "row_idx", "col_idx", "value")


# ---- key-value lines and sheets

LINES = "array('CLIENT DETAILS', concat('Name: ', c_name), concat('Segment = ', c_mktsegment), 'a=b:c', 'PAST BALANCES', 'free words', concat('Balance:', CAST(c_nationkey AS STRING)), 'Empty: ')"


@query("""
SELECT c_custkey, section, key, value FROM (
  SELECT c_custkey, 'CLIENT DETAILS' AS section, 'Name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'CLIENT DETAILS', 'Segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'CLIENT DETAILS', 'a=b', 'c' FROM customer
  UNION ALL SELECT c_custkey, 'PAST BALANCES', 'Balance', c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'PAST BALANCES', 'Empty', NULL FROM customer)""")
def kv_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.expr(LINES)).alias("pos", "line"))
    return keyvalue.pairs(lines, "c_custkey", "pos", "line")


#: (row, column, value) of a sheet for each customer.
SHEET = [
    (0, 0, "'loose start'"), (1, 0, "'top = 1'"), (2, 0, "'CLIENT DETAILS'"), (3, 0, "concat('segment:', c_mktsegment)"), (3, 1, "'and more'"), (4, 0, "'(a) key'"), (4, 1, "c_name"), (5, 0, "'1.2 Balances'"),
    (6, 0, "'opening:'"), (6, 1, "CAST(c_nationkey AS STRING)"), (7, 0, "'some words'"), (7, 2, "'go on'"), (8, 0, "'opening: 7'"), (9, 0, "'2. Other'"), (10, 1, "'last: x'"), (11, 0, "'   '"),
]


def _tree(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(r).alias("row_idx"), F.lit(c).alias("col_idx"), F.expr(v).alias("value")) for r, c, v in SHEET])
    # dealt before they are unpacked: the operator deals by the same key, so cells don't move at all
    customers = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")
    return keyvalue.tree(customers.select("c_custkey", F.inline(cells)), ["c_custkey"])


TREE_SQL = """
WITH t AS (
  SELECT c_custkey, NULL AS section, NULL AS subsection, '_content' AS key, 'loose start' AS value FROM customer UNION ALL SELECT c_custkey, NULL, NULL, 'top', '1' FROM customer
  UNION ALL SELECT c_custkey, 'CLIENT DETAILS', NULL, 'segment', c_mktsegment || ' and more' FROM customer UNION ALL SELECT c_custkey, 'CLIENT DETAILS', NULL, '(a) key', c_name FROM customer
  UNION ALL SELECT c_custkey, 'CLIENT DETAILS', '2 Balances', 'opening', '7' FROM customer UNION ALL SELECT c_custkey, 'CLIENT DETAILS', '2 Balances', '_content', 'some words go on' FROM customer
  UNION ALL SELECT c_custkey, 'Other', NULL, 'last', 'x' FROM customer
  UNION ALL SELECT c_custkey, 'CLIENT DETAILS', NULL, NULL, NULL FROM customer UNION ALL SELECT c_custkey, 'CLIENT DETAILS', '2 Balances', NULL, NULL FROM customer UNION ALL SELECT c_custkey, 'Other', NULL, NULL, NULL FROM customer)"""


@query(TREE_SQL + " SELECT * FROM t")
def kv_tree(spark, sf_dir):
    return _tree(spark, sf_dir).drop("pos")


@query("SELECT c_custkey, 10::BIGINT AS total_keys, 2 AS max_depth FROM customer")
def kv_counts(spark, sf_dir):
    return keyvalue.tree_counts(_tree(spark, sf_dir), ["c_custkey"])


@query("""
SELECT c_custkey, '1' AS top, 'loose start' AS loose, c_mktsegment || ' and more' AS segment, c_name AS named, '7' AS opening, ['some words go on'] AS words, 'x' AS last, NULL::VARCHAR AS absent FROM customer""")
def kv_nested(spark, sf_dir):
    trees = nested.key_trees(_tree(spark, sf_dir), ["c_custkey"])
    paths = {
        "top": "$.top", "loose": "$._content[0]", "segment": "$['CLIENT DETAILS'].segment", "named": "$['CLIENT DETAILS']['(a) key']", "opening": "$['CLIENT DETAILS']['2 Balances'].opening",
        "last": "$.Other.last", "absent": "$.Other.first",
    }
    texts = F.variant_get("tree", "$['CLIENT DETAILS']['2 Balances']._content", "array<string>").alias("words")
    return trees.select("c_custkey", *[F.variant_get("tree", at, "string").alias(c) for c, at in paths.items()], texts)


@query("""
SELECT n_name AS file_path, lower(n_name) AS nation, n_nationkey::VARCHAR AS code, n_regionkey::VARCHAR AS zone, n_nationkey % 3 AS gap FROM nation""")
def kv_region_trees(spark, sf_dir):
    # two regions of keys a sheet, with some rows and columns between them
    nation = table(spark, sf_dir, "nation")
    cell = lambda r, c, v: F.struct(r.cast("int").alias("row_idx"), F.lit(c).alias("col_idx"), v.cast("string").alias("value"), F.when(v.cast("string").rlike(r"^\d+$"), "number").otherwise("text").alias("vtype"))
    low = 5 + F.col("n_nationkey") % 3
    cells = F.array(
        cell(F.lit(0), 3, F.lit("CLIENT DETAILS")), cell(F.lit(1), 3, F.lit("nation:")), cell(F.lit(1), 4, F.lower("n_name")),
        cell(low, 0, F.lit("code:")), cell(low, 1, F.col("n_nationkey")), cell(low + 1, 0, F.lit("zone:")), cell(low + 1, 1, F.col("n_regionkey")),
    )
    at = nation.select(F.col("n_name").alias("file_path"), F.lit("s").alias("sheet_name"), F.inline(cells))
    trees = nested.key_trees(nested.region_keys(at, grid.region_types(at)), ["file_path", "sheet_name"])
    paths = {"nation": "$.Region_1['CLIENT DETAILS'].nation", "code": "$.Region_2.code", "zone": "$.Region_2.zone"}
    return trees.select("file_path", *[F.variant_get("tree", p, "string").alias(c) for c, p in paths.items()]).join(nation.select(F.col("n_name").alias("file_path"), (F.col("n_nationkey") % 3).alias("gap")), "file_path")


@query("""
SELECT c_custkey, unnest(['top', 'CLIENT DETAILS', 'CLIENT DETAILS.segment', 'CLIENT DETAILS.(a) key', 'CLIENT DETAILS.2 Balances', 'CLIENT DETAILS.2 Balances.opening', 'Other', 'Other.last']) AS path FROM customer""")
def prj_key_paths(spark, sf_dir):
    return keyvalue.key_paths(_tree(spark, sf_dir), ["c_custkey"])


@query("""
SELECT c_custkey, 3 AS row_idx, 'segment' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 4, '(a) key', c_name FROM customer UNION ALL SELECT c_custkey, 6, 'opening', NULL FROM customer""")
def kv_across(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(r).alias("row_idx"), F.lit(c).alias("col_idx"), F.expr(v).alias("value")) for r, c, v in SHEET])
    return keyvalue.row_pairs(table(spark, sf_dir, "customer").select("c_custkey", F.inline(cells)), ["c_custkey"])


@query("""
SELECT r_name AS file_path, 'kv' AS sheet_name, 0 AS col_idx, 'Name' AS key, NULL AS value FROM region UNION ALL SELECT r_name, 'kv', 0, 'Id', NULL FROM region""")
def kv_down(spark, sf_dir):
    return keyvalue.row_pairs(_cells(spark, sf_dir).where("sheet_name = 'kv'"), ["file_path", "sheet_name"], across=False)


HEADERS = "CASE p_partkey % 5 WHEN 0 THEN '12. Sales' WHEN 1 THEN '(b) cost of sales' WHEN 2 THEN '• Other Income' WHEN 3 THEN 'Net   worth:' ELSE 'plain words' END"


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Sales' WHEN 1 THEN 'cost of sales' WHEN 2 THEN 'Other Income' WHEN 3 THEN 'Net   worth:' ELSE 'plain words' END AS header, CASE p_partkey % 5 WHEN 0 THEN '12. Sales' WHEN 1 THEN '(b) cost of sales' WHEN 2 THEN '• Other Income' WHEN 3 THEN 'Net worth' ELSE 'plain words' END AS key,
       p_partkey % 5 = 0 AS is_section, false AS is_subsection, p_partkey % 5 = 3 AS is_pair, p_partkey % 5 < 4 AS is_key FROM part""")
def kv_headers(spark, sf_dir):
    x = F.expr(HEADERS)
    return table(spark, sf_dir, "part").select("p_partkey", keyvalue.clean_header(x).alias("header"), keyvalue.clean_key(x).alias("key"), keyvalue.is_section(x).alias("is_section"), keyvalue.is_subsection(x).alias("is_subsection"), keyvalue.is_pair(x).alias("is_pair"), keyvalue.is_key(x).alias("is_key"))


# ---- columns and files described

@query("""
WITH s AS (SELECT source, lang AS file_name, CASE WHEN n_chars > 4000 THEN 'structured' WHEN n_chars > 1500 THEN 'unstructured' ELSE NULL END AS structure, doc_id % 7 - 3 AS n_entities, 0 AS n_dates FROM documents),
n AS (SELECT source, coalesce(structure, 'unknown') AS structure, count(*) AS n, bool_or(n_entities > 0) AS e FROM s GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS total_sheets, string_agg(structure || ':' || n, ',' ORDER BY structure || ':' || n) AS structures, bool_or(e) AS has_entities, false AS has_dates FROM n GROUP BY 1""")
def agg_structure_summary(spark, sf_dir):
    n = F.col("n_chars")
    kind = F.when(n > 4000, "structured").when(n > 1500, "unstructured")
    return metadata.structure_summary(table(spark, sf_dir, "documents").select("source", kind.alias("structure"), (F.col("doc_id") % 7 - 3).alias("n_entities"), F.lit(0).alias("n_dates")), ["source"])


@query("""
SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS entities FROM documents WHERE n_chars > 1000 GROUP BY 1""")
def agg_combined_entities(spark, sf_dir):
    return metadata.combined_entities(table(spark, sf_dir, "documents").select("source", F.when(F.col("n_chars") > 1000, F.col("lang")).alias("primary_entity")), ["source"])


@query("""
WITH p AS (SELECT o_orderpriority, year(o_orderdate) AS y, o_orderkey, o_totalprice FROM orders)
SELECT o_orderpriority, y || '-' || (y + 1) AS period, y::INT AS start_year, (y + 1)::INT AS end_year, max(o_orderkey) AS o_orderkey FROM p GROUP BY o_orderpriority, y""")
def agg_combined_periods(spark, sf_dir):
    y = F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", y.alias("start_year"), (y + 1).alias("end_year"), "o_orderkey")
    return metadata.combined_periods(rows, ["o_orderpriority"], "o_orderkey")


@query("""
WITH n AS (SELECT c_nationkey, c_mktsegment AS e, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_nationkey, min({'n': -n, 'e': e}).e AS primary_company, string_agg(e, '|' ORDER BY e) AS all_entities, (-min({'n': -n, 'e': e}).n)::BIGINT AS frequency FROM n GROUP BY 1""")
def agg_entity_mode(spark, sf_dir):
    found = metadata.company_info(table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("primary_entity")), ["c_nationkey"])
    return found.withColumn("all_entities", F.array_join("all_entities", "|"))


@query("""
SELECT value, n, place FROM (SELECT value, n::BIGINT AS n, (row_number() OVER (ORDER BY n DESC, seen, value))::INT AS place FROM (SELECT p_type AS value, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY 1)) WHERE place <= 10""")
def sort_first_seen_top(spark, sf_dir):
    return profile.first_seen_top(table(spark, sf_dir, "part"), "p_type", "p_partkey")


@query("""
WITH v AS (SELECT 'o_comment_name' AS column_name, 'plain' AS value FROM orders UNION ALL SELECT 'code', CASE WHEN o_orderkey % 2 = 0 THEN 'IBM' ELSE 'x' END FROM orders UNION ALL SELECT 'free', lower(o_orderpriority) FROM orders UNION ALL SELECT 'paid', o_orderdate::DATE::VARCHAR FROM orders)
SELECT DISTINCT column_name, column_name IN ('o_comment_name', 'code') AS entities, column_name = 'paid' AS dates FROM v WHERE column_name <> 'free'""")
def ent_dt_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cells = orders.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), v.cast("string").alias("value")) for c, v in (
        ("o_comment_name", F.lit("plain")), ("code", F.when(F.col("o_orderkey") % 2 == 0, "IBM").otherwise("x")), ("free", F.lower("o_orderpriority")), ("paid", F.col("o_orderdate").cast("date")))])))
    of = metadata.entity_columns(cells, []).withColumn("entities", F.lit(True)).join(metadata.date_columns(cells, []).withColumn("dates", F.lit(True)), "column_name", "full")
    return of.select("column_name", F.coalesce("entities", F.lit(False)).alias("entities"), F.coalesce("dates", F.lit(False)).alias("dates"))


DESCRIBED = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


@query("""
WITH d AS (SELECT count(*)::BIGINT AS n FROM orders)
SELECT 'o_custkey' AS column_name, 'integer' AS data_type, n AS n_rows, 0.0::DOUBLE AS missing_pct, 'min|max|mean|std' AS facts FROM d UNION ALL SELECT 'o_orderstatus', 'categorical', n, 0.0, 'n_top|top_categories' FROM d
UNION ALL SELECT 'o_totalprice', 'float', n, 0.0, 'min|max|mean|std' FROM d UNION ALL SELECT 'o_orderdate', 'date', n, 0.0, 'min_date|max_date' FROM d""")
def prj_column_metadata(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(*DESCRIBED)
    known = profile.missing_values(orders, DESCRIBED).join(profile.infer_types(orders, DESCRIBED, by_name=False), "column_name")
    spans = profile.date_range(orders, "o_orderdate").withColumn("column_name", F.lit("o_orderdate"))
    found = metadata.column_metadata(known, profile.numeric_profile(orders, ["o_custkey", "o_totalprice"]), profile.text_lengths(orders, ["o_orderstatus"]), spans, profile.top_values(orders, ["o_orderstatus"]))
    return found.select("column_name", "data_type", "n_rows", "missing_pct", F.array_join(F.json_object_keys("detail"), "|").alias("facts"))


@query("SELECT r_name AS file_path, true AS has_data, 3::BIGINT AS n_columns, 3::BIGINT AS n_paths FROM region")
def prj_mixed_metadata(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    as_table, as_keys = cells.where("sheet_name = 't'"), cells.where("sheet_name = 'kv'")
    inside = grid.region_cells(as_table, grid.regions(as_table))
    columns = grid.table_values(inside, grid.tables(inside)).groupBy("file_path").agg(F.count_distinct("column").alias("n_columns"))
    paths = keyvalue.key_paths(keyvalue.tree(as_keys, ["file_path", "sheet_name"]), ["file_path"]).groupBy("file_path").agg(F.count("*").alias("n_paths"))
    return metadata.sheet_metadata(columns, paths, ["file_path"])


@query("""
SELECT count(*)::BIGINT AS n_rows, count(DISTINCT paid)::BIGINT AS n_paid, sum(paid)::BIGINT AS total, count(flag)::BIGINT AS n_flag, 'Order_Key,Paid_Sum,Column_3,Paid_Sum_1' AS names, 'integer,integer,boolean,categorical' AS kinds FROM (
  SELECT DISTINCT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_custkey END AS paid, CASE WHEN o_orderkey % 2 = 0 THEN true ELSE false END AS flag, o_orderstatus FROM orders)""")
def prj_cleaned_table(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        k.cast("string").alias(" Order-Key "), F.when(k % 20 == 0, " N/A").otherwise(F.col("o_custkey").cast("string")).alias("Paid (Sum)"), F.when(k % 2 == 0, "Yes").otherwise(" no ").alias("  "), F.col("o_orderstatus").alias("Paid Sum"),
    )
    typed, found = profile.cleaned(raw, drop_duplicates=True)
    a, b, c, d = typed.columns
    kinds = found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*[F.lit(x) for x in typed.columns]), F.col("column_name")).alias("p"), "inferred_type"))), lambda x: x["inferred_type"]), ",").alias("kinds"))
    return typed.agg(F.count("*").alias("n_rows"), F.count_distinct(b).alias("n_paid"), F.sum(b).alias("total"), F.count(c).alias("n_flag")).withColumn("names", F.lit(",".join(typed.columns))).crossJoin(kinds)


FILL = "CASE event_id % 3 WHEN 0 THEN ' NA ' WHEN 1 THEN event_type ELSE concat('a', chr(9), 'b  c ') END"


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN event_type ELSE 'a' || chr(9) || 'b  c' END AS filled, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN event_type ELSE 'ab c' END AS cell FROM events""")
def prj_fill_and_clean(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", cleaning.fill_missing(F.expr(FILL), "none").alias("filled"), cleaning.clean_cell(F.expr(FILL)).alias("cell"))


@query("""
SELECT l_returnflag, coalesce(round(avg(CASE WHEN l_linenumber > 9 THEN l_tax END), 4), 0)::DOUBLE AS none, round(avg(l_tax), 4) AS mean FROM lineitem GROUP BY 1""")
def prj_safe_average(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag").agg(F.round(cleaning.safe_average(F.when(F.col("l_linenumber") > 9, F.col("l_tax"))), 4).alias("none"), F.round(cleaning.safe_average(F.col("l_tax")), 4).alias("mean"))


@query("""
SELECT c_custkey, 'x,y,x_1,x_2,Column_5,x_1_1,y_1' AS names, replace(replace(replace(c_name || ' Co., Ltd.', ' ', '_'), '.', ''), ',', '') AS safe FROM customer""")
def win_unique_names(spark, sf_dir):
    names = F.array(*[cleaning.column_name(F.lit(v), F.lit(k)) for k, v in enumerate(["x", "y", "x", "x_2", " ", "x_1", "y"], 1)])
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(compare.unique_names(names), ",").alias("names"), cleaning.file_safe(F.concat("c_name", F.lit(" Co., Ltd."))).alias("safe"))


# ---- validation

@query("""
WITH s AS (SELECT source, count(DISTINCT lang) AS submitted FROM documents GROUP BY 1)
SELECT source, submitted::BIGINT AS submitted, 4::BIGINT AS expected, round(submitted / 4.0::DOUBLE, 4) AS ratio, CASE WHEN submitted >= 4 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS status FROM s""")
def join_file_count(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n"))
    return n.select("source", compare.file_count(F.col("n"), F.lit(4).cast("long")).alias("c")).select("source", "c.*")


@query("""
SELECT r_name, count(*)::BIGINT AS n_required, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 7000))::BIGINT AS n_present,
       round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 7000))::DOUBLE / count(*), 4) AS coverage FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def join_coverage_ratio(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    required = nation.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.upper("n_name").alias("name"))
    found = table(spark, sf_dir, "supplier").where("s_acctbal > 7000").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit(" "), F.lower("n_name")).alias("name"))
    return compare.coverage_ratio(compare.coverage(required, found, "name"), "r_name")


@query("""
WITH t AS (SELECT source, lang, 100.0::DOUBLE - 100.0 * count(*) FILTER (WHERE doc_id % 3 = 0) / count(*) AS pct FROM documents GROUP BY ALL)
SELECT source, round(avg(pct), 4) AS average_completeness, count(*) FILTER (WHERE pct < 80)::BIGINT AS sheets_with_issues, CASE WHEN avg(pct) >= 80 THEN 'HIGH' WHEN avg(pct) >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS completeness_level FROM t GROUP BY 1""")
def join_completeness_level(spark, sf_dir):
    pct = F.lit(100.0) - F.lit(100.0) * F.count_if(F.col("doc_id") % 3 == 0) / F.count("*")
    sheets = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(pct.alias("pct"))
    return compare.completeness(sheets, "source", "pct").withColumn("average_completeness", F.round("average_completeness", 4))


@query("""
SELECT n_name, n_regionkey, 2 AS total_requirements, '1. Accounts of ' || r_name || ' / 2. Plans' AS listed FROM nation JOIN region ON n_regionkey = r_regionkey""")
def join_attached(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.inline(F.expr("array(struct(1 AS id, concat('Accounts of ', r_name) AS text), struct(2 AS id, 'Plans' AS text))")))
    found = compare.attached(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), region, "n_regionkey", ["id", "text"])
    return found.withColumn("listed", F.array_join(F.transform("requirements", lambda r: F.concat_ws(". ", r["id"].cast("string"), r["text"])), " / ")).drop("requirements")


CHECKS_SQL = """
WITH sheets AS (SELECT source, lang AS file_name, CASE WHEN lang = 'en' THEN 'structured' ELSE 'unstructured' END AS structure, round(100.0::DOUBLE - 100.0 * count(*) FILTER (WHERE doc_id % 3 = 0) / count(*), 2) AS completeness FROM documents GROUP BY source, lang),
y AS (SELECT DISTINCT source, 2000 + doc_id % 40 AS year FROM documents),
ry AS (SELECT DISTINCT source, year FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(range(2000, 2050)) AS year)),
re AS (SELECT DISTINCT source, e FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(['en', 'de', 'xx', 'fr']) AS e)),
a AS (SELECT source, count(DISTINCT file_name) AS submitted, avg(completeness) AS c FROM sheets GROUP BY 1),
k AS (SELECT source, structure, count(*) AS n FROM sheets GROUP BY ALL),
p AS (SELECT source, count(*) AS kinds, min({'n': -n, 'k': structure}).k AS primary_structure FROM k GROUP BY 1),
ye AS (SELECT ry.source, count(*) AS need, count(y.year) AS have FROM ry LEFT JOIN y ON ry.source = y.source AND ry.year = y.year GROUP BY 1),
en AS (SELECT re.source, count(*) AS need, count(s.file_name) AS have FROM re LEFT JOIN sheets s ON re.source = s.source AND re.e = s.file_name GROUP BY 1)
SELECT source, submitted::BIGINT AS submitted, 3::BIGINT AS expected, round(submitted / 3.0::DOUBLE, 4) AS file_ratio, CASE WHEN submitted >= 3 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS file_status, round(en.have::DOUBLE / en.need, 4) AS entity_coverage,
       CASE WHEN ye.have >= ye.need THEN 'FULL' WHEN ye.have > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS year_coverage, CASE WHEN kinds = 1 THEN 'CONSISTENT' ELSE 'MIXED' END AS consistency, primary_structure, round(c, 4) AS average_completeness,
       CASE WHEN c >= 80 THEN 'HIGH' WHEN c >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS completeness_level FROM a JOIN p USING (source) JOIN ye USING (source) JOIN en USING (source)"""


def _checks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    pct = F.round(F.lit(100.0) - F.lit(100.0) * F.count_if(F.col("doc_id") % 3 == 0) / F.count("*"), 2)
    sheets = docs.groupBy("source", F.col("lang").alias("file_name")).agg(pct.alias("completeness")).withColumn("structure", F.when(F.col("file_name") == "en", "structured").otherwise("unstructured"))
    sources = docs.select("source").distinct()
    years = docs.select("source", (2000 + F.col("doc_id") % 40).alias("year")).distinct()
    return compare.rule_checks(
        sheets, sources.withColumn("expected_files", F.lit(3)), docs.select("source", F.col("lang").alias("entity")), years,
        sources.withColumn("entity", F.explode(F.array(*[F.lit(x) for x in ("EN", "de ", "xx", "fr")]))), sources.withColumn("year", F.explode(F.sequence(F.lit(2000), F.lit(2049)))), "source",
    )


@query(CHECKS_SQL)
def join_rule_checks(spark, sf_dir):
    return _checks(spark, sf_dir)


@query("SELECT p_brand, max(p_size)::INT AS last, (max(p_size) + 1)::INT AS version, replace(p_brand, ' ', '_') || '_REPORT_v' || (max(p_size) + 1) || '.txt' AS file_name FROM part GROUP BY 1 UNION ALL SELECT 'New', NULL, 1, 'New_REPORT_v1.txt'")
def join_next_versions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").cast("int").alias("last"))
    names = parts.unionAll(spark.createDataFrame([("New", None)], "p_brand string, last int"))
    tracker = parts.select(cleaning.file_safe(F.col("p_brand")).alias("name"), F.col("last").alias("version"))
    saved = reports.versioned(names.withColumn("text", F.lit("t")), tracker, "p_brand", "text", "REPORT")
    return names.join(saved, cleaning.file_safe(F.col("p_brand")) == F.col("name")).select("p_brand", "last", "version", "file_name")


# ---- files written and read

@query("SELECT r_name AS name, 0 AS pos, 'head of ' || r_name AS line FROM region UNION ALL SELECT r_name, 1, 'code ' || r_regionkey FROM region")
def snk_documents(spark, sf_dir):
    from ledgerlens.plans.folders import scratch

    path = f"{scratch(spark)}/documents"
    docs = table(spark, sf_dir, "region").select("r_name", F.concat(F.lit("head of "), "r_name", F.lit("\n"), F.lit("code "), F.col("r_regionkey").cast("string")).alias("text"))
    reports.write_documents(docs, "r_name", "text", path)
    back = spark.read.text(path, wholetext=True).select("name", F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("pos", "line"))
    return back.select("name", "pos", "line")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment || '; \"quoted\", ' || c_nationkey AS note FROM customer")
def src_csv_delims(spark, sf_dir):
    from ledgerlens.plans.folders import scratch

    path = f"{scratch(spark)}/values"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit('; "quoted", '), F.col("c_nationkey").cast("string")).alias("note"))
    rows.repartition(3).write.option("header", True).option("sep", ";").option("escape", '"').option("quoteAll", True).csv(path)
    return texts.separated(spark, path)


#: A cell with all that makes separated values hard: both kinds of line ends, quotes, each delimiter, letters beyond ASCII; rows of three cells where the header has two are bad.
WILD = "concat('é', c_name, ',;', chr(10), '\"', c_mktsegment, '|', chr(9), chr(13), chr(10), CAST(c_nationkey AS STRING))"


@query("""
SELECT (c_custkey % 4)::INT AS way, c_custkey::VARCHAR AS "key", CASE WHEN c_custkey % 4 = 3 AND c_custkey % 40 < 20 THEN 'plain ' || c_name ELSE 'é' || c_name || ',;' || chr(10) || '"' || c_mktsegment || '|' || chr(9) || chr(13) || chr(10) || c_nationkey END AS note
FROM customer""")
def src_csv_mixed(spark, sf_dir):
    from ledgerlens.plans.folders import scratch
    from ledgerlens.sources import separated

    top = scratch(spark)
    note = F.when((F.col("c_custkey") % 4 == 3) & (F.col("c_custkey") % 40 < 20), F.concat(F.lit("plain "), "c_name")).otherwise(F.expr(WILD))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), note.alias("note"))
    for way, (sep, encoding) in enumerate([(",", "UTF-8"), (";", "ISO-8859-1"), ("\t", "UTF-16"), ("|", "UTF-8")]):
        own = rows.where(F.col("key") % 4 == way).repartition(2)
        own.write.options(header=True, sep=sep, encoding=encoding, escape='"', quoteAll=way < 3).csv(f"{top}/{way}")
    found = separated.records(spark, [f"{top}/{k}" for k in range(4)]).where("row_no > 0 and error is null")
    return found.select(F.regexp_extract("file_path", r"/(\d)/[^/]*$", 1).cast("int").alias("way"), F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("note"))


@query("SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'windows-1252' WHEN 2 THEN 'utf-8-sig' ELSE 'utf-16be' END AS encoding FROM nation")
def src_encoding(spark, sf_dir):
    name, k = F.concat("n_name", F.lit(" é")), F.col("n_nationkey") % 4
    content = (
        F.when(k == 0, F.encode(name, "UTF-8")).when(k == 1, F.encode(name, "ISO-8859-1")).when(k == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(name, "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(name, "UTF-16BE")))
    )
    return table(spark, sf_dir, "nation").select("n_name", texts.encoding_of(content).alias("encoding"))


@query(CELL_SQL + " SELECT file_path, sheet_name, row_idx, col_idx, value, vtype FROM cells")
def src_xlsx(spark, sf_dir):
    return workbooks.workbook_cells(book_sink.workbooks(_cells(spark, sf_dir)))


@query(CELL_SQL + """
SELECT file_path, sheet_name, (max(row_idx) + 1)::INT AS n_rows, (max(col_idx) + 1)::INT AS n_cols, false AS has_formulas, 0 AS n_merged FROM cells GROUP BY ALL""")
def src_sheet_facts(spark, sf_dir):
    return workbooks.sheet_facts(book_sink.workbooks(_cells(spark, sf_dir))).withColumn("n_merged", F.size("merged")).drop("merged")


@query(CELL_SQL + """
SELECT file_path || '.xlsx' AS file_path, 'success' AS status, 3::BIGINT AS n_sheets, count(*)::BIGINT AS n_cells, NULL AS error FROM cells GROUP BY 1 UNION ALL SELECT r_name || '.csv', 'success', 1, 4, NULL FROM region
UNION ALL SELECT r_name || '.xls', 'error', 0, 0, 'ReadError: no reader for this format' FROM region UNION ALL SELECT r_name || '.dat', 'success', 1, 4, NULL FROM region""")
def src_dispatch(spark, sf_dir):
    books = book_sink.workbooks(_cells(spark, sf_dir)).select(F.concat("path", F.lit(".xlsx")).alias("path"), "content")
    plain = table(spark, sf_dir, "region").select("r_name", F.encode(F.concat(F.lit("name|key\n"), "r_name", F.lit("|"), F.col("r_regionkey").cast("string"), F.lit("\n")), "UTF-8").alias("content"))
    other = [plain.select(F.concat("r_name", F.lit(e)).alias("path"), "content") for e in (".csv", ".xls", ".dat")]
    return readers.file_status(readers.cells(reduce(DataFrame.unionByName, other, books)))


@query("""
SELECT c_custkey, '1' AS id, c_mktsegment AS section, 'Accounts of ' || c_name AS requirement, 'Medium' AS priority, 1 AS row_no FROM customer UNION ALL SELECT c_custkey, '9', '', 'Plans', 'High', 2 FROM customer""")
def src_requirement_rows(spark, sf_dir):
    rows = [(1, "Info Requirement", "concat('Accounts of ', c_name)"), (1, "Category", "c_mktsegment"), (1, "Priority", "' '"), (2, "Information Requirement", "'Plans'"), (2, "S.No.", "'9'"), (2, "Priority", "'High'"), (3, "Section", "'lost'")]
    cells = F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("column"), F.expr(v).alias("value")) for r, c, v in rows])
    # one file is read by few tasks, which would hold all cells of theirs until they are moved, so customers are dealt before they are unpacked
    customers = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return texts.requirement_rows(customers.select("c_custkey", F.inline(cells)), ["c_custkey"])


@query("SELECT c_nationkey, section, place FROM (SELECT c_nationkey, section, (row_number() OVER (PARTITION BY c_nationkey ORDER BY first, section))::INT AS place FROM (SELECT c_nationkey, c_mktsegment AS section, min(c_custkey) AS first FROM customer GROUP BY ALL))")
def src_ordered_sections(spark, sf_dir):
    return texts.ordered_sections(table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("section"), F.col("c_custkey").alias("row_no")), ["c_nationkey"])


@query("""
SELECT n_regionkey, string_agg(chr(10) || '--- Document: ' || n_name || ' ---' || chr(10) || coalesce(CASE WHEN n_nationkey % 4 <> 0 THEN 'text ' || n_nationkey END, ''), chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1""")
def src_consolidated(spark, sf_dir):
    docs = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("text "), F.col("n_nationkey").cast("string"))).alias("text"))
    return texts.consolidated(docs, "n_regionkey", "n_name", "text", "n_nationkey")


@query("SELECT c_custkey, unnest(['Revenue', 'Debt']) AS category, unnest(['Sales of ' || c_name, 'Loans']) AS text FROM customer WHERE c_custkey % 3 <> 0")
def src_json_requirements(spark, sf_dir):
    told = F.when(F.col("c_custkey") % 3 != 0, F.to_json(F.create_map(F.lit("Revenue"), F.concat(F.lit("Sales of "), "c_name"), F.lit("Debt"), F.lit("Loans")))).otherwise("not json")
    maps = table(spark, sf_dir, "customer").select("c_custkey", told.alias("j"))
    return texts.requirements(maps, "j", ["c_custkey"])


@query("SELECT p_brand AS name, p_brand || '_IRL_v' || max(p_size) || '.xlsx' AS path, max(p_size)::INT AS version FROM part GROUP BY 1")
def src_latest_file(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.concat("p_brand", F.lit("_IRL_v"), F.col("p_size").cast("string"), F.lit(".xlsx")).alias("path")).distinct()
    return texts.latest_file(files, "name")


@query("""
WITH p AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE repeat(o_orderpriority || ' ', 12) END AS text FROM orders)
SELECT o_custkey, string_agg(CASE WHEN trim(text) <> '' THEN chr(10) || '--- Page ' || page || ' ---' || chr(10) || text ELSE '' END, '' ORDER BY page) AS text, count(*)::BIGINT AS page_count,
       sum(CASE WHEN trim(text) <> '' THEN length('x--- Page ' || page || ' ---x' || text) ELSE 0 END)::INT AS character_count, avg(length(trim(text))) FILTER (WHERE page <= 3) < 100 AS scanned FROM p GROUP BY 1""")
def src_page_texts(spark, sf_dir):
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = table(spark, sf_dir, "orders").select("o_custkey", page.alias("page"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(12))).alias("text"))
    return texts.page_texts(pages, "o_custkey", "page", "text")


# ---- reports

@query("""
WITH s AS (SELECT source AS file_path, lang AS sheet_name, count(*) AS n, count(*) FILTER (WHERE n_chars = 0) AS e FROM documents GROUP BY ALL),
k AS (SELECT file_path, count(*) AS sheets_count FROM s GROUP BY 1)
SELECT 'file ' || file_path AS file_name, file_path, 'success' AS status, sheets_count::BIGINT AS sheets_count, sheet_name, 'structured' AS structure_type, e::BIGINT AS errors, n::BIGINT AS row_count, 2 AS column_count, 'doc_id, text' AS columns FROM s JOIN k USING (file_path)""")
def snk_summary_csv(spark, sf_dir):
    from ledgerlens.plans.folders import scratch

    docs = table(spark, sf_dir, "documents")
    sheets = docs.groupBy(F.col("source").alias("file_path"), F.col("lang").alias("sheet_name")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("n_chars") == 0).alias("n_errors")).withColumn("structure", F.lit("structured"))
    files = docs.select(F.col("source").alias("file_path")).distinct().select("file_path", F.concat(F.lit("file "), "file_path").alias("file_name"), F.lit("success").alias("status"))
    columns = sheets.select("file_path", "sheet_name", F.inline(F.expr("array(struct(1 AS pos, 'text' AS column_name), struct(0 AS pos, 'doc_id' AS column_name))")))
    path = f"{scratch(spark)}/summary"
    reports.write_csv(reports.sheet_summary(files, sheets, columns), path)
    return spark.read.schema("file_name string, file_path string, status string, sheets_count long, sheet_name string, structure_type string, errors long, row_count long, column_count int, columns string").option("header", True).csv(path)


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS n_regionkey FROM nation")
def snk_json(spark, sf_dir):
    from ledgerlens.plans.folders import scratch

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey"))
    path = f"{scratch(spark)}/results"
    reports.write_json(rows, path)
    lines = reports.as_json(spark.read.schema(rows.schema).json(path))
    return lines.select(F.from_json("value", rows.schema).alias("r")).select("r.*")


REQUEST_HEAD = "concat(c_mktsegment, ' Ltd')"


def _request_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(F.expr("array(struct(0.5D AS ord, '' AS id, '**TAX**' AS info_request, '' AS priority), struct(1D AS ord, '1' AS id, concat('(a) Filings of ', c_name) AS info_request, 'High' AS priority), struct(2D AS ord, '2' AS id, '(b) Audits' AS info_request, '' AS priority))")))


def _request_heads(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(REQUEST_HEAD).alias("company"), F.lit("2024-03-05").cast("date").alias("generated"), F.lit("2023-24").alias("current_year"), F.lit("2022-23").alias("previous_year"), F.lit("March 31, 2024").alias("balance_sheet_date"))


@query("""
SELECT c_custkey, concat_ws(chr(10), 'INFORMATION REQUIREMENTS LIST', repeat('=', 50), 'Company: ' || c_mktsegment || ' Ltd', 'Generated: March 05, 2024', '', 'Historical period: FY2023-24, FY2022-23', 'Balance sheet date: March 31, 2024', 'Information on consolidated basis wherever applicable', '', repeat('=', 50), '',
       '**TAX**', '', '1. (a) Filings of ' || c_name || ' (Priority: High)', '', '2. (b) Audits', '') AS text FROM customer""")
def snk_request_list(spark, sf_dir):
    return reports.request_list(_request_rows(spark, sf_dir), _request_heads(spark, sf_dir), "c_custkey")


@query("""
SELECT c_custkey::VARCHAR AS file_path, 'Information Requirements List' AS sheet_name, unnest([0, 1, 2, 4, 5, 6, 8, 8, 8, 8, 8, 9, 9, 9, 9]) AS row_idx, unnest([0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 0, 1, 2, 3]) AS col_idx,
       unnest(['INFORMATION REQUIREMENTS LIST', 'Company: ' || c_mktsegment || ' Ltd', 'Generated: March 05, 2024', 'Historical period: 2022-23, 2023-24', 'Balance sheet date: March 31, 2024', 'Information on consolidated basis wherever applicable',
               'S.No.', 'Section', 'Information Requirement', 'Priority', 'Comments', '1', 'TAX', '(a) Filings of ' || c_name || chr(10) || '(b) Audits', 'Low']) AS value FROM customer""")
def snk_request_workbook(spark, sf_dir):
    from ledgerlens.operators import requests

    sheet = requests.section_sheet(_request_rows(spark, sf_dir), "c_custkey")
    made = book_sink.workbooks(reports.request_cells(sheet, _request_heads(spark, sf_dir), "c_custkey"))
    return workbooks.workbook_cells(made).drop("vtype")


@query("""
SELECT source AS file_name, '<div class=''file''><h3>' || source || ' - SUCCESS</h3>' || string_agg('<div class=''sheet''><h4>Sheet: ' || lang || '</h4><p>Structure Type: structured</p></div>', '' ORDER BY lang) || '</div>' AS html
FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1""")
def snk_file_report(spark, sf_dir):
    sheets = table(spark, sf_dir, "documents").select(F.col("source").alias("file_name"), F.lit("success").alias("status"), F.col("lang").alias("sheet_name"), F.lit("structured").alias("structure")).distinct()
    return reports.file_report(sheets)


@query("""
SELECT r_name, '<table>' || string_agg('<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>', '' ORDER BY r) || '</table>' AS html
FROM (SELECT r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS r FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE r <= 5 GROUP BY 1""")
def snk_preview(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey"))
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("row_no", r)
    return reports.preview_rows(rows.select("r_name", "row_no", F.inline(F.array(F.struct(F.lit(1).alias("col_no"), F.col("n_name").alias("value")), F.struct(F.lit(2).alias("col_no"), F.col("n_nationkey").cast("string").alias("value"))))), ["r_name"])


@query(f"SELECT source, '<ul>' || concat_ws('', '<li>submitted: ' || submitted || '</li>', '<li' || CASE file_status WHEN 'SUFFICIENT' THEN ' class=''success''' ELSE ' class=''error''' END || '>file_status: ' || file_status || '</li>') || '</ul>' AS html FROM ({CHECKS_SQL})")
def snk_verdict_report(spark, sf_dir):
    return reports.verdict_report(_checks(spark, sf_dir).select("source", "submitted", "file_status"), "source")


@query("""
SELECT source, CASE WHEN n_chars > 800 THEN 'Successful' ELSE 'Failed' END AS label, count(*)::BIGINT AS n FROM documents GROUP BY ALL""")
def snk_chart_data(spark, sf_dir):
    return reports.status_share(table(spark, sf_dir, "documents").select("source", F.when(F.col("n_chars") > 800, "success").otherwise("error").alias("status")), "source")


@query("""
SELECT c_custkey, CASE WHEN length(c_name || ' of ' || c_mktsegment) > 20 THEN left(c_name || ' of ' || c_mktsegment, 20) || '...' ELSE c_name || ' of ' || c_mktsegment END AS label, (c_custkey % 2 = 0)::INT AS ok,
       'Extracted Text from PDF' || chr(10) || 'Extraction Method: DIGITAL' || chr(10) || 'Extraction Date: 2024-03-05 06:07:08' || chr(10) || repeat('=', 50) || chr(10) || chr(10) || c_name AS dump FROM customer""")
def snk_labels_and_dumps(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    name = F.concat_ws(" of ", "c_name", "c_mktsegment")
    bars = reports.shortened(name, reports.LABEL_CHARS)
    return rows.select("c_custkey", bars.alias("label"), (F.col("c_custkey") % 2 == 0).cast("int").alias("ok"), reports.extracted_dump(F.col("c_name"), F.lit("DIGITAL"), F.lit("2024-03-05 06:07:08").cast("timestamp")).alias("dump"))
