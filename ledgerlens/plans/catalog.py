"""Queries of cleaning, profiles, dates, terms and comparisons, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions import cleaning, dates, terms
from ledgerlens.operators import compare, metadata, profile
from ledgerlens.plans.registry import per_column, query, table

BLANKED = "CASE WHEN l_linenumber % 5 = 0 THEN ' N/A ' WHEN l_linenumber % 7 = 0 THEN '' ELSE l_returnflag END"


@query(f"""
WITH t AS (SELECT {BLANKED} AS flag, l_linestatus AS status FROM lineitem),
u AS (SELECT 'flag' AS column_name, flag AS v FROM t UNION ALL SELECT 'status', status FROM t)
SELECT column_name, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE trim(v) IN ('N/A', '', '-', 'NA'))::BIGINT AS n_missing,
       round(100.0::DOUBLE * count(*) FILTER (WHERE trim(v) IN ('N/A', '', '-', 'NA')) / count(*), 2) AS missing_pct
FROM u GROUP BY column_name""")
def agg_missing_values(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.expr(BLANKED).alias("flag"), F.col("l_linestatus").alias("status"))
    return profile.missing_values(lines, ["flag", "status"])


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(per_column(NUMBERS, """
SELECT '{c}' AS column_name, count({c})::BIGINT AS non_null, (count(*) - count({c}))::BIGINT AS nulls, count(DISTINCT {c})::BIGINT AS distinct_values,
       min({c}) AS min_value, max({c}) AS max_value, round(avg({c}), 4) AS mean_value, median({c}) AS median_value, round(stddev_samp({c}), 4) AS std_value
FROM lineitem"""))
def agg_column_stats(spark, sf_dir):
    return profile.numeric_profile(table(spark, sf_dir, "lineitem").select(*NUMBERS), NUMBERS)


@query(per_column(["text", "source"], """
SELECT '{c}' AS column_name, min(length({c}))::BIGINT AS min_length, max(length({c}))::BIGINT AS max_length, round(avg(length({c})), 2) AS avg_length FROM documents"""))
def agg_text_lengths(spark, sf_dir):
    return profile.text_lengths(table(spark, sf_dir, "documents").select("text", "source"), ["text", "source"])


@query("""
WITH u AS (SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders),
g AS (SELECT column_name, value, count(*)::BIGINT AS n FROM u WHERE value IS NOT NULL GROUP BY ALL)
SELECT *, place FROM (SELECT *, (row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value))::INT AS place FROM g) WHERE place <= 5""".replace("SELECT *, place FROM", "SELECT column_name, value, n, place FROM"))
def agg_top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("SELECT strftime(min(l_shipdate), '%Y-%m-%d') AS first_day, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day, count(DISTINCT l_shipdate::DATE)::BIGINT AS n_days FROM lineitem")
def agg_date_range(spark, sf_dir):
    return profile.date_range(table(spark, sf_dir, "lineitem"), "l_shipdate")


TYPED = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "flag", "nothing", "paid"]
WORDS = "'true','yes','y','1','on','enabled','false','no','n','0','off','disabled'"


def _typed_sql(named: str) -> str:
    return """
WITH t AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' WHEN o_orderkey % 3 = 1 THEN 'YES' ELSE ' no' END AS flag, CAST(NULL AS VARCHAR) AS nothing,
           CASE WHEN o_orderkey % 20 = 0 THEN 'n.a.' ELSE o_custkey::VARCHAR END AS paid FROM orders),
c AS (""" + per_column(TYPED, "SELECT '{c}' AS column_name, {c}::VARCHAR AS value FROM t") + f"""),
g AS (SELECT column_name, count(value) AS total, count(DISTINCT value) AS kinds, count(DISTINCT lower(trim(value))) AS word_kinds, bool_and(lower(trim(value)) IN ({WORDS})) AS wordy,
             count(*) FILTER (WHERE regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) / count(value) AS dated, count(*) FILTER (WHERE value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL) / count(value) AS other,
             bool_and(coalesce(try_cast(value AS DOUBLE) = floor(try_cast(value AS DOUBLE)), true)) AS whole FROM c GROUP BY column_name)
SELECT column_name, CASE WHEN total = 0 THEN 'unknown' WHEN word_kinds <= 2 AND wordy THEN 'boolean' WHEN {named} OR dated > 0.5 THEN 'date' WHEN other < 0.1 AND whole THEN 'integer' WHEN other < 0.1 THEN 'float'
       WHEN kinds / total < 0.5 AND kinds < 100 THEN 'categorical' ELSE 'text' END AS inferred_type, total::BIGINT AS non_null FROM g"""


def _typed(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "*", F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "YES").otherwise(" no").alias("flag"), F.lit(None).cast("string").alias("nothing"),
        F.when(k % 20 == 0, "n.a.").otherwise(F.col("o_custkey").cast("string")).alias("paid"),
    )


@query(_typed_sql("regexp_matches(column_name, 'date|time|dt|period|month|year|quarter|week|day|created|updated|modified|effective|expiry|start|end|from|to|as_of|asof|reporting|transaction|trade|settlement|maturity|issue|cal_')"))
def agg_infer_types(spark, sf_dir):
    return profile.infer_types(_typed(spark, sf_dir), TYPED)


@query(_typed_sql("false"))
def agg_infer_types_by_value(spark, sf_dir):
    return profile.infer_types(_typed(spark, sf_dir), TYPED, by_name=False)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def agg_dedup_rows(spark, sf_dir):
    return profile.deduplicated(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("""
WITH t AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS a, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS b FROM documents),
p AS (SELECT source, 100.0::DOUBLE * (count(*) - count(a)) / count(*) AS pa, 100.0::DOUBLE * (count(*) - count(b)) / count(*) AS pb FROM t GROUP BY source)
SELECT source, round(100 - (pa + pb) / 2, 2) AS completeness, CASE WHEN 100 - (pa + pb) / 2 >= 80 THEN 'HIGH' WHEN 100 - (pa + pb) / 2 >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p""")
def agg_completeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 3 != 0, F.lit(1)).alias("a"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("b"))
    return profile.completeness(docs, "source", ["a", "b"]).select("source", "completeness", compare.completeness_level(F.col("exact")).alias("level"))


SHEETS = """CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'success' END AS status, CASE doc_id % 6 WHEN 0 THEN 'structured' WHEN 1 THEN 'unstructured' WHEN 2 THEN 'semi_structured' WHEN 3 THEN 'unknown' WHEN 4 THEN 'empty' END AS structure"""


@query(f"""
WITH t AS (SELECT source, doc_id // 22 AS file_name, {SHEETS.replace('doc_id % 11', '(doc_id // 22) % 11')} FROM documents)
SELECT source, count(DISTINCT file_name)::BIGINT AS total_files, count(DISTINCT file_name) FILTER (WHERE status = 'success')::BIGINT AS successful, count(DISTINCT file_name) FILTER (WHERE status <> 'success')::BIGINT AS failed,
       count(structure) FILTER (WHERE status = 'success')::BIGINT AS sheets_processed, """ + ", ".join(f"count(*) FILTER (WHERE status = 'success' AND structure = '{k}')::BIGINT AS {k}" for k in ("structured", "unstructured", "semi_structured", "unknown", "empty")) + """
FROM t GROUP BY source""")
def agg_run_summary(spark, sf_dir):
    file = F.floor(F.col("doc_id") / 22)
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", file.alias("file_name"))
    return profile.run_summary(rows.selectExpr("source", "file_name", *[p.strip() for p in SHEETS.replace("doc_id % 11", "file_name % 11").split(", ", 1)]), "source")


@query("""
WITH g AS (SELECT n_nationkey, n_name, c_mktsegment, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_name, arg_min(c_mktsegment, (-n, c_mktsegment)) AS primary_kind, count(*)::BIGINT AS n_kinds, CASE WHEN count(*) = 1 THEN 'CONSISTENT' ELSE 'MIXED' END AS status FROM g GROUP BY n_name""".replace(
    "arg_min(c_mktsegment, (-n, c_mktsegment))", "min({'n': -n, 'k': c_mktsegment}).k"))
def join_structure_consistency(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return compare.consistency(customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")), "n_name", "c_mktsegment")


@query("""
SELECT n_name, count(c_custkey)::BIGINT AS customers, coalesce(round(100.0::DOUBLE * count(c_custkey) FILTER (WHERE c_acctbal > 5000) / nullif(count(c_custkey), 0), 4), 0) AS rich_pct
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def agg_coverage_pct(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"))
    out = table(spark, sf_dir, "nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.round(cleaning.safe_percentage(F.col("rich"), F.col("customers")), 4).alias("rich_pct"))


NAMED = "CASE WHEN p_partkey % 9 = 0 THEN '  ' WHEN p_partkey % 4 = 0 THEN concat(' ', p_brand, ' (', p_size, ') €/unit') ELSE concat(p_name, '  - ', p_type) END"


@query(rf"""
WITH t AS (SELECT p_partkey, {NAMED} AS raw FROM part),
u AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(raw), '[^\p{{L}}\p{{N}}_\s]', '_', 'g'), '[\s_]+', '_', 'g'), '^_+|_+$', '', 'g') AS x FROM t)
SELECT p_partkey, CASE WHEN x = '' THEN 'Column_' || p_partkey ELSE x END AS name FROM u""")
def prj_clean_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.column_name(F.expr(NAMED), F.col("p_partkey")).alias("name"))


DIRTY = "CASE WHEN event_id % 6 = 0 THEN ' NA ' WHEN event_id % 6 = 1 THEN '--' WHEN event_id % 6 = 2 THEN '   ' WHEN event_id % 6 = 3 THEN concat(' ', event_type, ' ') ELSE event_type END"


@query(f"SELECT event_id, CASE WHEN trim({DIRTY}) IN ('NA', '--', '') THEN NULL ELSE trim({DIRTY}) END AS event_type FROM events")
def prj_missing_to_null(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", cleaning.missing_to_null(F.expr(DIRTY)).alias("event_type"))


TEXTED = "CASE WHEN o_orderkey % 4 = 0 THEN concat(' ', CAST(o_custkey AS STRING), ' ') WHEN o_orderkey % 4 = 1 THEN o_orderpriority ELSE CAST(o_custkey AS STRING) END"


@query(f"SELECT o_orderkey, try_cast(trim({TEXTED}) AS BIGINT) AS as_integer, try_cast(trim({TEXTED}) AS DOUBLE) AS as_float FROM orders")
def prj_cast_types(spark, sf_dir):
    value = F.expr(TEXTED)
    return table(spark, sf_dir, "orders").select("o_orderkey", cleaning.apply_type(value, "integer").alias("as_integer"), cleaning.apply_type(value, "float").alias("as_float"))


WORDED = "CASE o_orderkey % 5 WHEN 0 THEN ' YES ' WHEN 1 THEN 'off' WHEN 2 THEN '1' WHEN 3 THEN 'Disabled' ELSE o_orderstatus END"


@query(f"SELECT o_orderkey, CASE WHEN lower(trim({WORDED})) IN ('yes', '1', 'true', 'on', 'y', 'enabled') THEN true WHEN lower(trim({WORDED})) IN ('off', 'disabled', 'no', 'n', '0', 'false') THEN false END AS flag FROM orders")
def prj_bool_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", cleaning.to_boolean(F.expr(WORDED)).alias("flag"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def prj_std_date(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "dd.MM.yyyy"))
        .when(k == 3, F.date_format(d, "d MMMM yyyy")).otherwise("no date")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.standard_date(text).alias("day"))


@query("SELECT l_orderkey, l_linenumber, round(coalesce(l_tax / nullif(l_discount, 0), 0), 4) AS ratio, round(coalesce(100 * l_discount / nullif(l_tax, 0), 0), 4) AS pct FROM lineitem")
def prj_safe_math(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(cleaning.safe_divide(F.col("l_tax"), F.col("l_discount")), 4).alias("ratio"),
        F.round(cleaning.safe_percentage(F.col("l_discount"), F.col("l_tax")), 4).alias("pct"),
    )


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'ISO (YYYY-MM-DD)' WHEN 1 THEN 'US (MM/DD/YYYY) or EU (DD/MM/YYYY)' WHEN 2 THEN 'Named month (DD Month YYYY)'
       WHEN 3 THEN 'Quarter (Q1-YYYY)' WHEN 4 THEN 'Compact (YYYYMMDD)' ELSE 'Custom/Unknown' END AS label FROM orders""")
def dt_format_label(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/dd/yyyy")).when(k == 2, F.date_format(d, "dd MMM yyyy"))
        .when(k == 3, F.concat(F.lit("Q"), F.quarter(d), F.lit("-"), F.year(d))).when(k == 4, F.date_format(d, "yyyyMMdd")).otherwise("n.d.")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.format_label(text).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 50000 < 60 THEN DATE '1899-12-31' + (p_partkey % 50000)::INT ELSE DATE '1899-12-30' + (p_partkey % 50000)::INT END AS day FROM part")
def dt_excel_serial(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", dates.excel_serial(F.col("p_partkey") % 50000).alias("day"))


@query("""
WITH g AS (SELECT o_orderpriority, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1)
SELECT *, year(first_day)::INT AS start_year, year(last_day)::INT AS end_year, 'Q' || quarter(first_day) || '-' || year(first_day) AS start_quarter, 'Q' || quarter(last_day) || '-' || year(last_day) AS end_quarter,
       date_diff('day', first_day, last_day)::INT AS span_days, (year(last_day) - year(first_day) + 1)::INT AS span_years,
       array_to_string(range(year(first_day), year(last_day) + 1), ',') AS fiscal_years FROM g""")
def dt_period_info(spark, sf_dir):
    found = metadata.period_info(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate")
    return found.withColumn("fiscal_years", F.array_join(F.col("fiscal_years").cast("array<string>"), ","))


@query("""
WITH d AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day FROM orders),
g AS (SELECT o_custkey, day, date_diff('day', day, lead(day) OVER (PARTITION BY o_custkey ORDER BY day)) AS gap FROM d),
s AS (SELECT o_custkey, min(gap) AS least FROM g GROUP BY 1),
n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN n < 2 THEN 'unknown' WHEN least IS NULL THEN 'unknown' WHEN least <= 1 THEN 'daily' WHEN least <= 7 THEN 'weekly' WHEN least <= 31 THEN 'monthly'
       WHEN least <= 92 THEN 'quarterly' ELSE 'yearly' END AS granularity FROM s JOIN n USING (o_custkey)""")
def dt_granularity(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    gap = F.datediff(F.lead("day").over(Window.partitionBy("o_custkey").orderBy("day")), F.col("day"))
    g = days.withColumn("gap", gap).groupBy("o_custkey").agg(F.sum("n").alias("n"), F.min("gap").alias("least"))
    return g.select("o_custkey", dates.granularity(F.lit(False), F.col("n"), F.col("least")).alias("granularity"))


@query("""
WITH d AS (SELECT user_id, ts::DATE AS day, bool_or(ts <> date_trunc('day', ts)) AS timed, count(*) AS n FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN date_trunc('day', ts) ELSE ts END AS ts FROM events) GROUP BY 1, 2),
g AS (SELECT *, date_diff('day', day, lead(day) OVER (PARTITION BY user_id ORDER BY day)) AS gap FROM d),
s AS (SELECT user_id, bool_or(timed) AS timed, sum(n) AS n, min(gap) AS least FROM g GROUP BY 1)
SELECT user_id, CASE WHEN n < 2 THEN 'unknown' WHEN timed THEN 'datetime' WHEN least IS NULL THEN 'unknown' WHEN least <= 1 THEN 'daily' WHEN least <= 7 THEN 'weekly' WHEN least <= 31 THEN 'monthly' ELSE 'quarterly' END AS granularity FROM s""")
def dt_granularity_times(spark, sf_dir):
    ts = F.when(F.col("user_id") % 2 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    days = table(spark, sf_dir, "events").select("user_id", ts.alias("ts")).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.bool_or(F.col("ts") != F.date_trunc("day", "ts")).alias("timed"), F.count("*").alias("n"))
    gap = F.datediff(F.lead("day").over(Window.partitionBy("user_id").orderBy("day")), F.col("day"))
    g = days.withColumn("gap", gap).groupBy("user_id").agg(F.bool_or("timed").alias("timed"), F.sum("n").alias("n"), F.min("gap").alias("least"))
    return g.select("user_id", dates.granularity(F.col("timed"), F.col("n"), F.col("least")).alias("granularity"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'FY' || (2000 + c_custkey % 30) || '-' || (2000 + c_custkey % 30 + 2) WHEN 1 THEN 'FY' || (2010 + c_custkey % 7) WHEN 2 THEN 'FY' || (11 + c_custkey % 7) || ', FY 19' ELSE 'historical period' END AS periods FROM customer""")
def dt_text_periods(spark, sf_dir):
    k = F.col("c_custkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("accounts of "), 2000 + k % 30 + 2, F.lit(" and "), 2000 + k % 30, F.lit(".")))
        .when(k % 4 == 1, F.concat(F.lit("the year "), 2010 + k % 7)).when(k % 4 == 2, F.concat(F.lit("FY"), 11 + k % 7, F.lit(" to FY 19"))).otherwise("all periods")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", dates.text_periods(text).alias("periods"))


ENTITY = "concat(c_name, CASE c_custkey % 5 WHEN 0 THEN ' Bank' WHEN 1 THEN ' Capital' WHEN 2 THEN ' Ltd' WHEN 3 THEN ' Company' ELSE ' Trading' END)"


@query("SELECT CASE c_custkey % 5 WHEN 0 THEN 'banks' WHEN 1 THEN 'funds' WHEN 2 THEN 'companies' WHEN 3 THEN 'companies' ELSE 'others' END AS kind, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def ent_classify(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(terms.entity_kind(F.expr(ENTITY)).alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT n_name, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9500) AS present FROM nation WHERE n_regionkey < 3""")
def join_entity_coverage(spark, sf_dir):
    required = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("key"), "n_name")
    found = table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("key"))
    return compare.coverage(required, found, "key").select("n_name", "present")


@query("SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 8000)")
def join_entity_missing(spark, sf_dir):
    found = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(found, "n_nationkey", "left_anti").select("n_name")


@query("""
WITH r AS (SELECT o_orderpriority, y FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT unnest(range(1994, 2003)) AS y)),
f AS (SELECT DISTINCT o_orderpriority, year(o_orderdate) AS y FROM orders)
SELECT r.o_orderpriority, count(*)::BIGINT AS n_required, count(f.y)::BIGINT AS n_present,
       CASE WHEN count(f.y) >= count(*) THEN 'FULL' WHEN count(f.y) > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS coverage_level
FROM r LEFT JOIN f ON r.o_orderpriority = f.o_orderpriority AND r.y = f.y GROUP BY 1""")
def join_year_coverage(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y")).distinct()
    required = found.select("o_orderpriority").distinct().withColumn("y", F.explode(F.sequence(F.lit(1994), F.lit(2002))))
    both = required.join(found.withColumn("hit", F.lit(1)), ["o_orderpriority", "y"], "left").groupBy("o_orderpriority").agg(F.count("*").alias("n_required"), F.count("hit").alias("n_present"))
    return both.withColumn("coverage_level", compare.coverage_level(F.col("n_required"), F.col("n_present")))


@query("SELECT p_brand, max(p_size)::INT AS version, max({'v': p_size, 'k': p_partkey}).k AS p_partkey FROM part GROUP BY p_brand")
def join_latest_version(spark, sf_dir):
    return compare.latest_version(table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("int").alias("version"), "p_partkey"), "p_brand", "version")


@query("""
SELECT p_partkey, CASE WHEN k = 0 THEN p_type ELSE p_type || '_' || k END AS unique_name FROM (
  SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS k FROM part)""")
def win_dedup_numbering(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return compare.numbered_duplicates(parts, "p_type", ["p_partkey"], ["p_brand"]).select("p_partkey", "unique_name")


@query("""
SELECT o_orderkey, least(floor(r / greatest(1, n // 4)), 3)::BIGINT AS section FROM (
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def win_bucketing(spark, sf_dir):
    return compare.dealt_evenly(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 4, ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "section")


CELL = "CASE o_orderkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN CAST(o_custkey AS STRING) WHEN 2 THEN 'due 3/4/2021' WHEN 3 THEN '2021-03-04' ELSE o_orderpriority END"


@query("SELECT CASE o_orderkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'number' WHEN 2 THEN 'date' WHEN 3 THEN 'date' ELSE 'text' END AS cell_type, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def str_cell_types(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(cleaning.cell_type(F.expr(CELL)).alias("cell_type")).agg(F.count("*").alias("n"))


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("""
WITH c AS (""" + per_column(PROFILED, "SELECT '{c}' AS column_name, {c}::VARCHAR AS value FROM orders") + """),
g AS (SELECT column_name, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL OR trim(value) IN ('', 'N/A', 'n/a', 'NA', 'null', 'NULL', 'None', 'NONE', '-', '--', '---')) AS n_missing, count(value) AS non_null, count(DISTINCT value) AS kinds FROM c GROUP BY 1)
SELECT column_name, n_rows::BIGINT AS n_rows, n_missing::BIGINT AS n_missing, round(100.0::DOUBLE * n_missing / n_rows, 2) AS missing_pct,
       CASE WHEN column_name IN ('o_orderdate', 'o_totalprice') THEN 'date' WHEN column_name LIKE '%key' THEN 'integer' WHEN kinds / non_null < 0.5 AND kinds < 100 THEN 'categorical' ELSE 'text' END AS inferred_type, non_null::BIGINT AS non_null FROM g""")
def column_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "orders"))
