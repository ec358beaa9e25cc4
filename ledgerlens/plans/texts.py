"""Queries of requirement, scope and request texts, names and dates in texts, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import dates, entities, scope, terms
from ledgerlens.operators import metadata, requests, requirements
from ledgerlens.plans.registry import query, table
from ledgerlens.store import dealt

# ---- requirements

ASK = (
    "concat('Provide the ', CASE p_partkey % 3 WHEN 0 THEN 'Revenue and Debt' WHEN 1 THEN 'Balance Sheet' ELSE 'inventory aging' END, ' schedule of the ', "
    "CASE p_partkey % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'Lender and issuer' WHEN 2 THEN 'portfolio of Delta Holdings' ELSE 'Company' END, ' for FY', CAST(2010 + p_size % 10 AS STRING), ' a) ', p_name, ', b) ', p_type)"
)
ASKED = f"WITH t AS (SELECT p_partkey, p_brand, {ASK} AS x FROM part)"
DATA_SQL = "list_concat(regexp_extract_all(x, '(?i)\\b(revenue|debt)\\b', 1), regexp_extract_all(x, '(?i)\\b(balance sheet)\\b', 1), regexp_extract_all(x, '(?i)\\b(inventory|aging|schedule)\\b', 1))"
WORD_SQL = "regexp_extract_all(x, '(?i)\\b(schedule|provide)\\b', 1)"
ENTITY_SQL = "list_concat(regexp_extract_all(x, '(?i)\\b(bank|lender|issuer|portfolio|holdings?|company)\\b', 1))"
# the pattern of names is case-insensitive, so it runs from the first letter to the last business word
NAME_SQL = (
    "CASE p_partkey % 4 WHEN 0 THEN [lower(split_part(x, ' for FY', 1)), 'bank'] WHEN 1 THEN ['lender', 'issuer'] "
    "WHEN 2 THEN [lower(split_part(x, ' for FY', 1)), 'portfolio'] ELSE [lower(split_part(x, ' for FY', 1)), 'company'] END"
)


def _asked(spark, sf_dir):
    """Parts dealt to all tasks, since a small file is read by one and its requirements cost far more than reading it."""
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr(ASK).alias("x")), "p_partkey")


def _listed(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_transform({x}, lambda v: lower(trim(v))))), ',')"


@query(f"{ASKED} SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(x, '(?i)[a-z]\\)\\s*([^,\\n]+)', 1), lambda v: trim(v)), '|') AS files FROM t")
def req_file_refs(spark, sf_dir):
    return _asked(spark, sf_dir).select("p_partkey", F.array_join(terms.file_references(F.col("x")), "|").alias("files"))


@query(f"{ASKED} SELECT p_partkey, {_listed(DATA_SQL)} AS data_types FROM t")
def req_data_types(spark, sf_dir):
    return _asked(spark, sf_dir).select("p_partkey", F.array_join(terms.found_terms(F.col("x"), terms.DATA_TERMS), ",").alias("data_types"))


@query(f"{ASKED} SELECT p_partkey, {_listed(WORD_SQL)} AS keywords FROM t")
def req_keywords(spark, sf_dir):
    return _asked(spark, sf_dir).select("p_partkey", F.array_join(terms.found_terms(F.col("x"), terms.KEYWORDS), ",").alias("keywords"))


@query(f"{ASKED} SELECT p_partkey, array_to_string(list_sort({NAME_SQL}), ',') AS entities FROM t")
def req_entities(spark, sf_dir):
    return _asked(spark, sf_dir).select("p_partkey", F.array_join(terms.found_terms(F.col("x"), terms.ENTITY_TERMS), ",").alias("entities"))


SPAN = (
    "concat('Accounts of 20', lpad(CAST(p_size AS STRING), 2, '0'), ' to 2060, ', CASE p_partkey % 4 WHEN 0 THEN 'Q3-2021 and q1 2022' WHEN 1 THEN 'March 2020, may' WHEN 2 THEN 'the prior year and last  month' "
    "ELSE '3 years as of June 30, 2024' END, ', FY2019')"
)


@query(f"""
WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, '20' || lpad(p_size::VARCHAR, 2, '0') AS y FROM part),
m AS (
  SELECT p_partkey, 'year' AS kind, unnest(CASE k WHEN 0 THEN [y, '2060', '2021', '2022'] WHEN 1 THEN [y, '2060', '2020'] WHEN 2 THEN [y, '2060'] ELSE [y, '2060', '2024'] END) AS raw FROM t
  UNION ALL SELECT p_partkey, 'year_range', y || ' 2060' FROM t
  UNION ALL SELECT p_partkey, 'quarter', unnest(['3 2021', '1 2022']) FROM t WHERE k = 0
  UNION ALL SELECT p_partkey, 'month', unnest(['March 2020', 'may']) FROM t WHERE k = 1
  UNION ALL SELECT p_partkey, 'relative', unnest(['prior year', 'last month']) FROM t WHERE k = 2
  UNION ALL SELECT p_partkey, 'multi_year', '3' FROM t WHERE k = 3
  UNION ALL SELECT p_partkey, 'month', 'June' FROM t WHERE k = 3
  UNION ALL SELECT p_partkey, 'as_of_date', 'June 30, 2024' FROM t WHERE k = 3
  UNION ALL SELECT p_partkey, 'fiscal_year', '2019' FROM t)
SELECT p_partkey, kind, raw FROM m""")
def req_periods(spark, sf_dir):
    found = F.explode(terms.period_mentions(F.expr(SPAN)))
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", found.alias("p")).select("p_partkey", "p.kind", "p.raw")


COMPLEXITY = f"""
WITH t AS (SELECT p_partkey, p_brand, {ASK} AS x, p_size FROM part),
n AS (SELECT *, 2.0 * 2 + len({NAME_SQL}) + 3.0 * 1 + 0.5 * len(list_distinct(list_transform({WORD_SQL}, lambda v: lower(v)))) AS s FROM t)"""


@query(COMPLEXITY + " SELECT p_partkey, s::DOUBLE AS score, CASE WHEN s <= 5 THEN 'simple' WHEN s <= 15 THEN 'moderate' ELSE 'complex' END AS complexity FROM n")
def req_complexity(spark, sf_dir):
    return _asked(spark, sf_dir).select("p_partkey", terms.requirement(F.col("x")).alias("r")).select("p_partkey", F.col("r.score").cast("double").alias("score"), "r.complexity")


def _requirements(spark, sf_dir):
    return _asked(spark, sf_dir).select("p_brand", terms.requirement(F.col("x")).alias("r"))


@query(f"""{ASKED},
f AS (SELECT p_brand, unnest(list_transform(regexp_extract_all(x, '(?i)[a-z]\\)\\s*([^,\\n]+)', 1), lambda v: trim(v))) AS v FROM t),
e AS (SELECT p_brand, unnest({NAME_SQL}) AS v FROM t),
p AS (SELECT p_brand, unnest(regexp_extract_all(x, 'FY(20[0-9][0-9])', 1)) AS v FROM t),
a AS (SELECT 'file' AS kind, * FROM f UNION ALL SELECT 'entity', * FROM e UNION ALL SELECT 'period', * FROM p)
SELECT p_brand, kind, count(DISTINCT v)::BIGINT AS n, min(v) AS first_one, max(v) AS last_one FROM a GROUP BY ALL""")
def req_template(spark, sf_dir):
    found = requirements.template(_requirements(spark, sf_dir), ["p_brand"], "r")
    return found.groupBy("p_brand", "kind").agg(F.count("*").alias("n"), F.min("value").alias("first_one"), F.max("value").alias("last_one"))


@query(f"""{ASKED},
d AS (SELECT p_brand, unnest(list_transform(list_concat({DATA_SQL}, {WORD_SQL}), lambda v: lower(v))) AS v FROM t)
SELECT p_brand, bool_or(v IN ('revenue')) AS should_have_financials, array_to_string(list_sort(list_distinct(list(v))), ',') AS expected_columns FROM d GROUP BY 1""")
def req_expectations(spark, sf_dir):
    return requirements.expectations(_requirements(spark, sf_dir), ["p_brand"], "r").withColumn("expected_columns", F.array_join("expected_columns", ","))


# ---- scopes

AREAS = ["Quality of Earnings Analysis", "Working Capital Management", "Tax Matters", "Capital Structure & Debt Analysis", "Contingent Liabilities"]
SCOPE = (
    "concat_ws(chr(10), 'FINANCIAL DUE DILIGENCE SCOPE OF WORK', concat('Company: ', n_name, ' Holdings'), 'FY 2021-22 and FY2022-2023, March 31, 2023', '', '| Analysis Area | Detailed Procedures |', '|-----|-----|', "
    f"concat('| **{AREAS[0]}** | 1. Review top 20 customers of ', n_name, ' 2. Assess debt |'), '| **{AREAS[1]}** | 1. Check ageing', concat('2. Check ', CAST(n_nationkey AS STRING), ' stores'), '3. Check cash |', "
    f"CASE WHEN n_regionkey < 3 THEN '| **{AREAS[2]}** | 1. List filings |' ELSE '| **{AREAS[3]}** | 1. List loans over 100 2. List rates |' END, '', 'closing words')"
)
SECTIONED = f"""
WITH s AS (
  SELECT n_nationkey, 1 AS ord, '{AREAS[0]}' AS name, ['Review top 20 customers of ' || n_name, 'Assess debt'] AS p FROM nation
  UNION ALL SELECT n_nationkey, 2, '{AREAS[1]}', ['Check ageing', 'Check ' || n_nationkey || ' stores', 'Check cash'] FROM nation
  UNION ALL SELECT n_nationkey, 3, CASE WHEN n_regionkey < 3 THEN '{AREAS[2]}' ELSE '{AREAS[3]}' END, CASE WHEN n_regionkey < 3 THEN ['List filings'] ELSE ['List loans over 100', 'List rates'] END FROM nation)"""


def _sections(spark, sf_dir):
    return requests.scope_sections(table(spark, sf_dir, "nation").select("n_nationkey", F.expr(SCOPE).alias("text")), "n_nationkey", "text")


@query(SECTIONED + """
SELECT n_nationkey, ord::BIGINT AS ord, name, array_to_string(list_transform(p, lambda x, i: i || '. ' || x), ' ') AS procedures, CASE ord WHEN 1 THEN 'High' WHEN 2 THEN 'High' ELSE CASE WHEN name LIKE 'Capital%' THEN 'Medium' ELSE 'Low' END END AS priority FROM s""")
def txt_sections(spark, sf_dir):
    return _sections(spark, sf_dir)


@query(SECTIONED + " SELECT n_nationkey, ord::BIGINT AS ord, name, unnest(p) AS text, generate_subscripts(p, 1)::BIGINT AS proc_no FROM s")
def txt_procedures(spark, sf_dir):
    return requests.procedures(_sections(spark, sf_dir), "n_nationkey")


@query(SECTIONED + ", u AS (SELECT n_nationkey, ord, unnest(p) AS text FROM s) SELECT n_nationkey, count(DISTINCT ord)::BIGINT AS n_sections, count(*)::BIGINT AS n_procedures FROM u GROUP BY 1")
def agg_scope_totals(spark, sf_dir):
    return requests.scope_totals(requests.procedures(_sections(spark, sf_dir), "n_nationkey"), "n_nationkey")


@query(SECTIONED + """,
u AS (SELECT n_nationkey, ord, name, unnest(p) AS text, generate_subscripts(p, 1) AS k FROM s),
c AS (SELECT * FROM u WHERE text LIKE 'Check%' OR text LIKE 'List rates')
SELECT n_nationkey, ord::BIGINT AS ord, name, text, row_number() OVER (PARTITION BY n_nationkey, ord ORDER BY k)::BIGINT AS proc_no FROM c""")
def sel_procedures(spark, sf_dir):
    found = requests.procedures(_sections(spark, sf_dir), "n_nationkey")
    return requests.selected(found, found.where("text LIKE 'Check%' OR text = 'List rates'"), "n_nationkey")


@query(SECTIONED + """,
u AS (SELECT n_nationkey, ord, name, unnest(p) AS text, generate_subscripts(p, 1) AS k FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey, ord ORDER BY k) AS no FROM u WHERE k > 1),
r AS (SELECT n_nationkey, ord, '| **' || name || '** | ' || string_agg(no || '. ' || text, chr(10) ORDER BY no) || ' |' AS row FROM c GROUP BY n_nationkey, ord, name)
SELECT n_nationkey, '| Analysis Area | Detailed Procedures |' || chr(10) || '|--------------|-------------------|' || chr(10) || string_agg(row, chr(10) ORDER BY ord) AS text FROM r GROUP BY 1""")
def sel_scope_text(spark, sf_dir):
    found = requests.procedures(_sections(spark, sf_dir), "n_nationkey")
    return requests.selected_scope(requests.selected(found, found.where("proc_no > 1"), "n_nationkey"), "n_nationkey")


@query(SECTIONED + """
SELECT n_nationkey, count(*)::BIGINT AS total_areas, (count(*) * 5)::BIGINT AS estimated_requests, sum(CASE WHEN name LIKE '%Earnings%' THEN 6 WHEN name LIKE '%Working Capital%' THEN 5 ELSE 4 END)::BIGINT AS focus_requests,
       'focused' AS scope_type, 'revenue' AS scope_kind, 4000 AS tokens FROM s GROUP BY 1""")
def txt_scope_analysis(spark, sf_dir):
    return requests.scope_analysis(_sections(spark, sf_dir), "n_nationkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey <= 3 THEN 4000 WHEN n_nationkey <= 8 THEN 6000 WHEN n_nationkey <= 12 THEN 7000 ELSE 8000 END AS tokens, CASE WHEN n_nationkey > 10 THEN 'comprehensive' ELSE 'focused' END AS scope_type FROM nation")
def txt_token_budget(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", scope.token_budget(n).alias("tokens"), scope.scope_type(n).alias("scope_type"))


KINDS = "CASE n_nationkey % 5 WHEN 0 THEN array('Tax', 'Cash Flow Analysis') WHEN 1 THEN array('Customer Analysis') WHEN 2 THEN array('Fixed Assets') WHEN 3 THEN array_repeat('Tax', 9) ELSE array('Tax', 'Risk') END"


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'working capital' WHEN 1 THEN 'revenue' WHEN 2 THEN 'balance sheet' WHEN 3 THEN 'comprehensive' ELSE 'focused' END AS scope_kind FROM nation")
def txt_scope_kind(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", scope.scope_kind(F.expr(KINDS)).alias("scope_kind"))


@query("SELECT n_nationkey, '2022-2023' AS current_year, '2021-22' AS previous_year, 'March 31, 2023' AS balance_sheet_date FROM nation")
def dt_scope_periods(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", dates.scope_periods(F.expr(SCOPE)).alias("p")).select("n_nationkey", "p.*")


NAMED = "CASE p_partkey % 6 WHEN 0 THEN 'Quality of Earnings' WHEN 1 THEN 'Working Capital review' WHEN 2 THEN 'Tax matters' WHEN 3 THEN 'Debt and cash' WHEN 4 THEN 'Operational cost' ELSE 'Other (Priority: High)' END"


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'REVENUE ANALYSIS' WHEN 1 THEN 'WORKING CAPITAL MANAGEMENT' WHEN 2 THEN 'TAX MATTERS' WHEN 3 THEN 'CASH FLOW ANALYSIS' WHEN 4 THEN 'OPERATIONAL ANALYSIS' ELSE 'OTHER' END AS section,
       CASE p_partkey % 6 WHEN 3 THEN 'High' WHEN 4 THEN 'Medium' ELSE 'Low' END AS priority, CASE p_partkey % 6 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Low' END AS sheet_priority,
       '**' || CASE p_partkey % 6 WHEN 0 THEN 'QUALITY OF EARNINGS' WHEN 1 THEN 'WORKING CAPITAL REVIEW' WHEN 2 THEN 'TAX MATTERS' WHEN 3 THEN 'DEBT AND CASH' WHEN 4 THEN 'OPERATIONAL COST' ELSE 'OTHER' END || '**' AS header FROM part""")
def txt_section_map(spark, sf_dir):
    x = F.expr(NAMED)
    return table(spark, sf_dir, "part").select("p_partkey", terms.request_section(x).alias("section"), terms.request_priority(x).alias("priority"), scope.sheet_priority(x).alias("sheet_priority"), scope.section_header(x).alias("header"))


TOLD = "CASE p_partkey % 5 WHEN 0 THEN 'Retail stores with a LOSS and negative cash' WHEN 1 THEN 'software house, revenue decline, cash a concern' WHEN 2 THEN 'medical goods, no debt, an asset' WHEN 3 THEN 'cash flow of a pharma firm' ELSE 'nothing told' END"


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'retail' WHEN 1 THEN 'technology' WHEN 2 THEN 'manufacturing' WHEN 3 THEN 'healthcare' ELSE 'general' END AS industry,
       CASE p_partkey % 5 WHEN 0 THEN 'profitability,cash flow' WHEN 1 THEN 'revenue trends,cash flow' WHEN 2 THEN 'debt structure' ELSE 'general business risks' END AS risks,
       CASE WHEN p_partkey % 5 < 2 THEN 'Medium' ELSE 'Standard' END AS complexity,
       p_partkey % 5 = 1 AS has_revenue_data, p_partkey % 5 = 2 AS has_balance_sheet, p_partkey % 5 = 3 AS has_cashflow FROM part""")
def txt_industry(spark, sf_dir):
    x = F.expr(TOLD)
    return table(spark, sf_dir, "part").select(
        "p_partkey", terms.industry(x).alias("industry"), F.array_join(terms.risk_areas(x), ",").alias("risks"), scope.complexity_of_risks(terms.risk_areas(x)).alias("complexity"), scope.content_flags(x).alias("f"),
    ).select("p_partkey", "industry", "risks", "complexity", "f.*")


@query("""
SELECT n_nationkey, 'FINANCIAL DUE DILIGENCE SCOPE OF WORK' || chr(10) || repeat('=', 50) || chr(10) || 'Company: ' || n_name || chr(10) || 'Generated: March 05, 2024' || chr(10) || chr(10) || 'SCOPE SUMMARY' || chr(10) || repeat('-', 20) || chr(10)
       || 'Analysis Areas: ' || n_regionkey || chr(10) || 'Estimated Hours: 350' || chr(10) || 'Complexity Level: ' || CASE WHEN n_nationkey % 5 > 3 THEN 'High' WHEN n_nationkey % 5 > 1 THEN 'Medium' ELSE 'Standard' END || chr(10) || chr(10) || 'body' AS text FROM nation""")
def txt_scope_document(spark, sf_dir):
    risks = F.array_repeat(F.lit("r"), F.col("n_nationkey") % 5)
    return table(spark, sf_dir, "nation").select("n_nationkey", scope.scope_document(F.col("n_name"), F.lit("2024-03-05").cast("date"), F.col("n_regionkey"), risks, F.lit("body")).alias("text"))


@query("""
SELECT n_nationkey, 'Head' || chr(10) || '| **' || n_name || '** | 1. first' || chr(10) || '2. second of ' || n_regionkey || chr(10) || '3. third |' || chr(10) || '| plain | 1. whole |' || chr(10) || 'a' || chr(10) || 'b' AS text FROM nation""")
def txt_br_repair(spark, sf_dir):
    text = "concat_ws(chr(10), 'Head', concat('| **', n_name, '** | 1. first<br>second of ', CAST(n_regionkey AS STRING), '<br> <br>7. third |'), '| plain | 1. whole |', 'a<br>b')"
    return table(spark, sf_dir, "nation").select("n_nationkey", scope.repaired_breaks(F.expr(text)).alias("text"))


ANSWER = (
    "CASE event_id % 5 WHEN 0 THEN concat('{\"overall_compliance\": {\"status\": \"', event_type, '\", \"confidence_score\": 0.75}, \"recommendations\": []}') WHEN 1 THEN concat('Here it is: {\"overall_compliance\": {\"status\": \"PARTIAL\"}, \"n\": ', CAST(event_id AS STRING), '} thanks') "
    "WHEN 2 THEN 'no answer' WHEN 3 THEN '{\"broken\": ' ELSE NULL END"
)


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'whole' WHEN 1 THEN 'part' ELSE 'fallback' END AS source, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS status,
       CASE event_id % 5 WHEN 0 THEN 0.75 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence, CASE event_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE 7 END AS n_missing FROM events""")
def txt_json_fallback(spark, sf_dir):
    v = F.col("a.verdict")
    return table(spark, sf_dir, "events").select("event_id", scope.readable_verdict(F.expr(ANSWER)).alias("a")).select(
        "event_id", "a.source", scope.verdict_status(v).alias("status"), scope.verdict_confidence(v).alias("confidence"), F.size(scope.missing_parts(v)).alias("n_missing"))


@query("""
SELECT event_type, 'Overall Status: ' || event_type || chr(10) || 'Confidence Score: 0.50' || chr(10) || 'Files Submitted: ' || n || chr(10) || 'Files Expected: 7' || chr(10) || 'Missing Files: 0' AS text
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def txt_verdict_summary(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", scope.verdict_summary(F.col("event_type"), F.lit(0.5), F.col("n"), F.lit(7), F.lit(0)).alias("text"))


# ---- requests

ANSWERED = (
    "concat_ws(chr(10), '**INTRO**', 'lost words', concat('1. (a) Revenue by ', c_mktsegment), '(b) Contracts', 'that go on (Priority: Low)', '(f) Format (Priority: High)', '', 'Continue with the rest', concat('2. Stock of ', c_name), '(g) left out', "
    "'(c) Operational view', '**OTHER**', 'after a header', '3. Plain (Priority: Medium)', 'Generates income')"
)
ASSEMBLED = """
WITH r AS (
  SELECT c_custkey, 1.0 AS ord, '1' AS id, concat_ws(chr(10), '(a) Revenue by ' || c_mktsegment, '(b) Contracts', 'that go on', '(f) Format') AS info_request, 'High' AS priority FROM customer
  UNION ALL SELECT c_custkey, 2.0, '2', concat_ws(chr(10), 'Stock of ' || c_name, '(c) Operational view'), 'Medium' FROM customer
  UNION ALL SELECT c_custkey, 3.0, '3', concat_ws(chr(10), 'Plain', 'Generates income'), 'Medium' FROM customer)"""


def _requests(spark, sf_dir):
    return requests.requests(table(spark, sf_dir, "customer").select("c_custkey", F.expr(ANSWERED).alias("text")), "c_custkey", "text")


@query(ASSEMBLED + " SELECT c_custkey, ord::DOUBLE AS ord, id, info_request, priority FROM r")
def win_request_assembly(spark, sf_dir):
    return _requests(spark, sf_dir)


@query("SELECT c_custkey, 3::BIGINT AS n_requests FROM customer")
def agg_request_count(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", requests.request_count(F.expr(ANSWERED)).alias("n_requests"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS priority, CASE p_partkey % 4 WHEN 0 THEN 'first and last' WHEN 1 THEN 'bank letters' WHEN 2 THEN p_name ELSE 'none' END AS text FROM part""")
def txt_priority(spark, sf_dir):
    x = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'first (Priority: High) and last (Priority:  Low)' WHEN 1 THEN 'bank letters' WHEN 2 THEN p_name ELSE 'none' END")
    old = F.expr("CASE WHEN p_partkey % 4 IN (0, 2) THEN 'Medium' ELSE '' END")
    return table(spark, sf_dir, "part").select("p_partkey", requests.priority_of(x, old).alias("priority"), requests.without_priority(x).alias("text"))


def _headed(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.expr(f"array(struct(1L AS ord, '{AREAS[0]}' AS name), struct(2L AS ord, '{AREAS[2]}' AS name))")).alias("s")).select("c_custkey", "s.*")
    return requests.with_headers(_requests(spark, sf_dir), names, "c_custkey")


HEADED = ASSEMBLED + """,
h AS (SELECT * FROM r UNION ALL SELECT c_custkey, 0.5, '', '**REVENUE ANALYSIS**', '' FROM customer UNION ALL SELECT c_custkey, 1.5, '', '**TAX MATTERS**', '' FROM customer)"""


@query(HEADED + " SELECT c_custkey, ord::DOUBLE AS ord, id, info_request, priority FROM h")
def txt_header_injection(spark, sf_dir):
    return _headed(spark, sf_dir)


@query(HEADED + """
SELECT c_custkey, 1::BIGINT AS item, 'REVENUE ANALYSIS' AS section, concat_ws(chr(10), '(a) Revenue by ' || c_mktsegment, '(b) Contracts', '(f) Format') AS requirement, 'High' AS priority FROM customer
UNION ALL SELECT c_custkey, 2, 'TAX MATTERS', '(c) Operational view', 'Low' FROM customer""")
def txt_request_rollup(spark, sf_dir):
    return requests.section_sheet(_headed(spark, sf_dir), "c_custkey")


@query(HEADED + """
SELECT c_custkey, ord::DOUBLE AS ord, id, CASE WHEN ord < 1.5 THEN 'REVENUE ANALYSIS' ELSE 'TAX MATTERS' END AS section FROM h WHERE id <> ''""")
def win_forward_fill(spark, sf_dir):
    return requests.in_sections(_headed(spark, sf_dir), "c_custkey").select("c_custkey", "ord", "id", "section")


@query(SECTIONED + """
SELECT n_nationkey, ord::DOUBLE AS ord, ord::VARCHAR AS id, CASE ord WHEN 1 THEN 'Revenue analysis and supporting documentation for ' || lower(name) || ':' || chr(10) || '(a) Monthly revenue breakdown by customer' || chr(10) || '(b) Customer contracts and terms' || chr(10) || '(c) Revenue recognition policies'
       WHEN 2 THEN 'Working capital components for ' || lower(name) || ':' || chr(10) || '(a) Inventory aging analysis' || chr(10) || '(b) Trade receivables aging' || chr(10) || '(c) Trade payables analysis'
       ELSE 'Supporting documentation for ' || lower(name) || ' analysis' END AS info_request, CASE WHEN ord < 3 THEN 'High' ELSE 'Medium' END AS priority FROM s""")
def txt_stock_requests(spark, sf_dir):
    return requests.stock_requests(_sections(spark, sf_dir), "n_nationkey")


@query("""
SELECT *, floor((row_number() OVER (PARTITION BY n_regionkey ORDER BY ord) - 1) / 4)::BIGINT AS chunk FROM (SELECT n_regionkey, n_nationkey AS ord, n_name FROM nation)""")
def win_chunks(spark, sf_dir):
    return requests.chunked(table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("ord"), "n_name"), "n_regionkey")


@query("""
WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, lang, n::BIGINT AS n, (coalesce(sum(n) OVER (PARTITION BY source ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_number FROM n""")
def win_running_offset(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return requests.running_numbers(n, "source", "lang", "n")


# ---- names

@query("""
SELECT column_name, regexp_matches(lower(column_name), 'date|time|dt|period|month|year|quarter|week|day|created|updated|modified|effective|expiry|start|end|from|to|as_of|asof|reporting|transaction|trade|settlement|maturity|issue|cal_') AS is_date,
       regexp_matches(lower(column_name), 'company|corporation|firm|entity|org|client|customer|vendor|supplier|partner|investor|fund|bank|issuer|borrower|lender|counterparty|name|party|account|holder|owner|beneficiary|sponsor|manager|advisor|trustee|custodian|underwriter|broker|dealer|agent|principal|portfolio|subsidiary|affiliate|parent|group') AS is_entity
FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS column_name FROM documents) WHERE column_name <> ''""")
def dt_is_date_name(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("column_name")).where("column_name <> ''").distinct()
    return words.select("column_name", dates.is_date_name(F.col("column_name")).alias("is_date"), entities.is_entity_name(F.col("column_name")).alias("is_entity"))


NAMING = (
    "concat('Paid by ', CASE c_custkey % 5 WHEN 0 THEN 'Alpha  Beta - Gamma Ltd' WHEN 1 THEN 'ACME' WHEN 2 THEN 'the North Wind' WHEN 3 THEN 'BlueSky' ELSE 'nobody' END, ', ', CAST(c_custkey AS STRING), ' and IBM')"
)


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'IBM|Paid by Alpha Beta-Gamma Ltd' ELSE CASE WHEN c_custkey % 5 = 1 THEN 'ACME|IBM' ELSE 'IBM' END END AS entities FROM customer""")
def ent_extract(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(entities.extract_entities(F.expr(NAMING)), "|").alias("entities"))


CAPS = "SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z]{2,}$')) AS caps FROM documents"


@query(f"""
WITH c AS ({CAPS}), e AS (SELECT doc_id, source, unnest(list_distinct(caps)) AS name FROM c),
k AS (SELECT source, name FROM e WHERE lower(name) NOT IN ('the','and','or','not','all','any','none','total','sum','average','mean','median','min','max','count','null','na','yes','no','true','false','jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec')),
n AS (SELECT source, name, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, name) AS place FROM n)
SELECT source, sum(n)::BIGINT AS entity_count, count(*)::BIGINT AS unique_entities, max(name) FILTER (WHERE place = 1) AS primary_entity, string_agg(name || ':' || n, '|' ORDER BY place) FILTER (WHERE place <= 10) AS top_entities FROM p GROUP BY 1""")
def ent_column_analysis(spark, sf_dir):
    caps = F.array_join(F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z]{2,}$")), ", ")
    found = metadata.entity_analysis(table(spark, sf_dir, "documents").select("source", caps.alias("value")), ["source"])
    top = F.array_join(F.transform("top_entities", lambda x: F.concat_ws(":", x["name"], x["count"].cast("string"))), "|")
    return found.select("source", "entity_count", "unique_entities", "primary_entity", top.alias("top_entities"))


@query("""
WITH t AS (SELECT p_name, list_distinct(string_split(lower(p_name), ' ')) AS words FROM part GROUP BY 1)
SELECT a.p_name, b.p_name AS other FROM t a JOIN t b ON a.p_name <> b.p_name WHERE len(list_intersect(a.words, b.words)) > 0 AND len(list_intersect(a.words, b.words)) / len(a.words) > 0.3""")
def ent_related(spark, sf_dir):
    return entities.related_pairs(table(spark, sf_dir, "part").select("p_name"), "p_name")


HEADS = (
    "CASE n_nationkey % 6 WHEN 0 THEN concat_ws(chr(10), 'Scope', 'Company: ABC for the year') WHEN 1 THEN concat('Deal with Omega Gear Private Limited (CIN: U123) ', n_name) WHEN 2 THEN concat_ws(chr(10), 'the', 'and so is it', 'Bright Path') "
    "WHEN 3 THEN 'a \"XYZ\" matter' WHEN 4 THEN concat_ws(chr(10), 'Company: based on the document', 'x') ELSE '' END"
)


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'ABC' WHEN 1 THEN 'Deal with Omega Gear Private Limited' WHEN 2 THEN 'Bright Path' WHEN 3 THEN 'XYZ' ELSE 'Target Company' END AS company FROM nation")
def ent_company_from_scope(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", entities.company_of_scope(F.expr(HEADS)).alias("company"))


PAPERS = (
    "CASE n_nationkey % 5 WHEN 0 THEN concat('accounts of M/s Rolling Stone 12/3/2024', chr(10), n_name) WHEN 1 THEN concat('report, Gamma Foods Limited', chr(10), 'x') WHEN 2 THEN concat('small print', chr(10), 'Great Lakes March 31, 2024', chr(10), 'x') "
    "WHEN 3 THEN concat('ledger: Name: Tall Trees', chr(10)) ELSE 'nothing here' END"
)


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Rolling Stone' WHEN 1 THEN 'Gamma Foods Limited' WHEN 2 THEN 'Great Lakes' WHEN 3 THEN 'Tall Trees' ELSE '' END AS company FROM nation")
def ent_company_from_document(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", entities.company_of_document(F.expr(PAPERS)).alias("company"))


@query("SELECT c_custkey, c_name AS bare, c_custkey % 3 <> 2 AS is_company FROM customer")
def ent_clean_titles(spark, sf_dir):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat(F.lit("M/s "), "c_name", F.lit("."))).when(k == 1, F.concat(F.lit("Name: "), "c_name", F.lit(" March 3, 2021"))).otherwise(F.concat("c_name", F.lit(" 1/2/24")))
    test = F.when(k == 0, F.col("c_name")).when(k == 1, F.lit("ACME")).otherwise(F.concat(F.lit("document provided "), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", entities.clean_title(text).alias("bare"), entities.is_company(test).alias("is_company"))


# ---- dates in texts

@query("""
SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN make_timestamp(year(o_orderdate), (quarter(o_orderdate) - 1) * 3 + 2, 1, 0, 0, 0) WHEN 1 THEN date_trunc('month', o_orderdate)::TIMESTAMP WHEN 2 THEN date_trunc('month', o_orderdate)::TIMESTAMP
       WHEN 3 THEN TIMESTAMP '2023-02-28 00:00:00' WHEN 4 THEN o_orderdate::DATE::TIMESTAMP WHEN 5 THEN o_orderdate::DATE + INTERVAL '15 hours 4 minutes' WHEN 6 THEN (DATE '1899-12-30' + (30000 + o_orderkey % 1000)::INT)::TIMESTAMP
       WHEN 7 THEN o_orderdate::DATE::TIMESTAMP ELSE NULL END AS at FROM orders""")
def dt_parse_components(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 9
    text = (
        F.when(k == 0, F.concat(F.lit("q"), F.quarter(d), F.lit("-"), F.year(d))).when(k == 1, F.date_format(d, "MMM-yyyy")).when(k == 2, F.date_format(d, "MM/yyyy"))
        .when(k == 3, F.lit("due 31-02-2023")).when(k == 4, F.concat(F.lit("on "), F.date_format(d, "dd MMMM yyyy"))).when(k == 5, F.concat(F.date_format(d, "yyyyMMdd"), F.lit(" 3:04 pm")))
        .when(k == 6, (30000 + F.col("o_orderkey") % 1000).cast("string")).when(k == 7, F.date_format(d, "dd/MM/yy")).otherwise("no date")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.lenient_date(text).alias("at"))


@query("""
SELECT o_orderpriority, count(*)::BIGINT AS total, count(*) FILTER (WHERE o_orderkey % 4 < 3)::BIGINT AS parsed, round(count(*) FILTER (WHERE o_orderkey % 4 < 3)::DOUBLE / count(*), 4) AS parse_rate,
       min(o_orderdate::DATE) FILTER (WHERE o_orderkey % 4 < 3) AS first_day, max(o_orderdate::DATE) FILTER (WHERE o_orderkey % 4 < 3) AS last_day,
       date_diff('day', min(o_orderdate::DATE) FILTER (WHERE o_orderkey % 4 < 3), max(o_orderdate::DATE) FILTER (WHERE o_orderkey % 4 < 3))::INT AS range_days, count(DISTINCT o_orderdate::DATE) FILTER (WHERE o_orderkey % 4 < 3)::BIGINT AS n_days,
       'Compact (YYYYMMDD)|ISO (YYYY-MM-DD)|US (MM/DD/YYYY) or EU (DD/MM/YYYY)' AS formats, 'daily' AS granularity FROM orders GROUP BY 1""")
def dt_column_analysis(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "yyyyMMdd"))
    return metadata.date_analysis(table(spark, sf_dir, "orders").select("o_orderpriority", text.alias("value")), ["o_orderpriority"])


@query("SELECT c_custkey, c_name AS name, 'March 0' || (1 + c_custkey % 9) || ', 2024' AS shown FROM customer")
def dt_names_and_headers(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat("c_name", F.lit(" March 31, 2024"))).when(k % 3 == 1, F.concat("c_name", F.lit(" 1-2-2024"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", dates.without_trailing_date(name).alias("name"), dates.display_date(F.make_date(F.lit(2024), F.lit(3), (1 + k % 9).cast("int"))).alias("shown"))
