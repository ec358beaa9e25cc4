"""Terms of requirement texts and kinds of names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The terms that requirement texts are searched for.
ENTITY_TERMS = [
    r"\b([A-Z][A-Za-z\s&]+(?:Inc|LLC|Ltd|Corp|Company|Co|Group|Bank|Fund|Capital|Partners|Holdings))\b",
    r"\b(company|entity|organization|firm|corporation|business|client|customer)\b",
    r"\b(investor|fund|bank|lender|borrower|counterparty|issuer)\b",
    r"\b(portfolio|subsidiary|affiliate|parent|holding)\b",
]
DATA_TERMS = [
    r"\b(revenue|income|sales|earnings|profit|loss|expenses|costs|cash flow)\b",
    r"\b(balance sheet|income statement|cash flow statement|financial statements?)\b",
    r"\b(assets|liabilities|equity|debt|capital|investments?)\b",
    r"\b(accounts receivable|accounts payable|inventory|working capital)\b",
    r"\b(ratios?|metrics?|kpis?|performance indicators?)\b",
    r"\b(analysis|breakdown|summary|report|schedule|listing)\b",
    r"\b(aging|maturity|rollforward|reconciliation)\b",
    r"\b(budget|forecast|projection|variance)\b",
    r"\b(transactions?|activities|movements|transfers)\b",
    r"\b(purchases?|sales|payments?|receipts?)\b",
    r"\b(investments?|disposals?|acquisitions?)\b",
]
KEYWORDS = [
    r"\b(report|statement|schedule|analysis|summary|listing|register)\b",
    r"\b(monthly|quarterly|annual|yearly|daily|weekly)\b",
    r"\b(detailed|summary|consolidated|separate|individual|combined)\b",
    r"\b(excel|spreadsheet|workbook|file|document|table)\b",
    r"\b(financial|accounting|tax|regulatory|compliance)\b",
    r"\b(provide|submit|prepare|include|show|detail|list)\b",
]
# Mentions of periods, kind by kind; their groups are what is taken.
PERIODS = [
    ("year", r"\b(20\d{2})\b"),
    ("year_range", r"\b(20\d{2})[-\s](?:to|through|thru)[-\s](20\d{2})\b"),
    ("quarter", r"\bQ([1-4])[-\s]?(20\d{2})\b"),
    ("month", r"\b(January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[-\s]?(20\d{2})?\b"),
    ("fiscal_year", r"\b(?:fiscal|FY)[-\s]?(20\d{2})\b"),
    ("relative", r"\b(current|latest|recent|prior|previous|last)\s+(year|quarter|month|period)\b"),
    ("multi_year", r"\b(\d+)[-\s]?years?\b"),
    ("as_of_date", r"\bas\s+of\s+([A-Za-z]+\s+\d{1,2},?\s+20\d{2}|\d{1,2}[/-]\d{1,2}[/-]20\d{2}|20\d{2}[-/]\d{1,2}[-/]\d{1,2})\b"),
]
#: Kinds of mentions that have two values.
PAIRED = {"year_range", "quarter", "month", "relative"}
FINANCIAL = ["revenue", "income", "profit", "loss", "assets", "liabilities", "cash"]
# Sections of a request list by the words of a scope section, in order.
SECTIONS = [
    (["quality of earnings", "revenue", "earnings"], "REVENUE ANALYSIS"),
    (["income statement", "profitability", "margin"], "INCOME STATEMENT ANALYSIS"),
    (["working capital", "liquidity"], "WORKING CAPITAL MANAGEMENT"),
    (["cash flow", "cash"], "CASH FLOW ANALYSIS"),
    (["balance sheet", "asset", "position"], "BALANCE SHEET REVIEW"),
    (["capital structure", "debt", "financing"], "CAPITAL STRUCTURE & DEBT ANALYSIS"),
    (["general", "reporting", "systems"], "GENERAL OVERVIEW & FINANCIAL REPORTING"),
    (["accounting", "policies", "estimates"], "ACCOUNTING POLICIES & ESTIMATES"),
    (["compensation", "payroll", "benefits"], "COMPENSATION, PAYROLL & BENEFITS"),
    (["related party", "transactions"], "RELATED PARTY TRANSACTIONS"),
    (["tax", "taxation"], "TAX MATTERS"),
    (["contingent", "liabilities", "commitments"], "CONTINGENT LIABILITIES & COMMITMENTS"),
    (["operational", "operations"], "OPERATIONAL ANALYSIS"),
    (["risk", "assessment"], "RISK ASSESSMENT"),
    (["customer", "market"], "CUSTOMER ANALYSIS"),
]
HIGH_WORDS = ["financial statements", "cash", "revenue", "receivables", "bank", "audit", "contracts"]
MEDIUM_WORDS = ["expense", "cost", "operational", "analysis", "breakdown"]
# Industries by words, in order.
INDUSTRIES = [
    ("technology", ["software", "technology", "digital"]),
    ("manufacturing", ["manufacturing", "production", "factory", "goods"]),
    ("retail", ["retail", "store", "consumer", "sales"]),
    ("services", ["service", "consulting", "professional"]),
    ("financial", ["financial", "banking", "investment"]),
    ("healthcare", ["healthcare", "medical", "pharma"]),
    ("construction", ["construction", "building", "real estate"]),
]


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds one of the words, anywhere in it."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _cases(text: Column, choices: list[tuple[list[str], str]], otherwise: Column) -> Column:
    out = None
    for words, name in choices:
        out = F.when(any_of(text, words), name) if out is None else out.when(any_of(text, words), name)
    return out.otherwise(otherwise)


def found_terms(text: Column, patterns: list[str]) -> Column:
    """The distinct terms in a text, lower-cased, trimmed and sorted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?i)" + p), 1) for p in patterns]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def file_references(text: Column) -> Column:
    """What follows ``a)``, ``b)`` … up to a comma or line end."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)[a-z]\)\s*([^,\n]+)"), 1), lambda x: F.trim(x))


def period_mentions(text: Column) -> Column:
    """(kind, values, raw) of each mention, kind by kind, repeats included; ``raw`` is the values with blanks between."""
    each = []
    for kind, p in PERIODS:
        groups = [F.regexp_extract_all(text, F.lit("(?i)" + p), k) for k in ((1, 2) if kind in PAIRED else (1,))]
        if len(groups) == 2:
            values = F.zip_with(*groups, lambda a, b: F.array(a, b))
        else:
            values = F.transform(groups[0], lambda a: F.array(a))
        each.append(F.transform(values, _mention(kind)))
    return F.flatten(F.array(*each))


def _mention(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("values"), F.trim(F.array_join(v, " ")).alias("raw"))


def requirement(text: Column) -> Column:
    """All that a requirement's text refers to: files, entities, periods, kinds of data, keywords, and how complex that makes it."""
    files, entities, periods, words = file_references(text), found_terms(text, ENTITY_TERMS), period_mentions(text), found_terms(text, KEYWORDS)
    score = complexity_score(F.size(files), F.size(entities), F.size(periods), F.size(words))
    return F.struct(
        files.alias("files"), entities.alias("entities"), periods.alias("periods"), found_terms(text, DATA_TERMS).alias("data_types"), words.alias("keywords"),
        score.alias("score"), complexity_level(score).alias("complexity"),
    )


def complexity_score(files: Column, entities: Column, periods: Column, keywords: Column) -> Column:
    return files * 2.0 + entities * 1.0 + periods * 3.0 + keywords * 0.5


def complexity_level(score: Column) -> Column:
    return F.when(score <= 5, "simple").when(score <= 15, "moderate").otherwise("complex")


def request_section(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(name, r"\(Priority:|High\)|Medium\)|Low\)", ""))
    return _cases(F.lower(name), SECTIONS, F.upper(bare))


def request_priority(text: Column) -> Column:
    return _cases(F.lower(text), [(HIGH_WORDS, "High"), (MEDIUM_WORDS, "Medium")], F.lit("Low"))


def industry(text: Column) -> Column:
    return _cases(F.lower(text), [(w, n) for n, w in INDUSTRIES], F.lit("general"))


def risk_areas(text: Column) -> Column:
    t = F.lower(text)
    has = lambda w: F.contains(t, F.lit(w))
    found = F.array_compact(F.array(
        F.when(has("debt"), "debt structure"), F.when(has("loss") | has("negative"), "profitability"),
        F.when(has("decline"), "revenue trends"), F.when(has("cash") & (has("negative") | has("concern")), "cash flow"),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general business risks")))


def entity_kind(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(any_of(n, ["bank"]), "banks").when(any_of(n, ["fund", "capital", "investment", "ventures"]), "funds")
        .when(n.rlike(r"\b(inc|corp|llc|ltd|limited|company|co)\b"), "companies").otherwise("others")
    )
