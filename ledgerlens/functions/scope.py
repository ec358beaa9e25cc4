"""Scope texts and verdicts as column expressions: priorities, estimates, budgets, headers, repaired tables, parsed answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.terms import any_of

# Sections of a scope by how pressing they are.
HIGH_SECTIONS = ["Quality of Earnings Analysis", "Income Statement Analysis", "Working Capital Management", "Cash Flow Analysis", "Balance Sheet Review"]
MEDIUM_SECTIONS = ["Capital Structure & Debt Analysis", "General Overview & Financial Reporting", "Accounting Policies & Estimates"]
# Words of a section's name, its priority and the requests that it is good for.
FOCUS = [(["revenue", "earnings", "quality"], "High", 6), (["working capital", "cash flow", "balance sheet"], "High", 5)]
OTHER_FOCUS = ("Medium", 4)
# Areas up to which an answer may have so many tokens.
TOKEN_TIERS, MOST_TOKENS = [(3, 4000), (8, 6000), (12, 7000)], 8000
# Kinds of scope by the words of section names, in order.
SCOPE_KINDS = [
    ("revenue", ["revenue", "earnings", "customer"]), ("working capital", ["working capital", "cash flow"]), ("balance sheet", ["balance sheet", "assets", "liabilities"]),
]
REQUESTS_AN_AREA, MANY_AREAS, WIDE_AREAS, HOURS = 5, 8, 10, 350
# What a sheet of requests calls pressing, by a section's name in capitals.
HIGH_NAMES, MEDIUM_NAMES = ["REVENUE", "EARNINGS", "CASH", "BALANCE"], ["WORKING CAPITAL", "INCOME"]
# Parts that a verdict has, and what stands for one that cannot be read.
VERDICT_KEYS = ["overall_compliance", "file_analysis", "entity_analysis", "period_analysis", "data_quality", "recommendations", "detailed_findings"]
FALLBACK_STATUS, FALLBACK_CONFIDENCE = "UNKNOWN", 0.5
# Requests that stand for a section where no others are there, by words of its name, in order.
STOCK_REQUESTS = [
    ("Quality of Earnings", "Revenue analysis and supporting documentation for", ["Monthly revenue breakdown by customer", "Customer contracts and terms", "Revenue recognition policies"]),
    ("Income Statement", "Detailed P&L analysis for", ["Cost breakdown by category", "Employee cost analysis", "Operating expense details"]),
    ("Working Capital", "Working capital components for", ["Inventory aging analysis", "Trade receivables aging", "Trade payables analysis"]),
    ("Cash Flow", "Cash flow supporting data for", ["Bank statements and reconciliations", "Cash flow forecasts", "Working capital movements"]),
]


def section_priority(name: Column) -> Column:
    """By whether a section's name holds one of the listed ones; capitals count."""
    return F.when(any_of(name, HIGH_SECTIONS), "High").when(any_of(name, MEDIUM_SECTIONS), "Medium").otherwise("Low")


def sheet_priority(name: Column) -> Column:
    """The priority of a section in a sheet of requests."""
    return F.when(any_of(F.upper(name), HIGH_NAMES), "High").when(any_of(F.upper(name), MEDIUM_NAMES), "Medium").otherwise("Low")


def section_focus(name: Column) -> Column:
    """(priority, estimated_requests) of a section."""
    out, low = None, F.lower(name)
    for words, priority, n in FOCUS:
        value = F.struct(F.lit(priority).alias("priority"), F.lit(n).alias("estimated_requests"))
        out = F.when(any_of(low, words), value) if out is None else out.when(any_of(low, words), value)
    return out.otherwise(F.struct(F.lit(OTHER_FOCUS[0]).alias("priority"), F.lit(OTHER_FOCUS[1]).alias("estimated_requests")))


def token_budget(n_areas: Column) -> Column:
    out = None
    for most, tokens in TOKEN_TIERS:
        out = F.when(n_areas <= most, tokens) if out is None else out.when(n_areas <= most, tokens)
    return out.otherwise(MOST_TOKENS)


def estimated_requests(n_areas: Column) -> Column:
    return n_areas * REQUESTS_AN_AREA


def scope_type(n_areas: Column) -> Column:
    return F.when(n_areas > WIDE_AREAS, "comprehensive").otherwise("focused")


def scope_kind(names: Column) -> Column:
    """What a scope is about, by the names of all its sections: the first kind that one of them speaks of, else by their number."""
    low = F.transform(names, F.lower)
    out = F.when(F.size(names) == 0, "standard")
    for kind, words in SCOPE_KINDS:
        out = out.when(F.exists(low, _holds(words)), kind)
    return out.when(F.size(names) > MANY_AREAS, "comprehensive").otherwise("focused")


def _holds(words: list[str]):
    return lambda x: any_of(x, words)


def bare_section(name: Column) -> Column:
    """A section's name without a priority in brackets."""
    out = name
    for part in ("(Priority:", "High)", "Medium)", "Low)"):
        out = F.replace(out, F.lit(part), F.lit(""))
    return F.trim(out)


def section_header(name: Column) -> Column:
    """As a line of a request list, in capitals between stars."""
    return F.concat(F.lit("**"), F.upper(bare_section(name)), F.lit("**"))


def stock_request(name: Column) -> Column:
    """(info_request, priority) that stand for a section without requests."""
    asked, high = None, F.when(any_of(name, HIGH_SECTIONS), "High").otherwise("Medium")
    for words, lead, points in STOCK_REQUESTS:
        body = "".join(f"\n({chr(97 + k)}) {p}" for k, p in enumerate(points))
        text = F.concat(F.lit(lead + " "), F.lower(name), F.lit(":" + body))
        asked = F.when(F.contains(name, F.lit(words)), text) if asked is None else asked.when(F.contains(name, F.lit(words)), text)
    other = F.concat(F.lit("Supporting documentation for "), F.lower(name), F.lit(" analysis"))
    named = any_of(name, [words for words, *_ in STOCK_REQUESTS])
    return F.struct(asked.otherwise(other).alias("info_request"), F.when(named, high).otherwise("Medium").alias("priority"))


def content_flags(text: Column) -> Column:
    """Whether a text speaks of revenue, of assets or liabilities, and of cash flow."""
    low = F.lower(text)
    return F.struct(
        any_of(low, ["revenue"]).alias("has_revenue_data"), any_of(low, ["asset", "liability"]).alias("has_balance_sheet"), any_of(low, ["cash flow"]).alias("has_cashflow"),
    )


def complexity_of_risks(risks: Column) -> Column:
    return F.when(F.size(risks) > 3, "High").when(F.size(risks) > 1, "Medium").otherwise("Standard")


def scope_document(company: Column, day: Column, n_areas: Column, risks: Column, content: Column) -> Column:
    """A scope text under its header."""
    return F.format_string(
        "FINANCIAL DUE DILIGENCE SCOPE OF WORK\n" + "=" * 50 + "\nCompany: %s\nGenerated: %s\n\nSCOPE SUMMARY\n" + "-" * 20 + f"\nAnalysis Areas: %s\nEstimated Hours: {HOURS}\nComplexity Level: %s\n\n%s",
        company, F.date_format(day, "MMMM dd, yyyy"), n_areas.cast("string"), complexity_of_risks(risks), content,
    )


def repaired_breaks(text: Column) -> Column:
    """Table rows whose second cell has ``<br>`` between procedures, with these on numbered lines; other breaks become line ends."""
    cell = r"^(\| [^|]* \| )([^|]*<br>[^|]*)(\|?)(.*)$"

    def line(x: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.regexp_extract(x, cell, 2), "<br>"), lambda p: F.trim(p)), lambda p: p != "")
        lines = F.transform(parts, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), F.regexp_replace(p, r"^\d+\.\s*", "")))
        mended = F.concat(F.regexp_extract(x, cell, 1), F.array_join(lines, "\n"), F.lit(" |"), F.regexp_extract(x, cell, 4))
        return F.when(x.rlike(cell), mended).otherwise(F.replace(x, F.lit("<br>"), F.lit("\n")))

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def readable_verdict(answer: Column) -> Column:
    """(source, verdict) of an answer that should be JSON: the whole, else the text from its first to its last brace, else none."""
    valid = lambda x: F.get_json_object(x, "$").isNotNull() & F.trim(x).rlike(r"(?s)^\{.*\}$")
    block = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    kind = F.when(valid(answer), "whole").when(valid(block), "part").otherwise("fallback")
    return F.struct(kind.alias("source"), F.when(valid(answer), answer).when(valid(block), block).alias("verdict"))


def verdict_status(verdict: Column) -> Column:
    return F.coalesce(F.get_json_object(verdict, "$.overall_compliance.status"), F.lit(FALLBACK_STATUS))


def verdict_confidence(verdict: Column) -> Column:
    found = F.get_json_object(verdict, "$.overall_compliance.confidence_score").try_cast("double")
    return F.when(verdict.isNull(), FALLBACK_CONFIDENCE).otherwise(F.coalesce(found, F.lit(0.0)))


def missing_parts(verdict: Column) -> Column:
    """The parts that a verdict should have and lacks."""
    return F.array_compact(F.array(*[F.when(F.get_json_object(verdict, f"$.{k}").isNull(), k) for k in VERDICT_KEYS]))


def verdict_summary(status: Column, confidence: Column, submitted: Column, expected: Column, missing: Column) -> Column:
    """A verdict in a few lines of text."""
    return F.format_string(
        "Overall Status: %s\nConfidence Score: %.2f\nFiles Submitted: %s\nFiles Expected: %s\nMissing Files: %s",
        status, confidence.cast("double"), submitted.cast("string"), expected.cast("string"), missing.cast("string"),
    )


# Words of the scope sections that each part of a request list is made from.
PART_WORDS = {
    "A": ["financial statements", "earnings", "income statement", "revenue", "general"],
    "B": ["profit", "loss", "revenue", "cost", "expense", "employee", "working capital"],
    "C": ["balance sheet", "assets", "liabilities", "cash", "receivables", "inventory", "debt"],
}


def relevant_parts(name: Column) -> Column:
    """The parts of a request list that a scope section matters for, in order; none for a null."""
    low = F.lower(name)
    return F.array_compact(F.array(*[F.when(any_of(low, words), F.lit(part)) for part, words in PART_WORDS.items()]))
