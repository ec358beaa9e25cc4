"""Names of companies and other entities: found in texts, cleaned and tested, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.cleaning import let
from ledgerlens.functions.dates import without_trailing_date

# Words that the names of businesses end with.
SUFFIXES = [
    r"\b(?:Inc|LLC|Ltd|Limited|Corp|Corporation|Company|Co|Group|Holdings|Partners|LP|LLP|GmbH|AG|SA|SPA|PLC|Pty|NV|BV|AB|AS|A\/S|KG|OOO|ZAO|SRL|SARL|SpA|Srl|SE|KK|GK|Bhd|Sdn|Pte|Pvt|Private|Public|Trust|Fund|Bank"
    r"|Capital|Ventures|Investment|Advisors|Management|Financial|Securities|Asset|Equity|Advisory|Consulting|Services|Solutions|Technologies|Tech|Systems|Software|Digital|Global|International|National|Regional|Industries"
    r"|Enterprises|Incorporated|Unlimited)\b",
    r"\b(?:& Co|& Sons|& Associates|& Partners|et al)\b",
]
# Names with such a word, words in capitals, names with an article, words in camel case.
NAMES = [
    r"\b([A-Z][A-Za-z\s&\-\.]+(?:" + "|".join(SUFFIXES) + r"))\b",
    r"\b([A-Z]{2,}(?:\.[A-Z]{2,})*)\b",
    r"\b(The\s+[A-Z][A-Za-z\s&\-\.]+)\b",
    r"\b([A-Z][a-z]+(?:[A-Z][a-z]+){1,})\b",
]
# What the name of a column of entities has in it.
ENTITY_COLUMNS = [
    "company", "corporation", "firm", "entity", "organization", "org",
    "client", "customer", "vendor", "supplier", "partner", "investor",
    "fund", "bank", "issuer", "borrower", "lender", "counterparty",
    "name", "party", "account", "holder", "owner", "beneficiary",
    "sponsor", "manager", "advisor", "trustee", "custodian",
    "underwriter", "broker", "dealer", "agent", "principal",
    "portfolio", "subsidiary", "affiliate", "parent", "group",
]
# Words that are no names.
NO_NAMES = [
    "the", "and", "or", "not", "all", "any", "none", "total", "sum",
    "average", "mean", "median", "min", "max", "count", "null", "na",
    "yes", "no", "true", "false", "jan", "feb", "mar", "apr", "may",
    "jun", "jul", "aug", "sep", "oct", "nov", "dec", "monday", "tuesday",
    "wednesday", "thursday", "friday", "saturday", "sunday",
]
# Phrases that company names lack, and such that they have.
NO_COMPANY = [
    "based on", "provided", "document", "financial", "statements",
    "analysis", "comprehensive", "the", "and", "or", "is", "are",
    "with", "without", "complete", "since", "only", "target company",
]
COMPANY_WORDS = [
    "private limited", "ltd", "limited", "corporation", "corp",
    "llc", "inc", "pvt", "solutions", "systems", "technologies",
    " & ", "group", "holdings", "enterprises",
]
NO_TITLE = ["unknown", "not found", "n/a", "company", "target company", "balance sheet"]
# What stands before a name, and what descriptions add after it.
SCOPE_PREFIXES = [
    "Company Name: ", "COMPANY NAME: ", "Company: ", "Company name: ", "Based on the provided document", "Since only the company name ",
    "The company name is: ", "Analysis of ", "Statements provided for ",
]
TITLE_PREFIXES = ["M/s", "M/S", "Messrs", "Company:", "Name:", "Entity:"]
TRAILERS = [r"\s+is provided without.*$", r"\s+demonstrates.*$", r"\s+shows.*$", r"\s+registered in.*$", r"\s*\(CIN:.*\).*$"]
LEGAL = r"(?:Private Limited|Pvt\.?\s*Ltd\.?|Limited|Corporation|LLC|Inc\.?)"
SCOPE_NAMES = [
    r"(?:statements provided for|analysis of|analysis for)\s+([A-Z][a-zA-Z\s&]+(?:Private Limited|Pvt\.?\s*Ltd\.?|Limited|Corporation))",
    rf"([A-Z][a-zA-Z\s&]+{LEGAL})",
    rf'"([A-Z][A-Za-z\s&]+{LEGAL})"',
    rf'Company[:\s]+"?([A-Z][a-zA-Z\s&]+{LEGAL})"?',
    r'"([A-Z]{2,10})"',
    r"([A-Z][a-zA-Z\s&]+(?:Private Limited|Pvt\.?\s*Ltd\.?)).*?CIN[:\s]*[A-Z0-9]+",
]
DOCUMENT_NAMES = [
    r"([A-Z][A-Za-z\s&]+(?:Private|Pvt|Public|Ltd|Limited|Inc|Corp|Corporation|Company|LLP|LLC)\.?\s*(?:Limited|Ltd)?)",
    r"(?:Company|Name|Entity)[\s:]+([A-Z][A-Za-z\s&]+)",
    r"(?:M/s|M/S|Messrs)\.?\s+([A-Z][A-Za-z\s&]+)",
]
#: Name for a scope text that names no company; characters of a document and of its head that names are looked for in; lines of a head.
NO_NAME, LOOK, HEAD, HEAD_LINES = "Target Company", 3000, 1000, 10


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_entity_name(name: Column) -> Column:
    """Whether a column's name speaks of entities; parts of words count."""
    return F.lower(name).rlike("|".join(ENTITY_COLUMNS))


def clean_entity(name: Column) -> Column:
    """White space made single blanks, no punctuation at the end, dashes without blanks, ampersands between blanks."""
    bare = F.regexp_replace(_trimmed(F.regexp_replace(name, r"\s+", " ")), r"[,;:\.\s]+$", "")
    return _trimmed(F.regexp_replace(F.regexp_replace(bare, "\\s*[-\u2013\u2014]\\s*", "-"), r"\s*&\s*", " & "))


def is_entity(name: Column) -> Column:
    """Whether a cleaned name may be one: with a business word, of several words mostly in capitals, or an abbreviation."""
    words = F.split(name, " ")
    big = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    several = name.rlike(r"^\p{Lu}") & (F.length(name) > 3) & (F.size(words) > 1) & (big * 2 > F.size(words))
    business = name.rlike("(?i)" + "|".join(SUFFIXES))
    return (F.length(name) >= 2) & ~F.lower(name).isin(NO_NAMES) & name.rlike("[A-Za-z]") & (business | several | name.rlike(r"^[A-Z]{2,}(?:\.[A-Z]{2,})*$"))


def extract_entities(text: Column) -> Column:
    """The distinct entities in a text, sorted; none for a null."""
    found = F.flatten(F.array(*[F.regexp_extract_all(_trimmed(text), F.lit(p), 1) for p in NAMES]))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(found, clean_entity), is_entity))), F.array().cast("array<string>"))


def related(primary: Column, other: Column, share: float = 0.3) -> Column:
    """Whether another name has over a share of the primary name's words."""
    mine = F.array_distinct(F.split(F.lower(_trimmed(primary)), r"\s+"))
    same = F.size(F.array_intersect(mine, F.split(F.lower(_trimmed(other)), r"\s+")))
    return (primary != other) & (same > 0) & (same / F.size(mine) > share)


def related_pairs(df: DataFrame, name: str, share: float = 0.3) -> DataFrame:
    """(name, other) of different names of which the other has over a share of the first one's words.

    Names meet by words that are rare among all names: if so many of a name's words have to be there, one of the rarest of them is,
    all but those that may be missing. So a word that most names have brings none together by itself, unless it is a whole name.
    """
    bare = F.array_distinct(F.split(F.lower(_trimmed(F.col(name))), r"\s+"))
    words = df.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), bare.alias("w")).distinct()
    each = words.select("name", "w", F.explode("w").alias("word"))
    counted = each.join(each.groupBy("word").agg(F.count("*").alias("often")), "word")
    rarest = F.array_sort(F.collect_list(F.struct("often", "word")))
    least = F.floor(F.size("w") * F.lit(share)).cast("int") + 1
    own = counted.groupBy("name", "w").agg(rarest.alias("r")).select("name", "w", F.explode(F.slice("r", F.lit(1), F.size("w") - least + 1)).alias("x")).select("name", "w", "x.word")
    met = own.join(each.select(F.col("name").alias("other"), F.col("w").alias("v"), "word"), "word").where("name <> other")
    near = F.size(F.array_intersect("w", "v")) / F.size("w") > share
    return met.where(near).select(F.col("name").alias(name), "other").distinct()


def clean_title(name: Column) -> Column:
    """A company's name from a document, without what stands before and after it; empty where nothing of a name is left."""
    out = _trimmed(name)
    for p in TITLE_PREFIXES:
        out = let(out, _without_prefix(p))
    out = let(without_trailing_date(out), lambda x: F.when(F.endswith(x, F.lit(".")) & ~x.rlike(r"(Pvt|Ltd|Inc)\.$"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return let(F.regexp_replace(out, "[.,;:]+$", ""), lambda x: F.when((F.length(x) < 3) | F.lower(x).isin(NO_TITLE), "").otherwise(x))


def _without_prefix(p: str):
    return lambda x: F.when(F.startswith(x, F.lit(p)), _trimmed(F.substr(x, F.lit(len(p) + 1)))).otherwise(x)


def company_of_document(text: Column) -> Column:
    """The company that a document is of, by its first ``LOOK`` characters: a name with a business word, one after a label,
    or the first line of its head that may be a name; empty where there is none."""
    tries = []
    for p in DOCUMENT_NAMES:
        name = clean_title(F.get(F.regexp_extract_all(F.substring(text, 1, LOOK), F.lit(p), 1), 0))
        tries.append(let(name, lambda x: F.when(F.length(x) > 3, x)))
    lines = F.transform(F.slice(F.split(F.substring(text, 1, HEAD), "\n"), 1, HEAD_LINES), _trimmed)
    likely = F.filter(lines, lambda x: (F.length(x) > 5) & x.rlike(r"^\p{Lu}") & (x != F.upper(x)))
    heads = F.filter(F.transform(likely, clean_title), lambda x: F.length(x) > 5)
    return F.coalesce(*tries, F.get(heads, 0), F.lit(""))


def is_company(name: Column) -> Column:
    """Whether a text may be a company's name: at most one phrase that names lack, and a business word, an abbreviation, or a capital first."""
    return F.coalesce(let(_trimmed(name), _is_company), F.lit(False))


def _is_company(bare: Column) -> Column:
    def told(low: Column) -> Column:
        odd, has = F.lit(0), F.lit(False)
        for p in NO_COMPANY:
            odd = odd + F.contains(low, F.lit(p)).cast("int")
        for w in COMPANY_WORDS:
            has = has | F.contains(low, F.lit(w))
        return F.when(low.isin(NO_COMPANY) | (odd > 1), False).when(has, True)

    short = bare.rlike(r"^\p{Lu}{2,10}$")
    long = F.length(bare).between(3, 100) & bare.rlike(r"^\p{Lu}")
    said = let(F.lower(bare), told)
    return (F.length(bare) >= 2) & F.coalesce(said, short | long)


def clean_company(name: Column) -> Column:
    """A company's name from a scope text, without what stands before it, what is told after it, and quotes."""
    def cut(out: Column) -> Column:
        found = None
        for p in SCOPE_PREFIXES:
            rest = _trimmed(F.substr(out, F.lit(len(p) + 1)))
            found = F.when(F.startswith(out, F.lit(p)), rest) if found is None else found.when(F.startswith(out, F.lit(p)), rest)
        return found.otherwise(out)

    def rest(out: Column) -> Column:
        bare = out
        for p in TRAILERS:
            bare = _trimmed(F.regexp_replace(bare, f"(?i){p}", ""))
        return let(_trimmed(F.regexp_replace(F.regexp_replace(bare, "[\"']", ""), r"\s+", " ")), first_part)

    def first_part(bare: Column) -> Column:
        part = F.get(F.filter(F.transform(F.split(bare, ","), _trimmed), is_company), 0)
        return F.coalesce(F.when(F.contains(bare, F.lit(",")) & (F.length(bare) > 50), part), bare)

    quoted = lambda out: let(_trimmed(F.regexp_extract(out, '"([^"]+)"', 1)), lambda q: F.when(is_company(q), q))
    return let(let(_trimmed(name), cut), lambda out: F.coalesce(quoted(out), rest(out)))


def company_of_scope(text: Column) -> Column:
    """The company that a scope text is for: the first word of its company line, or that line; a name by one of six patterns; or
    the first of its first lines that may be a name; else ``NO_NAME``."""
    line = F.nullif(_trimmed(F.regexp_extract(text, r"(?i)Company:\s*([^\n\r]+)", 1)), F.lit(""))
    valid = lambda x: F.when(is_company(x), x)
    tries = [let(F.get(F.split(line, r"\s+"), 0), valid), let(clean_company(line), valid)]
    for p in SCOPE_NAMES:
        found = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){p}"), 1), clean_company)
        tries.append(F.get(F.filter(found, is_company), 0))
    lines = F.transform(F.slice(F.split(text, "\n"), 1, HEAD_LINES), _trimmed)
    tries.append(F.get(F.filter(lines, lambda x: (F.length(x) > 2) & (F.length(x) < 100) & is_company(x)), 0))
    return F.coalesce(*tries, F.lit(NO_NAME))
