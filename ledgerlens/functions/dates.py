"""Dates and periods as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.cleaning import let

# Formats in the order in which they are tried, day first.
FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "yyyy.M.d", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy"]
# Labels of date spellings and the patterns that they stand for, in order.
LABELS = [
    (r"^\d{4}-\d{2}-\d{2}", "ISO (YYYY-MM-DD)"),
    (r"^\d{1,2}/\d{1,2}/\d{2,4}", "US (MM/DD/YYYY) or EU (DD/MM/YYYY)"),
    (r"^\d{1,2}-\d{1,2}-\d{2,4}", "Hyphenated (DD-MM-YYYY or MM-DD-YYYY)"),
    (r"^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}", "Named month (DD Month YYYY)"),
    (r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}", "US long (Month DD, YYYY)"),
    (r"^[Qq][1-4][-\s]?\d{2,4}", "Quarter (Q1-YYYY)"),
    (r"^\d{8}$", "Compact (YYYYMMDD)"),
]
# What the name of a date column has in it.
DATE_NAMES = [
    "date", "time", "datetime", "dt", "period", "month", "year",
    "quarter", "week", "day", "timestamp", "created", "updated",
    "modified", "effective", "expiry", "start", "end", "from", "to",
    "as_of", "asof", "reporting", "transaction", "trade", "settlement",
    "maturity", "issue", "dated", "cal_", "_dt$", "_date$", "_time$",
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_WORDS = "January|February|March|April|May|June|July|August|September|October|November|December"
# Spellings that dates are taken from, with the parts that their groups are, in order.
SPELLINGS = [
    (r"\b(\d{1,2})[-/_\s](\d{1,2})[-/_\s](\d{2,4})\b", "dmy"),
    (r"\b(\d{1,2})[-/_\s](\d{1,2})[-/_\s](\d{2,4})\b", "mdy"),
    (r"\b(\d{4})[-/_\s](\d{1,2})[-/_\s](\d{1,2})\b", "ymd"),
    (r"\b(\d{2,4})[-/_\s](\d{1,2})[-/_\s](\d{1,2})\b", "ymd"),
    (r"\b(\d{1,2})[-\s]([A-Za-z]{3,9})[-\s](\d{2,4})\b", "dny"),
    (r"\b([A-Za-z]{3,9})[-\s](\d{1,2}),?\s*(\d{2,4})\b", "ndy"),
    (r"\b(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{2,4})\b", "dny"),
    (r"\b(\d{4})(\d{2})(\d{2})\b", "ymd"),
    (r"\bQ([1-4])[-\s]?(\d{2,4})\b", "qy"),
    (r"\b(\d{2,4})[-\s]?Q([1-4])\b", "yq"),
    (r"\b([A-Za-z]{3,9})[-\s](\d{2,4})\b", "ny"),
    (r"\b(\d{1,2})[-/_](\d{2,4})\b", "my"),
]
#: Tried before the spellings that start with a month's name: such a name and a year of four digits, which they would take for a day and a year of two.
MONTH_YEAR = (r"\b([A-Za-z]{3,9})[-\s](\d{4})\b", "ny")
TRIED = [*SPELLINGS[:5], MONTH_YEAR, *SPELLINGS[5:]]
TIME = r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AP]M)?\b"
#: Spreadsheet day numbers that count as dates.
LAST_SERIAL = 100000


def parse_date(value: Column) -> Column:
    """The first format that fits, as a date; null where none does. Each format is tried only on values of its shape."""
    return _parsed(F.trim(value))


def _parsed(bare: Column) -> Column:
    out = None
    for shape, formats in _by_shape():
        tried = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)).cast("date") for f in formats])
        out = F.when(bare.rlike(shape), tried) if out is None else out.when(bare.rlike(shape), tried)
    return out


def _by_shape() -> list[tuple[str, list[str]]]:
    """Formats under a pattern of what they look like; formats of one shape stay in order."""
    groups: dict[str, list[str]] = {}
    for f in FORMATS:
        shape = f.replace("MMMM", "N").replace("MMM", "N").replace("yyyy", "Y").replace(".", r"\.")
        shape = "".join({"N": "[A-Za-z]+", "Y": r"[+-]?\d+", "d": r"\d{1,2}", "M": r"\d{1,2}"}.get(c, c) for c in shape)
        groups.setdefault(f"^{shape}$", []).append(f)
    return list(groups.items())


def standard_date(value: Column) -> Column:
    """``yyyy-MM-dd``, or the value as it is where it is no date."""
    return F.coalesce(F.date_format(parse_date(value), "yyyy-MM-dd"), value)


def format_label(value: Column) -> Column:
    bare = F.trim(value)
    return reduce(lambda c, p: c.when(bare.rlike(p[0]), p[1]), LABELS[1:], F.when(bare.rlike(LABELS[0][0]), LABELS[0][1])).otherwise("Custom/Unknown")


def is_date_name(name: Column) -> Column:
    """Whether a column's name speaks of dates. Parts of words count, so ``total`` and ``vendor`` do."""
    return F.lower(name).rlike("|".join(DATE_NAMES))


def month_number(word: Column) -> Column:
    """1 to 12 by a word's first three letters, else null."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(F.lower(word), 1, 3)), F.lit(0)).cast("int")


def full_year(year: Column) -> Column:
    """Years under 50 are of this century, those up to 99 of the last."""
    return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date; a day after the month's last becomes that last day, other parts that are no date give null."""
    first = F.when((month >= 1) & (month <= 12) & (year >= 1) & (year <= 9999), F.make_date(year, F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1)))
    return F.when((day >= 1) & (day <= 31), let(first, lambda d: F.date_add(d, (F.least(day, F.day(F.last_day(d))) - 1).cast("int"))))


def lenient_date(value: Column, serial: bool = True) -> Column:
    """A timestamp: the strict formats first, then the first spelling that is found in the text and is a date, then spreadsheet day numbers.

    Quarters stand for their middle month, a missing day for the first. A time of day in the text is
    kept with a date that has a day. Nothing depends on today, and bare numbers are day numbers only.
    """
    return let(F.trim(value.cast("string")), lambda bare: let(_lenient_day(bare, serial).cast("timestamp"), lambda day: _with_clock(bare, day)))


def _lenient_day(bare: Column, serial: bool) -> Column:
    found = [_parsed(bare)]
    for pattern, parts in TRIED:
        group = lambda k, p=pattern: F.nullif(F.regexp_extract(bare, f"(?i){p}", k), F.lit(""))
        at = {part: group(k) for k, part in enumerate(parts, 1)}
        year = let(at["y"].try_cast("int"), full_year)
        if "q" in at:
            month = (at["q"].try_cast("int") - 1) * 3 + 2
        else:
            month = month_number(at["n"]) if "n" in at else at["m"].try_cast("int")
        day = at["d"].try_cast("int") if "d" in at else F.lit(1)
        date = let(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), lambda x: date_of(x["y"], x["m"], x["d"]))
        found.append(F.when(bare.rlike(f"(?i){pattern}"), date))
    number = bare.try_cast("double")
    if serial:
        found.append(F.when((number > 1) & (number < LAST_SERIAL), excel_serial(number)))
    return F.coalesce(*found)


def _with_clock(bare: Column, day: Column) -> Column:
    clock = lambda k: F.regexp_extract(bare, f"(?i){TIME}", k)
    def seconds(x: Column) -> Column:
        hour = F.when((x["half"] == "PM") & (x["h"] < 12), x["h"] + 12).when((x["half"] == "AM") & (x["h"] == 12), 0).otherwise(x["h"])
        return F.when((hour < 24) & (x["m"] < 60) & (x["s"] < 60), hour * 3600 + x["m"] * 60 + x["s"])

    parts = F.struct(clock(1).try_cast("int").alias("h"), clock(2).try_cast("int").alias("m"), F.coalesce(clock(3).try_cast("int"), F.lit(0)).alias("s"), F.upper(clock(4)).alias("half"))
    return let(let(parts, seconds), lambda n: F.when(n.isNotNull(), day + F.make_dt_interval(secs=n)).otherwise(day))


def excel_serial(serial: Column) -> Column:
    """The date of a spreadsheet's day number; the calendar there has a 29 February 1900."""
    return F.when(serial < 60, F.date_add(F.lit("1899-12-31").cast("date"), serial.cast("int"))).otherwise(F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int")))


def granularity(timed: Column, n: Column, least_gap: Column) -> Column:
    """From whether any value has a time of day, the number of values and the least positive gap in days."""
    return (
        F.when(n < 2, "unknown").when(timed, "datetime").when(least_gap.isNull(), "unknown").when(least_gap < 1, "intraday").when(least_gap <= 1, "daily")
        .when(least_gap <= 7, "weekly").when(least_gap <= 31, "monthly").when(least_gap <= 92, "quarterly").otherwise("yearly")
    )


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day), F.lit("-"), F.year(day))


def text_periods(text: Column) -> Column:
    """``FY<first>-<last>`` of the years 20xx that a text names, ``FY<year>`` for one; else its first three ``FY`` words; else a stock phrase."""
    years = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(20\d{2})"), 1)))
    first, last = F.get(years, 0), F.get(years, F.size(years) - 1)
    named = F.slice(F.regexp_extract_all(text, F.lit(r"(FY\s*\d{2,4})"), 1), 1, 3)
    return (
        F.when(F.size(years) > 1, F.concat(F.lit("FY"), first, F.lit("-"), last)).when(F.size(years) == 1, F.concat(F.lit("FY"), first))
        .when(F.size(named) > 0, F.array_join(named, ", ")).otherwise("historical period")
    )


def scope_periods(text: Column) -> Column:
    """(current_year, previous_year, balance_sheet_date) that a scope text names; empty where it names none."""
    fiscal = F.regexp_extract_all(text, F.lit(r"FY\s*(\d{4}[-/]\d{2,4})"), 1)
    spans = F.regexp_extract_all(text, F.lit(r"(\d{4}[-/]\d{4})"), 1)
    march = F.regexp_extract_all(text, F.lit(r"March\s+\d{1,2},?\s+(\d{4})"), 1)
    from_end = lambda a, k: F.get(a, F.size(a) - k)
    return F.struct(
        F.coalesce(from_end(fiscal, 1), from_end(spans, 1), F.lit("")).alias("current_year"), F.coalesce(from_end(fiscal, 2), F.lit("")).alias("previous_year"),
        F.coalesce(F.concat(F.lit("March 31, "), from_end(march, 1)), F.lit("")).alias("balance_sheet_date"),
    )


def without_trailing_date(name: Column) -> Column:
    """A name without a date at its end."""
    return F.regexp_replace(F.regexp_replace(name, rf"\s*({MONTH_WORDS})\s+\d+,?\s*\d{{4}}$", ""), r"\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$", "")


def display_date(day: Column) -> Column:
    """As in report headers, ``March 05, 2024``."""
    return F.date_format(day, "MMMM dd, yyyy")
