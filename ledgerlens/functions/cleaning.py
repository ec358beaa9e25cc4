"""Cell cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a missing cell, and the words of a boolean.
MISSING = ["N/A", "n/a", "NA", "null", "NULL", "None", "NONE", "-", "--", "---"]
TRUE_WORDS = ["true", "yes", "y", "1", "on", "enabled"]
FALSE_WORDS = ["false", "no", "n", "0", "off", "disabled"]


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it: expressions are trees, so a value that is used twice at
    each of ten steps would be there a thousand times."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def stripped(value: Column) -> Column:
    """Without white space at the ends (tabs and line ends too)."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def missing_to_null(value: Column) -> Column:
    """Trimmed, and null where it is blank or stands for a missing value."""
    bare = stripped(value)
    return F.when(~bare.isin(*MISSING, ""), bare)


def clean_cell(value: Column) -> Column:
    """Without control characters (tabs and line ends too), trimmed, white space runs made one blank; missing words in any case become null."""
    bare = stripped(F.regexp_replace(F.regexp_replace(value, r"[\x00-\x1f\x7f-\x9f]", ""), r"(?U)\s+", " "))
    return F.when(~F.upper(bare).isin("N/A", "NA", "NULL", "NONE", "-", "--", "---", ""), bare)


def to_boolean(value: Column) -> Column:
    word = F.lower(stripped(value.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def column_name(name: Column, position: Column) -> Column:
    """A name of word characters and single underscores; ``Column_<position>`` where nothing is left of it."""
    bare = F.regexp_replace(F.regexp_replace(stripped(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]", "_"), r"(?U)[\s_]+", "_")
    bare = F.regexp_replace(bare, "^_+|_+$", "")
    return F.when(bare == "", F.concat(F.lit("Column_"), position.cast("string"))).otherwise(bare)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def safe_percentage(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(default))


def safe_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return safe_divide(a, b, default)


def safe_average(value: Column, default: float = 0.0) -> Column:
    """An aggregate: the mean of what is not null."""
    return F.coalesce(F.avg(value.cast("double")), F.lit(default))


def fill_missing(value: Column, constant: str | None) -> Column:
    """``missing_to_null`` with a constant in place of the nulls, unless it is None."""
    bare = missing_to_null(value)
    return bare if constant is None else F.coalesce(bare, F.lit(constant))


def apply_type(value: Column, kind: str, integer_zero: bool = False) -> Column:
    """Text as a column of the kind that ``profile.infer_types`` names. What does not fit is null; dates that do not parse stay as they are.

    ``integer_zero`` gives 0 for integers that do not fit.
    """
    if kind == "integer":
        whole = stripped(value).try_cast("double").try_cast("long")
        return F.coalesce(whole, F.lit(0).cast("long")) if integer_zero else whole
    if kind == "float":
        return stripped(value).try_cast("double")
    if kind == "boolean":
        return to_boolean(value)
    if kind == "date":
        from ledgerlens.functions import dates

        return dates.standard_date(value)
    return value


def file_safe(name: Column) -> Column:
    """Blanks become underscores; full stops and commas go."""
    return F.translate(name, " .,", "_")


def cell_type(value: Column) -> Column:
    """``empty``, ``number``, ``date`` or ``text``."""
    bare = stripped(value)
    dated = bare.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}") | bare.rlike(r"\d{4}[/-]\d{1,2}[/-]\d{1,2}")
    return F.when(value.isNull() | (bare == ""), "empty").when(bare.try_cast("double").isNotNull(), "number").when(dated, "date").otherwise("text")
