"""Requirements of request lists taken together: what is asked for, and what data should be there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import terms


def template(df: DataFrame, keys: list[str], requirement: str) -> DataFrame:
    """(keys, kind, value): the different files, entities and periods that requirements (``terms.requirement``) refer to."""
    r = F.col(requirement)
    pairs = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    found = F.concat(pairs("file", r["files"]), pairs("entity", r["entities"]), pairs("period", F.transform(r["periods"], lambda p: p["raw"])))
    return df.select(*keys, F.explode(found).alias("f")).select(*keys, "f.kind", "f.value").distinct()


def expectations(df: DataFrame, keys: list[str], requirement: str) -> DataFrame:
    """(keys, should_have_financials, expected_columns): whether any kind of data is a financial one, and all kinds of data and
    keywords, sorted. Dates and entities are always expected."""
    r = F.col(requirement)
    money = F.exists(r["data_types"], lambda t: terms.any_of(t, terms.FINANCIAL))
    g = df.groupBy(*keys).agg(F.bool_or(money).alias("should_have_financials"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(r["data_types"], r["keywords"]))))).alias("expected_columns"))
    return g
