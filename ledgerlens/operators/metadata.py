"""What sheets and columns are about, without their rows: dates, entities, structures, rolled up over sheets and files.

Values come long: a row a cell with its column's name, so columns of any number of tables are described in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions import dates, entities, terms

#: Entities that are listed of a column.
LISTED = 10


def date_analysis(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, total, parsed, parse_rate, first_day, last_day, range_days, n_days, formats, granularity) of each group of texts.

    Nulls count in the total. Formats are sorted and joined by a bar. Groups without any date are there
    with nulls. The least gap is between different days that follow each other.
    """
    v = F.col(value).cast("string")
    rows = values.select(*keys, dates.lenient_date(v).alias("at"), F.when(v.isNotNull(), dates.format_label(v)).alias("format"))
    per_day = rows.groupBy(*keys, F.col("at").cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.collect_set(F.when(F.col("at").isNotNull(), F.col("format"))).alias("formats"),
        F.bool_or(F.col("at") != F.col("at").cast("date").cast("timestamp")).alias("timed"),
    )
    gap = F.datediff(F.lead("day").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("day"))), F.col("day"))
    g = per_day.withColumn("gap", gap).groupBy(*keys).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("day").isNotNull(), F.col("n"))), F.lit(0)).alias("parsed"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count("day").alias("n_days"), F.min("gap").alias("least"), F.coalesce(F.bool_or("timed"), F.lit(False)).alias("timed"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("formats")))).alias("formats"),
    )
    return g.select(
        *keys, "total", "parsed", F.round(F.try_divide(F.col("parsed").cast("double"), "total"), 4).alias("parse_rate"), "first_day", "last_day", F.datediff("last_day", "first_day").alias("range_days"),
        "n_days", F.array_join("formats", "|").alias("formats"), F.when(F.col("parsed") > 0, dates.granularity(F.col("timed"), F.col("parsed"), F.col("least"))).alias("granularity"),
    )


def period_info(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """(keys, first and last day, their years and quarters, span in days and years, years in between) of each group of dates."""
    g = days.groupBy(*keys).agg(F.min(F.col(day).cast("date")).alias("first_day"), F.max(F.col(day).cast("date")).alias("last_day"))
    first, last = F.year("first_day"), F.year("last_day")
    return g.where("first_day is not null").select(
        *keys, "first_day", "last_day", first.alias("start_year"), last.alias("end_year"), dates.quarter_label(F.col("first_day")).alias("start_quarter"), dates.quarter_label(F.col("last_day")).alias("end_quarter"),
        F.datediff("last_day", "first_day").alias("span_days"), (last - first + 1).alias("span_years"), F.sequence(first, last).alias("fiscal_years"),
    )


def entity_analysis(values: DataFrame, keys: list[str], value: str = "value", top: int = LISTED) -> DataFrame:
    """(keys, entity_count, unique_entities, primary_entity, top_entities, kinds) of each group of texts that names any entity.

    The commonest entity is the primary one, equal counts by name. ``top_entities`` has (name, count), ``kinds`` the
    kinds of the listed ones, sorted. Entities are counted with partial sums; a window sees one row an entity.
    """
    found = values.select(*keys, F.explode(entities.extract_entities(F.col(value).cast("string"))).alias("name"))
    counted = found.groupBy(*keys, "name").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "name")))
    listed = F.when(F.col("place") <= top, F.struct("place", F.col("name"), F.col("n").alias("count")))
    g = ranked.groupBy(*keys).agg(F.sum("n").alias("entity_count"), F.count("*").alias("unique_entities"), F.max(F.when(F.col("place") == 1, F.col("name"))).alias("primary_entity"), F.array_sort(F.collect_list(listed)).alias("l"))
    return g.select(
        *keys, "entity_count", "unique_entities", "primary_entity", F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("top_entities"),
        F.array_sort(F.array_distinct(F.transform("l", lambda x: terms.entity_kind(x["name"])))).alias("kinds"),
    )


def entity_columns(values: DataFrame, keys: list[str], column: str = "column_name", value: str = "value", share: float = 0.3) -> DataFrame:
    """(keys, column) of columns that hold entities: by name, or because over a share of their values name one."""
    named = entities.is_entity_name(F.col(column))
    hit = F.avg((F.size(entities.extract_entities(F.col(value).cast("string"))) > 0).cast("int"))
    return values.where(F.col(value).isNotNull()).groupBy(*keys, column).agg(hit.alias("share")).where(named | (F.col("share") > share)).select(*keys, column)


def date_columns(values: DataFrame, keys: list[str], column: str = "column_name", value: str = "value", share: float = 0.5) -> DataFrame:
    """(keys, column) of columns that hold dates: by name, or because over a share of their values are dates."""
    hit = F.avg(dates.lenient_date(F.col(value), serial=False).isNotNull().cast("int"))
    return values.where(F.col(value).isNotNull()).groupBy(*keys, column).agg(hit.alias("share")).where(dates.is_date_name(F.col(column)) | (F.col("share") > share)).select(*keys, column)


def company_info(analysed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, primary_company, all_entities, frequency) of the primary entities of a table's columns; equal counts by name."""
    n = analysed.where("primary_entity is not null").groupBy(*keys, "primary_entity").agg(F.count("*").alias("n"))
    g = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "primary_entity")).alias("m"), F.array_sort(F.collect_list("primary_entity")).alias("all_entities"))
    return g.select(*keys, F.col("m.primary_entity").alias("primary_company"), "all_entities", (-F.col("m.n")).alias("frequency"))


def structure_summary(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total_sheets, structures, has_entities, has_dates) of (structure, n_entities, n_dates) rows; structures as ``name:count`` sorted, with commas between."""
    n = sheets.groupBy(*keys, F.coalesce("structure", F.lit("unknown")).alias("structure")).agg(F.count("*").alias("n"), F.bool_or(F.col("n_entities") > 0).alias("e"), F.bool_or(F.col("n_dates") > 0).alias("d"))
    return n.groupBy(*keys).agg(
        F.sum("n").alias("total_sheets"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "structure", F.col("n").cast("string")))), ",").alias("structures"),
        F.bool_or("e").alias("has_entities"), F.bool_or("d").alias("has_dates"),
    )


def combined_entities(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entities): the distinct primary entities of all files, sorted and joined by bars."""
    return sheets.where("primary_entity is not null").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("primary_entity")), "|").alias("entities"))


def combined_periods(periods: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, period, and the rest) of period rows: of those with the same first and last year the last one holds."""
    rest = [c for c in periods.columns if c not in keys]
    named = periods.withColumn("period", F.concat_ws("-", "start_year", "end_year"))
    return named.groupBy(*keys, "period").agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "period", *[F.col("r").getField(c).alias(c) for c in rest])


def column_metadata(profile: DataFrame, numbers: DataFrame, lengths: DataFrame, spans: DataFrame, tops: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null, missing_pct, detail): what may be told of each column, by its kind, as JSON.

    Numbers have their least, largest, mean and deviation, texts their lengths, dates their first and last
    day, categories how many and the commonest; no column has rows.
    """
    k = F.col("inferred_type")
    detail = (
        F.when(k.isin("integer", "float"), F.to_json(F.struct(F.col("min_value").alias("min"), F.col("max_value").alias("max"), F.col("mean_value").alias("mean"), F.col("std_value").alias("std"))))
        .when(k == "text", F.to_json(F.struct("min_length", "max_length", "avg_length")))
        .when(k == "date", F.to_json(F.struct(F.col("first_day").alias("min_date"), F.col("last_day").alias("max_date"))))
        .when(k == "categorical", F.to_json(F.struct(F.size("top").alias("n_top"), F.col("top").alias("top_categories"))))
    )
    best = tops.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("top"))
    both = profile.join(numbers, "column_name", "left").join(lengths, "column_name", "left").join(spans, "column_name", "left").join(best, "column_name", "left")
    return both.select("column_name", k.alias("data_type"), profile["n_rows"], "missing_pct", detail.alias("detail"))


def sheet_metadata(tables: DataFrame, trees: DataFrame, keys: list[str]) -> DataFrame:
    """What is told of sheets that have a table, a tree of keys, or both: a full join of the two, a row a sheet."""
    return tables.join(trees, keys, "full").withColumn("has_data", F.lit(True))
