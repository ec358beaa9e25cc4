"""Column profiles: one aggregate over the table with partial results, turned into a row for each column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlens.functions import cleaning, dates

# Shares and counts that decide a column's kind.
DATED, NOT_NUMERIC, KINDS_SHARE, KINDS = 0.5, 0.1, 0.5, 100
#: The sketch that narrows a median down, and how far around the middle it looks: its ranks are off by 1 / ACCURACY at most.
ACCURACY, NARROW = 10000, 2 / 10000


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) of each cell, as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def _aggregated(df: DataFrame, columns: list[str], measures: dict, named: dict | None = None) -> DataFrame:
    """A row a column of ``measures`` (name: function of a column; ``named``: of its name), from one aggregate over the table: no cell is shuffled."""
    measures = measures | (named or {})
    one = df.agg(*[f(c if name in (named or {}) else F.col(f"`{c}`")).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in measures.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{name}_{i}").alias(name) for name in measures]) for i, c in enumerate(columns)])))


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.StringType, T.BinaryType))


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: n_rows, n_missing and missing_pct (two places; 0 for an empty table). No shuffle but of one row a task.

    Only columns of text can hold words for missing values; of others nulls are counted.
    """
    of = lambda c: F.count_if((cleaning.missing_to_null(F.col(f"`{c}`").cast("string")) if _is_text(df, c) else F.col(f"`{c}`")).isNull())
    found = _aggregated(df, columns, {"n_rows": lambda c: F.count(F.lit(1))}, {"n_missing": of})
    return found.withColumn("missing_pct", F.round(cleaning.safe_percentage(F.col("n_missing"), F.col("n_rows")), 2))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, distinct_values): cells are made distinct within each task before they are shuffled."""
    return unpivoted(df, columns).where("value is not null").distinct().groupBy("column_name").agg(F.count("*").alias("distinct_values"))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, median_value): exact. A sketch narrows the middle down, and only values that close to it are counted."""
    v = lambda c: F.col(f"`{c}`").cast("double")
    near = F.array(*[F.lit(0.5 - NARROW), F.lit(0.5 + NARROW)])
    bounds = _aggregated(df, columns, {"n": F.count, "near": lambda c: F.percentile_approx(c.cast("double"), near, F.lit(ACCURACY))})
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), v(c).alias("v")) for c in columns]))).where("v is not null")
    # one row a column, so the broadcast is as small as the list of columns
    kept = cells.join(F.broadcast(bounds), "column_name").withColumn("v", F.when(F.col("v") < F.get("near", F.lit(0)), None).otherwise(F.col("v")))
    kept = kept.where(F.col("v").isNull() | (F.col("v") <= F.get("near", F.lit(1))))
    counted = kept.groupBy("column_name", "v").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("m").over(w)).where("v is not null")
    # of n values in order the middle one, or the mean of the two in the middle
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    return upto.groupBy("column_name").agg(((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).alias("median_value"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a numeric column: counts, distinct values, least, largest, mean, median, sample deviation (0 for one value).

    Moments are one aggregate with partial sums; distinct values and the median are counted apart.
    """
    number = lambda f: lambda c: f(c.cast("double"))
    g = _aggregated(df, columns, {
        "non_null": F.count, "nulls": lambda c: F.count_if(c.isNull()), "min_value": number(F.min), "max_value": number(F.max),
        "mean_value": number(F.avg), "std_value": number(F.stddev_samp),
    })
    both = g.join(distinct_counts(df, columns), "column_name", "left").join(medians(df, columns), "column_name", "left")
    return both.select(
        "column_name", "non_null", "nulls", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "min_value", "max_value",
        F.round("mean_value", 4).alias("mean_value"), "median_value", F.round(F.coalesce("std_value", F.lit(0.0)), 4).alias("std_value"),
    )


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: the least, largest and mean length (two places)."""
    length = lambda f: lambda c: f(F.length(c).cast("long"))
    return _aggregated(df, columns, {"min_length": length(F.min), "max_length": length(F.max), "avg_length": lambda c: F.round(F.avg(F.length(c)), 2)})


def date_range(df: DataFrame, column: str) -> DataFrame:
    """(first_day, last_day, n_days): the days that a column spans, as text, and how many different ones it has."""
    day = F.col(column).cast("date")
    span = df.agg(F.date_format(F.min(day), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day"), F.countDistinct(day).alias("n_days"))
    return span


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The ``k`` commonest values of each column; equal counts by value. The window sees one row a distinct value."""
    counted = unpivoted(df, columns).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return counted.withColumn("place", place).where(F.col("place") <= k)


def first_seen_top(df: DataFrame, value: str, order: str, k: int = 10) -> DataFrame:
    """(value, n, place): the ``k`` commonest values; equal counts by where a value comes first."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = counted.orderBy(F.desc("n"), "seen", "value").limit(k)
    return best.select("value", "n", F.row_number().over(Window.orderBy(F.desc("n"), "seen", "value")).alias("place"))


def deduplicated(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def completeness(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, completeness): 100 less the mean share of nulls of the columns, two places; 100 without columns."""
    pct = [F.lit(100.0) * F.count_if(F.col(f"`{c}`").isNull()) / F.count(F.lit(1)) for c in columns]
    mean = reduce(lambda a, b: a + b, pct) / len(pct) if pct else F.lit(0.0) * F.count(F.lit(1))
    return df.groupBy(group).agg((F.lit(100.0) - mean).alias("exact")).select(group, F.round("exact", 2).alias("completeness"), "exact")


def run_summary(sheets: DataFrame, group: str | None = None) -> DataFrame:
    """Files, how many succeeded and failed, sheets, and sheets of each structure, of (file_name, status, structure) rows: a row a sheet."""
    keys = [group] if group else []
    of = lambda name: F.count_if((F.col("status") == "success") & (F.col("structure") == name)).alias(name)
    files = sheets.groupBy(*keys, "file_name", "status").agg(F.count("structure").alias("n"), *[of(k) for k in ("structured", "unstructured", "semi_structured", "unknown", "empty")])
    sums = [F.sum(c).alias(c) for c in ("structured", "unstructured", "semi_structured", "unknown", "empty")]
    return files.groupBy(*keys).agg(
        F.count("*").alias("total_files"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") != "success").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("n"))), F.lit(0)).alias("sheets_processed"), *sums,
    )


def _dated(value: Column) -> Column:
    """A text that is a date, with or without a time of day after it."""
    return value.rlike(r"^\d{4}-\d{2}-\d{2}([ T]|$)") | dates.parse_date(value).isNotNull()


def _type_measures(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, non_null, wordy, kinds, odd, whole, dated), from one aggregate.

    What a type says is not computed: a timestamp is dated, a whole number is no odd text, and only texts are parsed. A text's
    forms are projected first, so that each is made once for all measures.
    """
    words = [*cleaning.TRUE_WORDS, *cleaning.FALSE_WORDS]
    forms, measures = [], []
    for i, name in enumerate(columns):
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            forms.append(c.alias(f"c{i}"))
            one = F.count(f"c{i}")
            own = [one, one == 0, F.lit(0), one, F.lit(True), one]
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
            forms.append(c.alias(f"c{i}"))
            x, whole = F.col(f"c{i}"), isinstance(kind, T.IntegralType)
            # of numbers 0 and 1 are words, as whole ones only
            own = [F.count(x), F.bool_and(x.isin(0, 1)) if whole else F.count(x) == 0, F.count_if(x == 0).cast("boolean").cast("int") + F.count_if(x == 1).cast("boolean").cast("int"),
                   F.lit(0), F.lit(True) if whole else F.bool_and(F.coalesce(x == F.floor(x), F.lit(True))), F.lit(0)]
        else:
            text = c.cast("string")
            number = text.try_cast("double")
            # neither a number nor a text without a digit is a date
            dated = F.when(number.isNull() & text.rlike("[0-9]"), _dated(text))
            word = F.lower(F.trim(text))
            forms += [text.alias(f"c{i}"), number.alias(f"x{i}"), F.when(word.isin(words), word).alias(f"w{i}"), dated.alias(f"d{i}")]
            t, x, w = F.col(f"c{i}"), F.col(f"x{i}"), F.col(f"w{i}")
            # at most the fixed words, so the set stays small
            own = [F.count(t), F.bool_and(F.when(t.isNotNull(), w.isNotNull())), F.size(F.collect_set(w)), F.count_if(t.isNotNull() & x.isNull()), F.bool_and(F.coalesce(x == F.floor(x), F.lit(True))), F.count_if(F.col(f"d{i}"))]
        measures.append(own)
    names = ["non_null", "wordy", "kinds", "odd", "whole", "dated"]
    one = df.select(*forms).agg(*[m.alias(f"{n}_{i}") for i, own in enumerate(measures) for n, m in zip(names, own)])
    types = dict(zip(names, ["bigint", "boolean", "int", "bigint", "boolean", "bigint"]))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}_{i}").cast(types[n]).alias(n) for n in names]) for i, c in enumerate(columns)])))


def infer_types(df: DataFrame, columns: list[str], by_name: bool = True) -> DataFrame:
    """``unknown``, ``boolean``, ``date``, ``integer``, ``float``, ``categorical`` or ``text`` for each column, from all its values (not a sample).

    ``by_name``: a column whose name speaks of dates is one. One aggregate decides all but categorical
    against text, and runs at once (a row a column comes to the driver); only for columns that it leaves open distinct values are counted.
    """
    g = _type_measures(df, columns)
    n = F.col("non_null")
    named = dates.is_date_name(F.col("column_name")) if by_name else F.lit(False)
    kind = (
        F.when(n == 0, "unknown").when(F.col("wordy") & (F.col("kinds") <= 2), "boolean").when(named | (F.col("dated") / n > DATED), "date")
        .when((F.col("odd") / n < NOT_NUMERIC) & F.col("whole"), "integer").when(F.col("odd") / n < NOT_NUMERIC, "float")
    )
    decided = [(r["column_name"], r["kind"], r["non_null"]) for r in g.select("column_name", kind.alias("kind"), "non_null").collect()]
    open_ = [c for c, k, _ in decided if k is None]
    known = df.sparkSession.createDataFrame(decided, "column_name string, kind string, non_null long")
    if open_:
        known = known.join(F.broadcast(distinct_counts(df, open_)), "column_name", "left")
        few = (F.col("distinct_values") / n < KINDS_SHARE) & (F.col("distinct_values") < KINDS)
        known = known.withColumn("kind", F.coalesce("kind", F.when(few, "categorical").otherwise("text")))
    return known.select("column_name", F.col("kind").alias("inferred_type"), "non_null")


def column_profile(df: DataFrame) -> DataFrame:
    """Missing values and inferred type of every column of a table."""
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return missing_values(df, names).join(F.broadcast(infer_types(df, names)), "column_name", "left")


def cleaned(df: DataFrame, drop_duplicates: bool = False, integer_zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """A table of text columns with clean names and typed values, and its column profile.

    Names are made of word characters and different from each other; missing words become null;
    values get the inferred types, and rows may be made distinct. The profile is of what comes out.
    """
    from ledgerlens.operators.compare import unique_names

    names = df.sparkSession.range(1).select(unique_names(F.array(*[cleaning.column_name(F.lit(c), F.lit(k + 1)) for k, c in enumerate(df.columns)])).alias("n")).first()["n"]
    bare = df.toDF(*names).select(*[cleaning.missing_to_null(F.col(f"`{c}`").cast("string")).alias(c) for c in names])
    kinds = {r["column_name"]: r["inferred_type"] for r in infer_types(bare, names).collect()}
    typed = bare.select(*[cleaning.apply_type(F.col(f"`{c}`"), kinds[c], integer_zero).alias(c) for c in names])
    typed = typed.dropDuplicates() if drop_duplicates else typed
    profile = missing_values(typed, names).join(F.broadcast(df.sparkSession.createDataFrame(list(kinds.items()), "column_name string, inferred_type string")), "column_name")
    return typed, profile
