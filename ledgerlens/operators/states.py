"""Profiles of columns that can be merged: what a file adds to a profile is one row a column, so a new file costs only itself.

Counts, least and largest values, sums and moments merge exactly. How many different values there are is a HyperLogLog sketch (exact for
some hundred, off by some 2 % beyond), quantiles are a KLL sketch (ranks off by some 1.7 %), and the commonest values are a summary
that is exact while a column has at most three quarters of ``TRACKED`` different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions import cleaning, dates
from ledgerlens.operators.profile import DATED, KINDS, KINDS_SHARE, NOT_NUMERIC

#: Values whose counts a column's summary of the commonest ones keeps, and how many of them are told.
TRACKED, TOLD = 512, 5
WORDS = [*cleaning.TRUE_WORDS, *cleaning.FALSE_WORDS]


def column_states(values: DataFrame, keys: list[str], column: str = "column_name", value: str = "value") -> DataFrame:
    """(keys, column, state) of long cells: one grouped aggregate with partial states in each task, so no cell is shuffled.

    A cell without a value, or with a word for a missing one, counts as missing only.
    """
    at = values.select(*keys, F.col(column).alias("column_name"), cleaning.missing_to_null(F.col(value).cast("string")).alias("v"))
    at = at.withColumn("number", F.col("v").try_cast("double")).withColumn("odd", F.col("v").isNotNull() & F.col("number").isNull()).withColumn("word", F.lower("v"))
    at = at.withColumn("number", F.when(~F.isnan("number") & (F.abs("number") < float("inf")), F.col("number")))
    # what is a number, or has no digit, is no date
    stamp = F.when(F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}([ T]|$)"), F.substring("v", 1, 10).try_cast("date")).otherwise(dates.parse_date(F.col("v")))
    at = at.withColumn("day", F.when(F.col("odd") & F.col("v").rlike(r"\d"), stamp))
    known = F.col("word").isin(WORDS)
    return at.groupBy(*keys, "column_name").agg(
        F.count("v").alias("non_null"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.count_if("odd").alias("odd"), F.bool_and(F.coalesce(F.col("number") == F.floor("number"), F.lit(True))).alias("whole"),
        # at most the fixed words, so the set stays small
        F.bool_and(F.coalesce(known, F.lit(True))).alias("wordy"), F.collect_set(F.when(known, F.col("word"))).alias("words"),
        F.count("day").alias("dated"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count("number").alias("n_numbers"), F.min("number").alias("min_value"), F.max("number").alias("max_value"), F.avg("number").alias("mean_value"), (F.var_pop("number") * F.count("number")).alias("spread"),
        F.min(F.length("v")).alias("min_length"), F.max(F.length("v")).alias("max_length"), F.sum(F.length("v")).alias("sum_length"),
        F.hll_sketch_agg("v").alias("distinct"), F.kll_sketch_agg_double("number").alias("quantiles"), F.expr(f"approx_top_k_accumulate(v, {TRACKED}) FILTER (WHERE v IS NOT NULL)").alias("common"),
    )


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """The states of the same column taken together, for coarser ``keys`` (all files of a company, say, or all files)."""
    by = Window.partitionBy(*keys, "column_name")
    # deviations from the common mean: those within a state, and that of its own mean
    mean = F.try_divide(F.sum(F.col("mean_value") * F.col("n_numbers")).over(by), F.sum("n_numbers").over(by))
    at = states.withColumn("common_mean", mean)
    away = F.col("mean_value") - F.col("common_mean")
    return at.groupBy(*keys, "column_name").agg(
        *[F.sum(c).alias(c) for c in ("non_null", "n_missing", "odd")], F.bool_and("whole").alias("whole"), F.bool_and("wordy").alias("wordy"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("words")))).alias("words"),
        F.sum("dated").alias("dated"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("n_numbers").alias("n_numbers"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.max("common_mean").alias("mean_value"), F.sum(F.col("spread") + away * away * F.col("n_numbers")).alias("spread"),
        F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"), F.sum("sum_length").alias("sum_length"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.expr("approx_top_k_combine(common)").alias("common"),
    )


def kind_of(n: Column, distinct: Column, by_name: bool = True) -> Column:
    """The inferred type of a state, by the rules of ``profile.infer_types``; ``n`` and ``distinct`` count values and different ones."""
    named = dates.is_date_name(F.col("column_name")) if by_name else F.lit(False)
    few = (distinct / n < KINDS_SHARE) & (distinct < KINDS)
    return (
        F.when(n == 0, "unknown").when(F.col("wordy") & (F.size("words") <= 2), "boolean").when(named | (F.col("dated") / n > DATED), "date")
        .when((F.col("odd") / n < NOT_NUMERIC) & F.col("whole"), "integer").when(F.col("odd") / n < NOT_NUMERIC, "float").when(few, "categorical").otherwise("text")
    )


def described(states: DataFrame, keys: list[str], by_name: bool = True) -> DataFrame:
    """(keys, column_name, data_type, non_null, n_missing, missing_pct, distinct_values, least, largest, mean, median and deviation of
    numbers, lengths, first and last day, top): states as a profile, a row a column. ``top`` has (value, n) of the commonest values."""
    n = F.col("non_null")
    number, values = F.col("n_numbers") > 0, F.hll_sketch_estimate("distinct")
    median = F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)))
    top = F.transform(F.expr(f"approx_top_k_estimate(common, {TOLD})"), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n")))
    return states.select(
        *keys, "column_name", kind_of(n, values, by_name).alias("data_type"), n, "n_missing", F.round(cleaning.safe_percentage(F.col("n_missing"), n + F.col("n_missing")), 2).alias("missing_pct"),
        values.alias("distinct_values"), "min_value", "max_value", F.round("mean_value", 4).alias("mean_value"), median.alias("median_value"),
        F.when(number, F.round(F.when(F.col("n_numbers") > 1, F.sqrt(F.col("spread") / (F.col("n_numbers") - 1))).otherwise(0.0), 4)).alias("std_value"),
        "min_length", "max_length", F.round(F.col("sum_length") / n, 2).alias("avg_length"), "first_day", "last_day", top.alias("top"),
    )
