"""What was submitted against what was required: semi and anti joins, period coverage, rule bundles, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Completeness from which a sheet is in order, and from which it is fair.
HIGH, MEDIUM = 80, 60


def coverage(required: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Each required row with ``present``: whether its key was found. Keys are compared trimmed and in lower case.

    Found keys are made distinct first, so the join cannot multiply rows. A null key is not found.
    """
    name = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    keys = found.select(name(key).alias("__key")).distinct()
    out = required.select(F.struct(*[F.col(f"`{c}`") for c in required.columns]).alias("__row"), name(key).alias("__want"))
    both = out.join(keys, F.col("__want") == F.col("__key"), "left")
    kept = [F.col("__row").getField(c).alias(c) for c in required.columns if c != "present"]
    return both.select(*kept, F.col("__key").isNotNull().alias("present"))


def coverage_ratio(covered: DataFrame, *groups: str) -> DataFrame:
    """Share of required keys present, by group; without groups one row, 1 where none is required."""
    out = covered.groupBy(*groups).agg(F.count("*").alias("n_required"), F.coalesce(F.sum(F.col("present").cast("long")), F.lit(0)).alias("n_present"))
    return out.withColumn("coverage", F.coalesce(F.round(F.try_divide(F.col("n_present").cast("double"), F.col("n_required")), 4), F.lit(1.0)))


def coverage_level(n_required: Column, n_present: Column) -> Column:
    return F.when(n_present >= n_required, "FULL").when(n_present > 0, "PARTIAL").otherwise("MISSING")


def completeness_level(pct: Column) -> Column:
    return F.when(pct >= HIGH, "HIGH").when(pct >= MEDIUM, "MEDIUM").otherwise("LOW")


def completeness(scores: DataFrame, group: str, pct: str) -> DataFrame:
    """Per group the mean completeness of its sheets, its level, and how many sheets are below HIGH; no scores count as 0."""
    out = scores.groupBy(group).agg(F.coalesce(F.avg(pct), F.lit(0.0)).alias("average_completeness"), F.count_if(F.col(pct) < HIGH).alias("sheets_with_issues"))
    return out.withColumn("completeness_level", completeness_level(F.col("average_completeness")))


def file_count(submitted: Column, expected: Column) -> Column:
    """(submitted, expected, ratio, status); the ratio is 0 where nothing is expected."""
    ratio = F.when(expected > 0, F.round(submitted / expected, 4)).otherwise(0.0)
    return F.struct(submitted.alias("submitted"), expected.alias("expected"), ratio.alias("ratio"), F.when(submitted >= expected, "SUFFICIENT").otherwise("INSUFFICIENT").alias("status"))


def consistency(df: DataFrame, group: str, kind: str) -> DataFrame:
    """Per group the number of kinds, the commonest one (ties: the first by name) and CONSISTENT or MIXED."""
    counted = df.groupBy(group, kind).agg(F.count("*").alias("n"))
    return counted.groupBy(group).agg(
        F.count("*").alias("n_kinds"), F.min(F.struct((-F.col("n")).alias("n"), F.col(kind).alias("k"))).getField("k").alias("primary_kind"),
    ).withColumn("status", F.when(F.col("n_kinds") == 1, "CONSISTENT").otherwise("MIXED"))


def attached(files: DataFrame, requirements: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Each file with all requirements of its group, as one array of structs: one row a file, none is multiplied.

    The requirements of a group are those of one request list, which a reader writes; a file of a
    group without any gets an empty array.
    """
    lists = requirements.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("requirements"))
    return files.join(lists, group, "left").withColumn("total_requirements", F.coalesce(F.size("requirements"), F.lit(0)))


def rule_checks(sheets: DataFrame, template: DataFrame, entities: DataFrame, years: DataFrame, required_entities: DataFrame, required_years: DataFrame, group: str) -> DataFrame:
    """One row a group with all checks: file count, entities, years, structure and completeness.

    ``sheets`` has (group, file_name, structure, completeness), ``template`` (group, expected_files), the
    others a group with an entity or a year. A group is a row of ``template``.
    """
    n = sheets.groupBy(group).agg(F.count_distinct("file_name").alias("submitted"))
    name = lambda c: F.lower(F.trim(F.col(c)))

    def share(required: DataFrame, found: DataFrame, key: str, key_of, out: str) -> DataFrame:
        want = required.select(group, key_of(key).alias("k")).distinct()
        have = found.select(group, key_of(key).alias("k")).distinct().withColumn("hit", F.lit(1))
        return want.join(have, [group, "k"], "left").groupBy(group).agg(F.count("*").alias(f"{out}_required"), F.count("hit").alias(f"{out}_found"))

    checks = (
        template.select(group, "expected_files").join(n, group, "left")
        .join(share(required_entities, entities, "entity", name, "entities"), group, "left").join(share(required_years, years, "year", F.col, "years"), group, "left")
        .join(consistency(sheets, group, "structure").withColumnRenamed("status", "consistency"), group, "left").join(completeness(sheets, group, "completeness"), group, "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    counted = file_count(zero("submitted"), F.col("expected_files").cast("long"))
    return checks.select(
        group, counted["submitted"].alias("submitted"), counted["expected"].alias("expected"), counted["ratio"].alias("file_ratio"), counted["status"].alias("file_status"),
        F.coalesce(F.round(F.try_divide(zero("entities_found").cast("double"), zero("entities_required")), 4), F.lit(1.0)).alias("entity_coverage"),
        F.when(zero("years_required") == 0, "FULL").otherwise(coverage_level(zero("years_required"), zero("years_found"))).alias("year_coverage"),
        F.coalesce("consistency", F.lit("MIXED")).alias("consistency"), F.coalesce("primary_kind", F.lit("unknown")).alias("primary_structure"),
        F.round(F.coalesce("average_completeness", F.lit(0.0)), 4).alias("average_completeness"), F.coalesce("completeness_level", F.lit("LOW")).alias("completeness_level"),
    )


def latest_version(df: DataFrame, name: str, version: str) -> DataFrame:
    """The row with the largest version of each name, by a grouped maximum: no sort, partial sums before the shuffle."""
    rest = [c for c in df.columns if c != name]
    best = df.groupBy(name).agg(F.max(F.struct(F.col(version), *[F.col(c) for c in rest if c != version])).alias("best"))
    return best.select(name, *[F.col("best").getField(c).alias(c) for c in rest])


def next_versions(names: DataFrame, tracker: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """Each name with the version after its last; 1 for a name that the tracker lacks."""
    last = tracker.groupBy(name).agg(F.max(version).alias("last"))
    return names.join(last, name, "left").withColumn(version, F.coalesce(F.col("last"), F.lit(0)) + 1).drop("last")


def numbered_duplicates(df: DataFrame, name: str, order: list[str], groups: list[str]) -> DataFrame:
    """``name``, ``name_1``, ``name_2`` … within each group, in the given order, as ``unique_name``.

    For any number of rows: names are told apart by their place, so a name that is written ``x_1``
    already may come twice; ``unique_names`` looks again.
    """
    k = F.row_number().over(Window.partitionBy(*groups, name).orderBy(*order)) - 1
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    numbered = df.select(row, F.col(name).alias("__name"), k.alias("__k"))
    kept = [F.col("__row").getField(c).alias(c) for c in df.columns if c != "unique_name"]
    return numbered.select(*kept, F.when(F.col("__k") == 0, F.col("__name")).otherwise(F.concat_ws("_", "__name", F.col("__k").cast("string"))).alias("unique_name"))


def unique_names(names: Column) -> Column:
    """The names of a header, each made different from all before it: ``x``, ``x_1``, ``x_2`` …, the first that is not there yet."""
    def add(done: Column, name: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(done) + 1), lambda k: F.concat_ws("_", name, k.cast("string")))
        free = F.get(F.filter(tries, lambda t: ~F.array_contains(done, t)), 0)
        return F.array_append(done, F.when(F.array_contains(done, name), free).otherwise(name))

    return F.aggregate(names, F.array().cast("array<string>"), add)


def dealt_evenly(df: DataFrame, n_sections: int, order: list[str], groups: list[str]) -> DataFrame:
    """Rows of each group over sections of max(1, total // n) rows; the last section takes the rest."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
    total = F.count("*").over(Window.partitionBy(*groups))
    size = F.greatest(F.lit(1), F.floor(total / n_sections))
    return df.withColumn("section", F.least(F.floor(rank / size), F.lit(n_sections - 1)).cast("long"))
