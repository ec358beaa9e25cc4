"""Results of any shape as VARIANT values: trees of keys, rows of tables whose columns differ, and whole files. Spark builds them, and
``variant_get`` reads them by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions import cleaning
from ledgerlens.operators import grid, keyvalue
from ledgerlens.operators.grid import REGION, SHEET

#: Name under which an object keeps the value that stands at its own path.
OWN = "_value"
#: Levels of a tree of keys: region, section, subsection and key.
TREE_DEPTH = 4


def variant(value: Column) -> Column:
    """A text, number or truth value as a VARIANT; null stays null."""
    return value.cast("variant")


def _object(entries: Column) -> Column:
    return F.to_variant_object(F.map_from_entries(entries))


def nested(rows: DataFrame, doc: list[str], depth: int | None = None) -> DataFrame:
    """(doc, tree): the VARIANT object that rows (doc, path, value, pos) spell, a row a document.

    ``path`` holds the names from the root on, ``value`` is a VARIANT, and of a repeated path the value with the largest ``pos``
    holds. A row with a null ``pos`` only says that there is an object at its path, so it may be empty. Where a value stands at
    the path of an object, the object keeps it as ``_value``. A null value is a VARIANT null. Rows with an empty or null path count for nothing,
    but their document is there. Objects are put together from the deepest level up; a document's rows come together
    once, and each level groups where they are. ``depth`` is the longest path; without it one job looks for it. Longer ones raise an error.
    A document has to fit in one VARIANT (128 MB).
    """
    if depth is None:
        depth = rows.agg(F.max(F.size("path"))).first()[0] or 0
    path, length = F.coalesce("path", F.expr("cast(array() as array<string>)")), F.size("path")
    path = F.when(F.size(path) <= depth, path).otherwise(F.raise_error(F.format_string("a path of %d names, the depth is %d", F.size(path), F.lit(depth))))
    none = F.expr("cast(array() as array<struct<name: string, value: variant>>)")
    left = rows.select(*doc, path.alias("path"), "value", "pos", F.col("pos").isNull().alias("object"), none.alias("entries")).repartition(*[F.col(c) for c in doc])
    for level in range(depth, -1, -1):
        left = left.groupBy(*doc, "path").agg(F.max_by("value", "pos").alias("value"), F.max("pos").alias("pos"), F.bool_or("object").alias("object"), F.flatten(F.collect_list("entries")).alias("entries"))
        if level:
            # paths of this length become entries of the objects above them; shorter ones wait
            own = F.when(F.col("pos").isNotNull(), F.array(F.struct(F.lit(OWN).alias("name"), "value")))
            whole = F.when(F.col("object"), _object(F.coalesce(F.concat("entries", own), "entries"))).otherwise(F.col("value"))
            entry = F.array(F.struct(F.element_at("path", -1).alias("name"), whole.alias("value")))
            here = length == level
            left = left.select(
                *doc, F.when(here, F.slice("path", 1, level - 1)).otherwise(F.col("path")).alias("path"), F.when(~here, F.col("value")).alias("value"),
                F.when(~here, F.col("pos")).alias("pos"), (here | F.col("object")).alias("object"), F.when(here, entry).otherwise(F.col("entries")).alias("entries"),
            )
    return left.select(*doc, _object(F.col("entries")).alias("tree"))


def region_keys(cells: DataFrame, found: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(file_path, sheet_name, region, section, subsection, key, value, pos): ``keyvalue.tree`` of each key-value region by itself.

    ``found`` are the regions of ``grid.region_types``. Regions of a sheet are named ``Region_1`` on, in their order; what is outside of
    them is left out, and a column counts from its region's first. A sheet without such a region is read as a whole, with a null
    region; of ``whole`` (file_path, sheet_name), if given, only those.
    """
    pairs = found.where("kind = 'key_value'").withColumn("region", F.concat(F.lit("Region_"), F.row_number().over(Window.partitionBy(*SHEET).orderBy("region_id")).cast("string")))
    inside = grid.region_cells(cells.select(*SHEET, "row_idx", "col_idx", "value", "vtype"), pairs).join(pairs.select(*REGION, "region"), REGION)
    inside = inside.select(*SHEET, "region", "row_idx", (F.col("col_idx") - F.col("min_col")).cast("int").alias("col_idx"), "value")
    rest = cells.join(pairs.select(*SHEET).distinct(), SHEET, "left_anti")
    if whole is not None:
        rest = rest.join(whole.select(*SHEET).distinct(), SHEET, "left_semi")
    rest = rest.select(*SHEET, F.lit(None).cast("string").alias("region"), "row_idx", "col_idx", "value")
    return keyvalue.tree(inside.unionByName(rest), [*SHEET, "region"])


def key_rows(found: DataFrame, doc: list[str], above: Column | None = None) -> DataFrame:
    """(doc, path, value, pos) of a tree of keys for ``nested``; ``above`` are the names that a row's path starts with.

    Texts between keys are a list under ``_content``, in their order. ``found`` may have a ``region``.
    """
    names = [F.col(c) for c in ("region", "section", "subsection") if c in found.columns]
    path = F.array_compact(F.array(*names, "key"))
    path = path if above is None else F.concat(above, path)
    at = found.select(*doc, path.alias("path"), "key", "value", "pos")
    text = F.col("key").eqNullSafe(F.lit(keyvalue.TEXT_KEY))
    # one pass over the tree: what a path has are texts, keys or a header
    at = at.select(*doc, "path", text.alias("text"), F.col("key").isNull().alias("head"), "key", "value", "pos").groupBy(*doc, "path", "text", "head").agg(
        F.array_sort(F.collect_list(F.when(F.col("text"), F.struct("pos", "value")))).alias("t"), F.max_by(F.when(~F.col("text"), F.col("value")), F.when(F.col("key").isNotNull(), F.col("pos"))).alias("value"),
        F.max(F.when(F.col("key").isNotNull(), F.col("pos"))).alias("pos"),
    )
    value = F.when(F.col("text"), F.to_variant_object(F.transform("t", lambda x: x["value"]))).otherwise(variant(F.col("value")))
    return at.select(*doc, "path", value.alias("value"), F.when(F.col("text"), F.lit(0)).otherwise(F.col("pos")).cast("long").alias("pos"))


def key_trees(found: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, tree): the rows of ``keyvalue.tree`` or ``region_keys`` as one VARIANT a document."""
    return nested(key_rows(found, doc), doc, TREE_DEPTH if "region" in found.columns else TREE_DEPTH - 1)


def typed(value: Column, kind: Column) -> Column:
    """A cell as what its column's type says: a whole number, a number, a truth value, or text; what can't be that stays text, and words for a missing value are null."""
    v = cleaning.missing_to_null(value)
    number = v.try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    whole = F.coalesce(v.try_cast("bigint"), F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), number.cast("bigint")))
    return F.coalesce(
        F.when(kind == "integer", variant(whole)), F.when(kind.isin("integer", "float"), variant(number)), F.when(kind == "boolean", variant(cleaning.to_boolean(v))), variant(v))


def records(values: DataFrame, columns: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """(keys, row_no, record): each row of tables as a VARIANT object, so tables with different columns are one table.

    ``values`` has (keys, column_name, row_no, value), ``columns`` (keys, column_name, data_type). Rows are counted from 1; what has a smaller
    number is no row. A row that lacks a column's cell lacks its name; a missing value is a VARIANT null. Values are ``typed``.
    """
    at = values.where("row_no > 0").join(columns.select(*keys, "column_name", "data_type"), [*keys, "column_name"], "left")
    cell = F.struct(F.col("column_name").alias("name"), typed(F.col("value"), F.coalesce("data_type", F.lit("text"))).alias("value"))
    return at.groupBy(*keys, "row_no").agg(_object(F.collect_list(cell)).alias("record"))


def told(rows: DataFrame, doc: list[str], above: list[Column], names: dict[str, str]) -> DataFrame:
    """(doc, path, value, pos) for ``nested``: columns of each row under ``above``; ``names`` says from which column each name is. A null stays, as null."""
    fields = F.array(*[F.struct(F.lit(name).alias("name"), variant(F.col(c)).alias("value")) for name, c in names.items()])
    at = rows.select(*doc, F.array(*above).cast("array<string>").alias("above"), F.explode(fields).alias("x"))
    return at.select(*doc, F.concat("above", F.array("x.name")).alias("path"), F.col("x.value").alias("value"), F.lit(0).cast("long").alias("pos"))
