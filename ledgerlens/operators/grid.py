"""Regions of cell grids: found, tested for tables and key-value layouts, and taken out as tables.

Cells are long: (file_path, sheet_name, row_idx, col_idx, value, vtype), one row a cell.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.cleaning import cell_type, stripped
from ledgerlens.operators.components import components
from ledgerlens.store import written

SHEET = ["file_path", "sheet_name"]
REGION = [*SHEET, "region_id"]
# What a header has to score, how many rows and columns are tried, and what counts as a filled table.
HEADER_SCORE, SCAN, FILL, FILL_ROWS = 0.7, 20, 0.5, 10
# Patterns of header cells, and words that a key often holds.
HEADER_PATTERNS = [
    "^[A-Z]",
    "(?i)(name|id|date|time|value|amount|total|count|type|status)",
    "(?i)(description|category|code|number|qty|quantity|price)",
]
KEY_WORDS = "name|id|date|value|type"


def filled(value: Column) -> Column:
    return value.isNotNull() & (stripped(value) != "")


#: Rows of a strip in which equal runs are put together, and in which regions are numbered; rows and columns of a tile in which cells meet regions.
STRIP, TILE_ROWS, TILE_COLS = 4096, 64, 16
#: Rectangles of a sheet that one task unites; those of a larger sheet are united by joins.
RECTANGLES = 100_000
#: What a row number is multiplied by to name a place by one number.
ROW = 1 << 31


def rectangles(cells: DataFrame) -> DataFrame:
    """(file_path, sheet_name, lo, hi, top, bottom): filled cells as rectangles: runs of neighbours in a row, united with the same run
    in the rows below within a strip. A full table of a million rows is some hundred rectangles."""
    spots = cells.where(filled(F.col("value"))).select(*SHEET, "row_idx", "col_idx")
    # a cell that is there twice has one rank
    step = F.col("col_idx") - F.dense_rank().over(Window.partitionBy(*SHEET, "row_idx").orderBy("col_idx"))
    runs = spots.withColumn("run", step).groupBy(*SHEET, "row_idx", "run").agg(F.min("col_idx").alias("lo"), F.max("col_idx").alias("hi"))
    strip = F.floor(F.col("row_idx") / STRIP)
    down = F.col("row_idx") - F.row_number().over(Window.partitionBy(*SHEET, "lo", "hi", "strip").orderBy("row_idx"))
    return runs.withColumn("strip", strip).withColumn("down", down).groupBy(*SHEET, "lo", "hi", "strip", "down").agg(
        F.min("row_idx").alias("top"), F.max("row_idx").alias("bottom")).drop("strip", "down")


REGIONS = "file_path string, sheet_name string, region_id int, min_row int, max_row int, min_col int, max_col int, area long"


def regions(cells: DataFrame, rectangles_in_task: int = RECTANGLES) -> DataFrame:
    """(file_path, sheet_name, region_id, min_row, max_row, min_col, max_col, area) of cells that touch by a side.

    Regions of one cell are left out; the others are numbered from 0 by their first cell, row by row. Rectangles are
    written first. A sheet of at most ``rectangles_in_task`` is united in one task, a larger one by joins of rectangles that
    touch and by components over all tasks.
    """
    found = written(rectangles(cells))
    large = found.groupBy(*SHEET).agg(F.count("*").alias("n")).where(F.col("n") > rectangles_in_task).select(*SHEET)
    if large.limit(1).count() == 0:
        return found.groupBy(*SHEET).applyInPandas(_united, REGIONS)
    small = found.join(large, SHEET, "left_anti").groupBy(*SHEET).applyInPandas(_united, REGIONS)
    return small.unionByName(_united_by_joins(found.join(large, SHEET, "left_semi")))


def _united(parts: pd.DataFrame) -> pd.DataFrame:
    """Unites the rectangles of a sheet where one ends in the row above another that overlaps it."""
    parts = parts.sort_values(["top", "lo"]).reset_index(drop=True)
    root = list(range(len(parts)))

    def first(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    lo, hi = parts["lo"].tolist(), parts["hi"].tolist()
    above = {row: g.sort_values("lo").index.tolist() for row, g in parts.groupby("bottom")}
    for row, g in parts.groupby("top"):
        over, at = above.get(row - 1, []), 0
        for k in g.index:
            while at < len(over) and hi[over[at]] < lo[k]:
                at += 1
            j = at
            while j < len(over) and lo[over[j]] <= hi[k]:
                a, b = sorted((first(over[j]), first(k)))
                root[b] = a
                j += 1
    parts["root"] = [first(k) for k in range(len(parts))]
    parts["area"] = (parts["hi"] - parts["lo"] + 1) * (parts["bottom"] - parts["top"] + 1)
    out = parts.groupby("root").agg(
        file_path=("file_path", "first"), sheet_name=("sheet_name", "first"), min_row=("top", "min"), max_row=("bottom", "max"), min_col=("lo", "min"), max_col=("hi", "max"), area=("area", "sum"),
    )
    out = out[out["area"] > 1].reset_index(drop=True)
    out["region_id"] = range(len(out))
    return out[[c.split()[0] for c in REGIONS.split(", ")]]


def _united_by_joins(parts: DataFrame) -> DataFrame:
    """The same for sheets of any size. A rectangle is named by the place of its first cell, so the least name of a region is
    its first cell, and regions are numbered strip by strip."""
    named = parts.withColumn("node", F.col("top").cast("long") * ROW + F.col("lo"))
    columns = F.sequence(F.floor(F.col("lo") / TILE_COLS), F.floor(F.col("hi") / TILE_COLS))
    tiled = named.select(*SHEET, "node", "lo", "hi", "top", "bottom", F.explode(columns).alias("tile"))
    upper = tiled.select(*SHEET, (F.col("bottom") + 1).alias("row"), "tile", F.col("node").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    lower = tiled.select(*SHEET, F.col("top").alias("row"), "tile", F.col("node").alias("b"), "lo", "hi")
    edges = upper.join(lower, [*SHEET, "row", "tile"]).where("a_lo <= hi AND lo <= a_hi").select(*SHEET, "a", "b")
    roots = components(edges, SHEET)
    both = named.join(roots, [*SHEET, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    area = (F.col("hi") - F.col("lo") + 1).cast("long") * (F.col("bottom") - F.col("top") + 1)
    g = both.groupBy(*SHEET, "root").agg(F.min("top").alias("min_row"), F.max("bottom").alias("max_row"), F.min("lo").alias("min_col"), F.max("hi").alias("max_col"), F.sum(area).alias("area")).where("area > 1")
    g = written(g.withColumn("strip", F.floor(F.col("min_row") / STRIP)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*SHEET).orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = g.groupBy(*SHEET, "strip").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    place = F.row_number().over(Window.partitionBy(*SHEET, "strip").orderBy("root")) - 1
    numbered = g.withColumn("place", place).join(starts, [*SHEET, "strip"])
    return numbered.select(*SHEET, (F.col("before") + F.col("place")).cast("int").alias("region_id"), "min_row", "max_row", "min_col", "max_col", "area")


def region_cells(cells: DataFrame, found: DataFrame) -> DataFrame:
    """The filled cells within each region's bounds, with the bounds.

    Cells and regions meet in the tile of the sheet that a cell is in, so the work is that of the cells and of the tiles which
    regions cover, not of all cells of a sheet with all of its regions.
    """
    tile = lambda c, size: F.floor(F.col(c) / size)
    over = lambda a, b, size: F.explode(F.sequence(tile(a, size), tile(b, size)))
    bounds = found.select(*REGION, "min_row", "max_row", "min_col", "max_col", over("min_row", "max_row", TILE_ROWS).alias("tile_row")).select("*", over("min_col", "max_col", TILE_COLS).alias("tile_col"))
    placed = cells.where(filled(F.col("value"))).withColumn("tile_row", tile("row_idx", TILE_ROWS)).withColumn("tile_col", tile("col_idx", TILE_COLS))
    inside = F.col("row_idx").between(F.col("min_row"), F.col("max_row")) & F.col("col_idx").between(F.col("min_col"), F.col("max_col"))
    return placed.join(bounds, [*SHEET, "tile_row", "tile_col"]).where(inside).drop("tile_row", "tile_col").withColumn("kind", cell_type(F.col("value")))


def header_scores(inside: DataFrame) -> DataFrame:
    """(region, row_idx, n_filled, score) of each row: the mean of the shares of text cells and of cells whose kind
    differs from the one below (both of the region's width), of distinct cells and of cells like a header. A region's
    last row has no row below, so three parts only."""
    after = F.lead(F.struct("row_idx", "kind")).over(Window.partitionBy(*REGION, "col_idx").orderBy("row_idx"))
    change = (F.col("after.row_idx") == F.col("row_idx") + 1) & (F.col("after.kind") != F.col("kind"))
    like = F.lit(False)
    for p in HEADER_PATTERNS:
        like = like | F.col("value").rlike(p)
    rows = inside.withColumn("after", after).groupBy(*REGION, "row_idx").agg(
        F.count("*").alias("n_filled"), F.count_if(_is_text()).alias("texts"), F.size(F.collect_set("value")).alias("kinds"), F.count_if(like).alias("like"),
        F.count_if(change).alias("change"), F.max(F.col("max_col") - F.col("min_col") + 1).alias("width"), F.max("max_row").alias("max_row"),
    )
    three = F.col("texts") / F.col("width") + F.col("kinds") / F.col("n_filled") + F.col("like") / F.col("n_filled")
    score = F.when(F.col("row_idx") < F.col("max_row"), (three + F.col("change") / F.col("width")) / 4).otherwise(three / 3)
    return rows.select(*REGION, "row_idx", "n_filled", score.alias("score"))


def _is_text() -> Column:
    return F.col("vtype").isin("text", "date", "error")


def tables(inside: DataFrame, scan: int = SCAN, header_score: float = HEADER_SCORE) -> DataFrame:
    """(region, header_row, score, fill, is_table): the best of the first ``scan`` rows is the header if it scores over ``header_score``;
    a table has two header cells at least and is more than half full over its first ten data rows.

    Only the rows at the top that a header and its first data rows may be in are looked at.
    """
    top = inside.where(F.col("row_idx") <= F.col("min_row") + scan + FILL_ROWS)
    scored = header_scores(top.where(F.col("row_idx") <= F.col("min_row") + scan)).where(F.col("score") > header_score)
    bounds = top.groupBy(*REGION).agg(F.max("min_row").alias("min_row"), F.max("max_row").alias("max_row"))
    best = scored.join(bounds, REGION).where(F.col("row_idx") < F.col("min_row") + scan).groupBy(*REGION).agg(
        F.max_by(F.struct("row_idx", "n_filled", "score"), F.struct("score", -F.col("row_idx"))).alias("h"), F.max("max_row").alias("last"))
    best = best.select(*REGION, F.col("h.row_idx").alias("header_row"), F.col("h.n_filled").alias("n_header"), F.col("h.score").alias("score"), "last")
    row = F.col("row_idx")
    columns = top.join(best.select(*REGION, "header_row"), REGION).groupBy(*REGION, "col_idx").agg(
        F.bool_or(row == F.col("header_row")).alias("named"), F.count_if((row > F.col("header_row")) & (row <= F.col("header_row") + FILL_ROWS)).alias("n"))
    n = columns.where("named").groupBy(*REGION).agg(F.sum("n").alias("n"))
    rows = F.least(F.lit(FILL_ROWS), F.col("last") - F.col("header_row"))
    out = best.join(n, REGION, "left").withColumn("fill", F.coalesce(F.try_divide(F.col("n").cast("double"), rows * F.col("n_header")), F.lit(0.0)))
    return out.select(*REGION, "header_row", "score", "fill", ((F.col("n_header") >= 2) & (F.col("fill") > FILL)).alias("is_table"))


def key_values(inside: DataFrame, scan: int = SCAN, scan_cols: int = SCAN) -> DataFrame:
    """(region, confidence): rows whose first cell is a key (it has a colon, or another cell follows) and columns
    with two keys at every other place, as a share of all rows and columns; 0 where there are none."""
    height, width = F.col("max_row") - F.col("min_row") + 1, F.col("max_col") - F.col("min_col") + 1
    at = F.col("col_idx") - F.col("min_col")
    # of a row's first two cells
    first, second = F.max(F.when(at == 0, F.col("value"))), F.max(F.when(at == 1, F.col("value")))
    colon = F.bool_or((at == 0) & _is_text() & F.contains("value", F.lit(":")))
    rows = inside.groupBy(*REGION, "row_idx", "min_row", height.alias("height"), width.alias("width")).agg(
        (colon | (second.isNotNull() & ~first.eqNullSafe(second))).alias("hit"))
    hit = F.col("hit") & (F.col("width") >= 2) & (F.col("row_idx") < F.col("min_row") + scan)
    per_row = rows.groupBy(*REGION, "height", "width").agg(F.count_if(hit).alias("hits"))
    v = stripped(F.col("value"))
    place = F.col("row_idx") - F.col("min_row")
    key = _is_text() & (v.endswith(":") | F.lower(v).rlike(KEY_WORDS)) & (place % 2 == 0) & (place < height - 1) & (at < scan_cols)
    cols = inside.where(key).groupBy(*REGION, "col_idx").agg(F.count("*").alias("keys")).where("keys >= 2")
    per_col = cols.groupBy(*REGION).agg(F.count("*").alias("col_hits"))
    share = (F.col("hits") + F.coalesce("col_hits", F.lit(0))) / (F.col("height") + F.col("width"))
    return per_row.join(per_col, REGION, "left").select(*REGION, F.least(F.lit(1.0), share).alias("confidence"))


def region_types(cells: DataFrame, scan: int = SCAN, scan_cols: int = SCAN, header_score: float = HEADER_SCORE) -> DataFrame:
    """(region, its bounds, kind, confidence, header_row, data_start_row): ``table``, else ``key_value``, else ``unknown``.

    Regions and the cells in them are written, and all tests read them from there.
    """
    found = written(regions(cells))
    inside = written(region_cells(cells, found).select(*REGION, "row_idx", "col_idx", "value", "vtype", "kind", "min_row", "max_row", "min_col", "max_col"))
    both = found.join(tables(inside, scan, header_score), REGION, "left").join(key_values(inside, scan, scan_cols), REGION, "left")
    is_table, pairs = F.coalesce("is_table", F.lit(False)), F.coalesce("confidence", F.lit(0.0))
    kind = F.when(is_table, "table").when(pairs > 0, "key_value").otherwise("unknown")
    sure = F.when(is_table, F.col("fill")).otherwise(pairs)
    row = F.when(is_table, F.col("header_row"))
    return both.select(*found.columns, kind.alias("kind"), sure.alias("sure"), row.alias("header_row"), (row + 1).alias("data_start_row")).withColumnRenamed("sure", "confidence")


def structures(cells: DataFrame, sheets: DataFrame | None = None, found: DataFrame | None = None, **scanned) -> DataFrame:
    """(file_path, sheet_name, structure, confidence, mixed, header_row, data_start_row, table bounds), a row a sheet.

    ``structured`` where a region is a table, else ``unstructured`` where one holds keys, else ``unknown``, and
    ``empty`` for sheets of ``sheets`` that have no cell at all. ``mixed`` says that both kinds are there.
    The first table in order gives the rows and bounds; confidence is the largest of its kind. ``found`` are the sheets' ``region_types``;
    without them they are looked for, and ``scanned`` goes there.
    """
    bounds = ["min_row", "max_row", "min_col", "max_col", "header_row", "data_start_row"]
    first = F.min(F.when(F.col("kind") == "table", F.struct("region_id", *bounds)))
    largest = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("confidence"))), F.lit(0.0))
    g = (region_types(cells, **scanned) if found is None else found).groupBy(*SHEET).agg(first.alias("t"), F.bool_or(F.col("kind") == "key_value").alias("pairs"), largest("table").alias("tables"), largest("key_value").alias("keys"))
    every = cells.select(*SHEET).distinct().withColumn("has", F.lit(True))
    if sheets is not None:
        every = sheets.select(*SHEET).distinct().join(every, SHEET, "left")
    out = every.join(g, SHEET, "left")
    table, pairs = F.col("t").isNotNull(), F.coalesce("pairs", F.lit(False))
    name = F.when(F.col("has").isNull(), "empty").when(table, "structured").when(pairs, "unstructured").otherwise("unknown")
    sure = F.when(F.col("has").isNull(), 1.0).when(table, F.col("tables")).when(pairs, F.col("keys")).otherwise(0.0)
    return out.select(*SHEET, name.alias("structure"), sure.alias("confidence"), (table & pairs).alias("mixed"), *[F.col("t").getField(c).alias(c) for c in bounds])


def routed(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of sheets that are tables, and those of all other sheets, which are read as keys and values."""
    kinds = written(structures(cells).select(*SHEET, "structure"))
    at = cells.join(kinds, SHEET)
    return at.where("structure = 'structured'").drop("structure"), at.where("structure <> 'structured'").drop("structure")


def without_empty_lines(cells: DataFrame) -> DataFrame:
    """Filled cells with rows and columns numbered anew, so that empty ones are gone."""
    full = cells.where(filled(F.col("value")))
    place = lambda c: (F.dense_rank().over(Window.partitionBy(*SHEET).orderBy(c)) - 1).cast("int")
    return full.withColumn("new_row", place("row_idx")).withColumn("new_col", place("col_idx")).drop("row_idx", "col_idx").withColumnsRenamed({"new_row": "row_idx", "new_col": "col_idx"})


def table_values(inside: DataFrame, found: DataFrame) -> DataFrame:
    """(region, row_no, column, value) of each table: its data cells under the header's names, rows numbered from 1."""
    at = found.where("is_table").select(*REGION, "header_row")
    cells = inside.join(at, REGION)
    header = cells.where("row_idx = header_row").select(*REGION, "col_idx", stripped(F.col("value")).alias("column"))
    return cells.where("row_idx > header_row").join(header, [*REGION, "col_idx"]).select(*REGION, (F.col("row_idx") - F.col("header_row")).alias("row_no"), "column", "value")
