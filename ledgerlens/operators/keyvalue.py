"""Key-value lines and cells: pairs, headers, headers filled forward over what is below them, and the tree of a sheet as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.store import dealt

# Marks of list items, and patterns of keys that stand alone, of sections and of subsections.
BULLETS = "•·▪▫◦‣⁃"
KEYS = [r"^[A-Z][a-zA-Z\s]+:", r"^[A-Z][A-Z\s]+:", r"^\d+\.\s+[A-Za-z]", rf"^[{BULLETS}]\s+", r"^\([a-z]\)", r"^\d+\)"]
SECTIONS = [r"^[A-Z][A-Z\s]+$", r"^\d+\.\s+[A-Z]", r"^Section\s+\d+"]
SUBSECTIONS = [r"^\d+\.\d+\s+", r"^[a-z]\)", r"^\s{2,}[A-Z]"]
#: Length that a key stays under, the last column in which a section may start, and the key of text without one.
KEY_CHARS, SECTION_COLUMNS, TEXT_KEY = 50, 2, "_content"


def _split_at(text: Column) -> Column:
    """The sign that a pair is split at: the first colon, or without one the first equals sign; 0 where there is neither."""
    colon = F.locate(":", text)
    return F.when(colon > 0, colon).otherwise(F.locate("=", text))


def _usable(text: Column, at: Column) -> Column:
    return (at > 0) & (F.trim(F.substr(text, F.lit(1), at - 1)) != "") & (at - 1 < KEY_CHARS)


def is_pair(text: Column) -> Column:
    """Whether a colon or an equals sign has a short key before it."""
    return _usable(text, F.locate(":", text)) | _usable(text, F.locate("=", text))


def pair_key(text: Column) -> Column:
    at = _split_at(text)
    return F.when(at > 0, F.trim(F.substr(text, F.lit(1), at - 1))).otherwise(text)


def pair_value(text: Column) -> Column:
    """What follows the first colon, or without one the first equals sign; null where that is blank."""
    at = _split_at(text)
    return F.when(at > 0, F.nullif(F.trim(F.substr(text, at + 1)), F.lit("")))


def is_section(text: Column, column: Column | None = None) -> Column:
    """Whether a text is a section's header: by its form, or several words in capitals; only in the first columns."""
    capitals = (F.upper(text) == text) & text.rlike(r"\p{L}") & text.rlike(r"\S\s+\S") & ~F.endswith(text, F.lit(":"))
    found = text.rlike("|".join(SECTIONS)) | capitals
    return found if column is None else found & (column <= SECTION_COLUMNS)


def is_subsection(text: Column) -> Column:
    """Whether a text is a subsection's header: by its form, or several words that each start with a capital."""
    words = F.split(F.trim(text), r"\s+")
    titled = (F.size(words) > 1) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}")) & ~F.endswith(text, F.lit(":"))
    return text.rlike("|".join(SUBSECTIONS)) | titled


def is_header(text: Column) -> Column:
    return is_section(text) | is_subsection(text)


def is_key(text: Column) -> Column:
    """Whether a text is a key whose value may be in the next cell."""
    return F.endswith(text, F.lit(":")) | text.rlike("|".join(KEYS))


def clean_header(text: Column) -> Column:
    """Without a number, a letter in brackets or a bullet before it."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\d+\.?\s*", ""), r"^\([a-z]\)\s*", "")
    return F.trim(F.regexp_replace(bare, rf"^[{BULLETS}]\s*", ""))


def clean_key(text: Column) -> Column:
    """Without a colon at the end, white space made single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, ":$", ""), r"\s+", " "))


def sections(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Each line with the section header above it; a window a document, never one over all."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(is_section(F.col(line)), F.col(line)), ignorenulls=True).over(w))


def pairs(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """(doc, section, key, value): of a repeated key the last value holds."""
    at = sections(lines, doc, order, line).where(is_pair(F.col(line)) & ~is_section(F.col(line)))
    found = at.select(doc, F.coalesce("section", F.lit("")).alias("section"), pair_key(F.col(line)).alias("key"), pair_value(F.col(line)).alias("value"), order)
    return found.groupBy(doc, "section", "key").agg(F.max_by("value", order).alias("value"))


def tree(cells: DataFrame, doc: list[str], row: str = "row_idx", col: str = "col_idx", value: str = "value") -> DataFrame:
    """(doc, section, subsection, key, value, pos) of a sheet's cells, row by row; headers without anything below them have a null key.

    A cell is, in this order, a section, a subsection, a pair, a key, or text. Sections and subsections
    hold for the cells after them; a subsection before any section is only remembered. A pair takes the
    next cell too, and a key takes it as its value, unless that is a pair or a header; a cell that was
    taken is nothing else. Of a repeated key the last value holds. Text between headers is one value
    under ``_content``, a row each. Blank cells and nulls don't count.
    """
    v = F.col("v")
    rows = cells.select(*doc, F.col(row).alias("r"), F.col(col).alias("c"), F.trim(F.col(value)).alias("v")).where((v != "") & v.isNotNull())
    kind = F.when(is_section(v, F.col("c")), "section").when(is_subsection(v), "subsection").when(is_pair(v), "pair").when(is_key(v), "key").otherwise("text")
    # a sheet's cells move once and are sorted once: all windows go along its rows and columns
    line = Window.partitionBy(*doc, "r").orderBy("c")
    rows = dealt(rows, *doc).withColumn("kind", kind).withColumn("open", ~is_pair(v) & ~is_header(v))
    rows = rows.withColumn("next", F.when((F.lead("c").over(line) == F.col("c") + 1) & F.lead("open").over(line), F.lead("v").over(line)))
    # runs of cells that could be taken by the one before: every other one of a run is
    led = F.coalesce((F.lag("c").over(line) == F.col("c") - 1) & F.lag("kind").over(line).isin("pair", "key") & F.col("open"), F.lit(False))
    rows = rows.withColumn("led", led).withColumn("place", F.row_number().over(line))
    first = F.max(F.when(~F.col("led"), F.col("place"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("taken", (F.col("place") - first) % 2 == 1).where(~F.col("taken"))
    order = Window.partitionBy(*doc).orderBy("r", "c")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("kind").isin("section", "subsection"), clean_header(v))
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("head", head)
    rows = rows.withColumn("part", F.sum((F.col("kind") == "section").cast("int")).over(so_far)).withColumn("block", F.sum(F.col("head").isNotNull().cast("int")).over(so_far))
    rows = rows.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("head")), ignorenulls=True).over(so_far))
    inner = F.last(F.when(F.col("kind") == "subsection", F.struct("part", "head")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("inner", inner).withColumn("subsection", F.when((F.col("part") > 0) & (F.col("inner.part") == F.col("part")), F.col("inner.head")))
    at = [*doc, "section", "subsection"]
    keyed, text = F.col("kind").isin("pair", "key"), F.col("kind") == "text"
    key = F.when(F.col("kind") == "pair", pair_key(v)).when(F.col("kind") == "key", clean_key(v)).when(text, F.lit(TEXT_KEY))
    told = F.when(F.col("kind") == "pair", F.nullif(F.concat_ws(" ", pair_value(v), "next"), F.lit(""))).when(F.col("kind") == "key", F.col("next"))
    # keys, texts between two headers, and headers are grouped in one pass
    rows = rows.where(keyed | text | F.col("section").isNotNull()).select(*at, "pos", "v", key.alias("key"), told.alias("told"), F.when(text, F.col("block")).alias("between"))
    found = rows.groupBy(*at, "key", "between").agg(
        F.max_by("told", "pos").alias("value"), F.array_sort(F.collect_list(F.when(F.col("between").isNotNull(), F.struct("pos", "v")))).alias("t"), F.min("pos").alias("pos"))
    value = F.when(F.col("between").isNotNull(), F.array_join(F.transform("t", lambda x: x["v"]), " ")).otherwise(F.col("value"))
    return found.select(*at, "key", value.alias("value"), "pos")


def tree_counts(found: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, total_keys, max_depth): keys of all levels, headers too, and how deep headers lie."""
    names = found.select(*doc, F.explode(F.array_compact(F.array(
        F.when(F.col("section").isNotNull(), F.struct("section", F.lit(None).cast("string").alias("subsection"), F.lit(None).cast("string").alias("key"))),
        F.when(F.col("subsection").isNotNull(), F.struct("section", "subsection", F.lit(None).cast("string").alias("key"))),
        F.when(F.col("key").isNotNull(), F.struct("section", "subsection", "key")),
    ))).alias("k")).distinct()
    depth = F.max(F.when(F.col("k.subsection").isNotNull(), 2).when(F.col("k.section").isNotNull(), 1).otherwise(0))
    return names.groupBy(*doc).agg(F.count("*").alias("total_keys"), depth.alias("max_depth"))


def key_paths(found: DataFrame, doc: list[str]) -> DataFrame:
    """(doc, path) of all keys and headers, without any value; names that start with an underscore stay inside."""
    paths = F.array_compact(F.array(
        F.col("section"), F.when(F.col("subsection").isNotNull(), F.concat_ws(".", "section", "subsection")),
        F.when(~F.startswith("key", F.lit("_")), F.concat_ws(".", "section", "subsection", "key")),
    ))
    return found.select(*doc, F.explode(paths).alias("path")).distinct()


def row_pairs(cells: DataFrame, doc: list[str], across: bool = True, row: str = "row_idx", col: str = "col_idx", value: str = "value") -> DataFrame:
    """(doc, row, key, value) of each row's pairs and keys with the next cell as value; ``across`` False: down each column, with the
    column's number for the row. A cell that was taken as a value is no key; the last cell of a line only counts as a value. Of a
    repeated key the last value holds."""
    line, step = (row, col) if across else (col, row)
    v = F.trim(F.col(value))
    w = Window.partitionBy(*doc, line).orderBy(step)
    rows = cells.select(*doc, F.col(line).alias("line"), F.col(step).alias("step"), v.alias("v")).where((F.col("v") != "") & F.col("v").isNotNull())
    w = Window.partitionBy(*doc, "line").orderBy("step")
    pair, key = is_pair(F.col("v")), is_key(F.col("v"))
    rows = rows.withColumn("alone", key & ~pair).withColumn("next", F.when(F.lead("step").over(w) == F.col("step") + 1, F.lead("v").over(w)))
    # of a run of keys that stand alone every other one is a value
    led = F.coalesce((F.lag("step").over(w) == F.col("step") - 1) & F.lag("alone").over(w), F.lit(False))
    rows = rows.withColumn("led", led).withColumn("run", F.sum((~F.col("led")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*doc, "line", "run").orderBy("step")))
    rows = rows.withColumn("last", F.lead("step").over(w).isNull()).where((F.col("place") % 2 == 1) & ~F.col("last") & (pair | key))
    named = rows.select(*doc, F.col("line").alias(line), "step", F.when(pair, pair_key(F.col("v"))).otherwise(clean_key(F.col("v"))).alias("key"), F.when(pair, pair_value(F.col("v"))).otherwise(F.col("next")).alias("value"))
    return named.groupBy(*doc, line, "key").agg(F.max_by("value", "step").alias("value"))
