"""Benchmark decontamination, in DataFrame functions only: a prefix-filtered join of windows of benchmark items with documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import unpack, with_document_key, written
from ledgerlens.llm.line_dedup import LOWER, UPPER

WINDOW, SHINGLE = 10, 5
#: What words are not made of, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to this size (as estimated from its bytes) the windows of the benchmark are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes that a window takes besides its letters.
PER_WINDOW = 200


def words(text: Column) -> Column:
    """Runs of digits, a-z and all characters beyond ASCII, A-Z lower-cased."""
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(small, BETWEEN), "")


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(window, words) of the different windows of all items, numbered, and (window, item) of the items that have them."""
    # an item's id is text from here on; items without an id go by one name
    w = items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), words(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("w"))
    n = F.least(F.lit(window), F.size("w"))
    every = w.where(F.size("w") > 0).select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("s"))
    every = every.select("item", F.slice("w", F.col("s"), F.col("n")).alias("words"))
    windows = written(every.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    return windows, written(every.join(windows, "words").select("window", "item").distinct(), "members")


def shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(all columns, pos, h): the hash of each run of so many words of ``w``, under the place of its first word."""
    at = docs.select("*", F.posexplode("w").alias("pos", "first")).drop("first").select("*", F.explode(F.lit(lengths)).alias("k"))
    return at.where(F.col("pos") + F.col("k") <= F.size("w")).select(*docs.columns, "pos", F.xxhash64(F.slice("w", F.col("pos") + 1, F.col("k"))).alias("h"))


def _anchors(windows: DataFrame, docs: DataFrame, shingle: int, sized) -> tuple[DataFrame, list[int]]:
    """(window, words, h, at): of each window the rarest of its shingles among all documents, and their lengths.

    All of a window's words have to be there, so one shingle is the whole prefix that a join needs. A window with a
    shingle that no document has is left out.
    """
    k = F.least(F.lit(shingle), F.size("words"))
    own = windows.select("window", k.alias("k"), F.size("words").alias("n"), "words").select(
        "window", "k", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("at"), "words"
    ).select("window", "k", "at", F.xxhash64(F.slice("words", F.col("at") + 1, F.col("k"))).alias("h"))
    lengths = sorted(r["k"] for r in own.select("k").distinct().collect())
    counts = shingles(docs, lengths).select("h").join(sized(own.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("n"))
    best = own.join(written(counts, "counts"), "h", "left").groupBy("window").agg(F.bool_and(F.col("n").isNotNull()).alias("there"), F.min(F.struct("n", "h", "at")).alias("b"))
    rarest = best.where("there").select("window", "b.h", "b.at").join(windows, "window")
    return written(rarest.select("window", "words", "h", "at"), "anchors"), lengths


def occurrences(base: DataFrame, windows: DataFrame, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, th, start, end, window): every occurrence of a window in the documents' words ``w``.

    Documents' shingles meet the windows of which they are the rarest, at most one place for each; length and place bound
    where the window may lie, and its words are compared there. While the windows are small enough to be broadcast,
    documents are not shuffled for this; else the meeting places are, and the texts are joined to those alone.
    """
    size = windows.agg((F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0)) + F.count("*") * PER_WINDOW).alias("n")).first()["n"]
    small = size <= broadcast_bytes
    sized = F.broadcast if small else (lambda df: df)
    docs = base.select("doc", "th", "w")
    anchors, lengths = _anchors(windows, docs.select("w"), shingle, sized)
    start, end = F.col("pos") - F.col("at"), F.col("pos") - F.col("at") + F.size("words")
    out = [F.col("doc"), F.col("th"), F.col("start"), F.col("end"), F.col("window")]
    same = F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words")
    if small:
        met = shingles(docs, lengths).join(F.broadcast(anchors), "h").where((start >= 0) & (end <= F.size("w")))
        return met.withColumns({"start": start, "end": end}).where(same).select(*out)
    places = shingles(docs.withColumn("size", F.size("w")), lengths).select("doc", "th", "size", "pos", "h")
    met = places.join(anchors, "h").where((start >= 0) & (end <= F.col("size"))).withColumns({"start": start, "end": end})
    return met.select("doc", "th", "start", "end", "window", "words").distinct().join(docs, ["doc", "th"]).where(same).select(*out)


def decontaminate(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The input's rows and columns and ``n_words``, ``n_hit`` (words within an occurrence of a window), ``spans`` (places of
    the windows found, from 0, the end not included), ``items`` (those whose windows occur, sorted as text) and
    ``contaminated`` (unless the input has columns of these names).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null texts have
    no words. Rows alike in id and text are repeats and get the same; ids of rows play no part in what is found. Rows of
    ``items`` with one id are one item, and null ids are the item ``null``. An empty table of items hits nothing, an empty
    table of documents gives an empty table.

    Windows that many items share are one window here, and documents with the same windows are taken together when items
    are listed, so a passage that a third of both hold makes no pairs of documents and items. Occurrences are gathered as
    sets within each task first, and a document bounds them.
    """
    base = with_document_key(df, id_col, f"`{text_col}`").withColumn("w", words(F.col("body")))
    windows, members = benchmark_windows(items, item_col, item_text, window)
    found = occurrences(base, windows, shingle, broadcast_bytes)
    hits = found.groupBy("doc", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("window")).alias("windows"))
    hits = written(hits, "hits")
    named = hits.select("windows").distinct().select("windows", F.explode("windows").alias("window")).join(members, "window")
    named = named.groupBy("windows").agg(F.array_sort(F.collect_set("item")).alias("items"))
    known = hits.join(named, "windows").select("doc", "th", "spans", "items")
    none = F.lit(0).cast("long")
    covered = F.aggregate(
        "spans", F.struct(none.alias("hit"), none.alias("end")),
        lambda s, x: F.struct((s["hit"] + F.greatest(none, x["end"] - F.greatest(s["end"], x["start"].cast("long")))).alias("hit"), F.greatest(s["end"], x["end"].cast("long")).alias("end")),
        lambda s: s["hit"],
    )
    both = base.select("row", "doc", "th", F.size("w").cast("long").alias("n_words")).join(known.withColumn("hit", covered), ["doc", "th"], "left")
    added = {
        "n_words": F.col("n_words"), "n_hit": F.coalesce("hit", none), "spans": F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")),
        "items": F.coalesce("items", F.array().cast("array<string>")), "contaminated": F.col("hit").isNotNull(),
    }
    return unpack(both, df, {}, added)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: DuckDB.
OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '(?:[0-9a-z]|[^\x00-\x7F])+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '(?:[0-9a-z]|[^\x00-\x7F])+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS t
  FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS s FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM i WHERE len(w) > 0))),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS t
  FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS s FROM (SELECT * FROM d, (SELECT DISTINCT n FROM windows)) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, p.n, s FROM places p JOIN windows w ON p.n = w.n AND p.t = w.t),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
