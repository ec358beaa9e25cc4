"""Line dedup, in DataFrame functions only: hash normalised lines, keep each frequent line once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import unpack, with_document_key, written

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = 2, min_chars: int = 10) -> DataFrame:
    """Drop lines whose key is in ``min_documents`` documents or more, but for the first document with it.

    Returns the input's rows and columns with ``text_col`` rebuilt, and ``n_lines`` and ``n_dropped``
    (unless the input has columns of these names).

    Lines end at ``\\n``. A null or empty text is one empty line and becomes an empty text. Keys under
    ``min_chars`` code points never count. The first document is the one with the smallest id; null
    ids come last. Rows that share an id are one document for counting, so a line in no other
    document stays in all of them. An empty table gives an empty table.

    A key is held as two 64-bit hashes. Counting is a grouped aggregate with map-side partials and
    the way back is a join with one row a key, which Spark can split, so a line that a third of all
    documents hold is no hot task.
    """
    base = with_document_key(df, id_col, text_col)
    lines = written(
        base.select("doc", "th", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
        .select("doc", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")),
        "lines",
    )
    if min_documents == 2:
        # two documents hold a key exactly if its smallest and largest ids differ
        keys = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last")
    else:
        keys = (
            lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
            .groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_documents)
        )
    # written, so that the join below is of two shuffled tables, which Spark may split where a line is hot
    keys = written(keys.select("h1", "h2", "first"), "keys")
    dropped = (
        lines.join(keys, ["h1", "h2"]).where(F.col("doc") != F.col("first"))
        .groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))
    )
    both = base.join(dropped, ["doc", "th"], "left").withColumn("parts", F.split("body", "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(
        F.array_join(F.transform(places, lambda i: F.element_at("parts", i + 1)), "\n")
    )
    return unpack(
        both, df, {text_col: kept},
        {"n_lines": F.size("parts").cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")},
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(documents).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB.
OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (o.key IS NOT NULL AND k.doc_id <> o.first) AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
