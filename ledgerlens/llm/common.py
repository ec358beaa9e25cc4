"""Helpers that several corpus operators share: written intermediates, document keys, components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Stands for a null document id wherever ids are ordered: such rows come last.
LAST_ID = 9223372036854775807


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        spark.conf.set("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
        found = LOCAL_CHECKPOINTS
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    An executor that is lost later costs nothing that is in this table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more, once what came of them is written itself."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ordered_id(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(LAST_ID))


def with_document_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all input columns), ``doc`` and ``th``; together these two name a document.

    ``th`` tells rows apart that share an id; rows alike in both are repeats of each other.
    Packing the input into ``row`` keeps extra columns from clashing with an operator's own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        ordered_id(f"`{id_col}`").alias("doc"),
        F.xxhash64(text).alias("th"),
        text.alias("body"),
    )


def unpack(df: DataFrame, schema_of: DataFrame, replaced: dict[str, Column], added: dict[str, Column]) -> DataFrame:
    """The input's columns again, some replaced, with those added last that the input lacks."""
    old = [replaced.get(c, F.col("row").getField(c)).alias(c) for c in schema_of.columns]
    new = [v.alias(k) for k, v in added.items() if k not in schema_of.columns]
    return df.select(*old, *new)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum and a join on the node, so no
    task ever holds a component. Every round is written to the shared folder. Stops when a round
    changes nothing, which takes about the logarithm of the longest path.
    """
    now = written(_oriented(edges), "edges")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or mark["n"] == 0:
            break
        before = mark
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _oriented(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now = written(_oriented(small), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
