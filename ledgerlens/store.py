"""Tables that are written once and read again, in the folder that the session names for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own: what reads it twice does not make it twice, and a lost executor costs its tasks only."""
    path = f"{folder(df.sparkSession)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        for folder_ in {f.rpartition("/")[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder_)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to as many tasks as shuffles have, whatever they weigh.

    Spark unites small partitions until there is one a core, by their bytes as shuffled; rows of texts that are alike unpack to
    many times that in a sort, and a small file is read by one task, so work on rows that grow should be dealt first.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys])
