"""A corpus pipeline over ``documents``: five stages, each one of the corpus operators.

In all stages a null text is empty and a null id comes last; other columns than those of ``documents`` are
dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import written
from ledgerlens.llm.line_dedup import line_dedup
from ledgerlens.llm.near_copies import first_copies
from ledgerlens.llm.packing import pack
from ledgerlens.llm.quality import quality_scores, train
from ledgerlens.llm.suffix_dedup import suffix_dedup_text

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame, text) -> DataFrame:
    """The columns of ``documents`` with this text and its length."""
    return df.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among ``docs``.

    Each row is judged by its own text, so repeated rows stay or go together. Without usable labels all
    have one score. Texts, nulls too, stay as they are.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return quality_scores(docs, model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go: of 10 characters at least, but for blanks at the ends and the case of A-Z.

    Rows that share an id are one document, so a line of theirs only stays in all of them.
    """
    return _documents(line_dedup(docs), F.col("text"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard 0.8 or more) the first stays: the smallest id, null ids last.

    Operator 6 links fingerprints, and what it links is verified. A fingerprint of 64 bits is no sieve for
    such copies (see the README for the bits in which they differ), so what it does not reach is found
    by shingles. Of rows that repeat each other one stays; all texts without words are copies.
    """
    return first_copies(docs).select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that also start earlier go; a character that a cut leaves in part goes with it.

    Rows alike in id and text are repeats of one document and keep the same; texts of one id are different documents.
    """
    return _documents(suffix_dedup_text(docs), F.col("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a row for each piece. Each row is a document, repeated ones too; an empty text is its end token."""
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the learned classifier nor the packing; ``tests/llm/test_pipeline.py`` holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
