"""Token counts: greedy word-piece lengths from a linear longest-match automaton, without building pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.tries import LongestMatch, longest_match

#: Words whose counts one worker keeps.
CACHE_WORDS = 300_000
SPACE = "▁"


def word_pieces(model_path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a SentencePiece model that begin a word (white-space marker taken off), and those that continue one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [model.id_to_piece(i) for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    first = [p[1:] for p in plain if p.startswith(SPACE) and SPACE not in p[1:]]
    return [p.encode() for p in first if p], [p.encode() for p in plain if SPACE not in p]


_CACHES: dict[int, dict[bytes, int]] = {}


def _count_batches(shared, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: LongestMatch = shared.value
        known = _CACHES.setdefault(key, {})
        for batch in batches:
            counts, words = [], []
            for lo in range(0, batch.num_rows, 256):
                split = [t.encode().split() for t in batch.column("text").slice(lo, 256).to_pylist()]
                if len(known) > CACHE_WORDS:
                    known.clear()
                new = list({w for ws in split for w in ws}.difference(known))
                known.update(zip(new, automaton.counts(new).tolist()))
                get = known.__getitem__
                words += map(len, split)
                counts += [sum(map(get, ws)) for ws in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_words", "n_tokens"]
            )

    return run


def token_counts(df: DataFrame, first: list[bytes], later: list[bytes]) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of (doc_id, text).

    Words are runs of anything but blank and 0x09-0x0D. A word is cut greedily, each time by the longest
    piece: one of ``first`` at its start, then those of ``later``; a word that this cannot cut to its
    end is one token. A null or empty text has none. A null id stays null; each row stands alone, so
    repeated rows have equal counts; an empty table gives an empty one.

    The automaton is built once and broadcast; its size depends on the vocabulary alone.
    """
    spark = df.sparkSession
    automaton = longest_match(first, later)
    shared = spark.sparkContext.broadcast(automaton)
    key = hash((tuple(first), tuple(later)))
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_count_batches(shared, key), "doc_id long, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(documents, *word_pieces(public_tokenizers.path("piece_bpe_32k.model")))
