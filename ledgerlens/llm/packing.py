"""Best-fit packing of token sequences by length patterns fitted with non-negative least squares."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

CAPACITY = 2048
END_ID = 0
#: Documents in a pattern, rounds of the fit, rows of one length that are numbered in one task.
PATTERN_SIZE, FIT_ROUNDS, RANK_ROWS = 3, 300, 200_000
#: White space in a row beyond which tiktoken's pattern may run out of stack.
LONG_BLANK = 100_000

_BLANK = re.compile(r"\s{%d}" % LONG_BLANK)
_ENCODERS: dict[str, UnitIds] = {}

#: Fixed value: how this family of vocabularies splits a text before it merges.
UNIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


class UnitIds:
    """Ids of whole texts, as little-endian bytes.

    Texts are split into units and encoded by tiktoken from the tokenizer file's own vocabulary, where a
    token's id is its rank, which gives the tokenizer's ids in a fraction of the time. It takes whole
    texts: to look units up one by one takes longer than to encode them. Texts with special tokens
    or with very long white space go to the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.path, self.tokenizer = path, None
        self.special = [t["content"] for t in said.get("added_tokens", ())]
        octet = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(octet[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("units", pat_str=UNIT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_tokenizer(self, text: str) -> list[int]:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, encode = [], self.encoding.encode_ordinary
        for text in texts:
            other = any(s in text for s in self.special) or len(text) >= LONG_BLANK and _BLANK.search(text)
            out.append(array("I", self.by_tokenizer(text) if other else encode(text)).tobytes())
        return out


def unit_ids(path: str) -> UnitIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitIds(path)
    return _ENCODERS[path]


def _piece_batches(path: str, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = unit_ids(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        stop = at + ((n - at - 1) % capacity + 1 if piece == 0 else capacity)
                        rows.append((doc, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                        at, piece = stop, piece + 1
                doc, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def patterns(capacity: int, present: np.ndarray, size: int = PATTERN_SIZE) -> np.ndarray:
    """Rows of up to ``size`` lengths of those present that fill the capacity exactly; 0 stands for none."""
    lengths = np.flatnonzero(present)
    lengths = lengths[lengths > 0]
    has = present.copy()
    has[0] = True
    found = [np.array([[0, 0, capacity]])[:, 3 - size :]] if has[capacity] else []
    if size >= 2:
        a = lengths[lengths <= capacity // 2]
        a = a[has[capacity - a]]
        found.append(np.column_stack([np.zeros((len(a), size - 2), int), a, capacity - a]))
    if size >= 3:
        for a in lengths[lengths <= capacity // 3]:
            b = lengths[(lengths >= a) & (lengths <= (capacity - a) // 2)]
            b = b[has[capacity - a - b]]
            if len(b):
                found.append(np.column_stack([np.full(len(b), a), b, capacity - a - b]))
    return np.concatenate(found) if found else np.zeros((0, size), int)


def fit(pattern: np.ndarray, histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Repeats x >= 0 that bring the patterns' lengths nearest to the histogram in least squares,
    by projected gradients with momentum."""
    if not len(pattern):
        return np.zeros(0)
    flat, n = pattern.ravel(), len(histogram)
    use = (pattern > 0).ravel()
    width = pattern.shape[1]

    def lengths(x):
        return np.bincount(flat, np.repeat(x, width) * use, minlength=n)

    def gradient(r):
        return (r[flat] * use).reshape(-1, width).sum(axis=1)

    v = np.ones(len(pattern))
    for _ in range(12):  # largest eigenvalue, for the step
        v = gradient(lengths(v))
        scale = np.linalg.norm(v)
        v /= scale
    step, x, t = 1 / (1.05 * scale), np.zeros(len(pattern)), 1.0
    y = x
    for _ in range(rounds):
        new = np.maximum(0, y - step * gradient(lengths(y) - histogram))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def rounded(pattern: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats within what the histogram holds, and what it then still holds.

    Sums of repeats are rounded, not each repeat, so that many small ones don't all vanish.
    """
    total = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
    want = np.diff(total, prepend=0)
    left = histogram.astype(np.int64).copy()
    got = np.zeros(len(pattern), np.int64)
    for i in np.flatnonzero(want):
        p = [int(v) for v in pattern[i] if v]
        r = int(want[i])
        for v in set(p):
            r = min(r, int(left[v]) // p.count(v))
        if r > 0:
            got[i] = r
            for v in p:
                left[v] -= r
    return got, left


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, repeats) that pack a histogram by best fit, longest first.

    Bins with equal contents are one entry with a count, so the work depends on how many lengths
    there are and not on how many documents.
    """
    open_bins: dict[int, list[list]] = {}  # room left -> [contents, count]
    rooms: list[int] = []

    def put(contents, room, count):
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([contents, count])

    for length in range(capacity, 0, -1):
        n = int(histogram[length])
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                if n >= each:
                    put((length,) * each, capacity - each * length, n // each)
                if n % each:
                    put((length,) * (n % each), capacity - n % each * length, 1)
                break
            room = rooms[k]
            contents, count = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[k]
            each = min(room // length, n)
            took = min(count, n // each)
            if took < count:
                put(contents, room, count - took)
            put(contents + (length,) * each, room - each * length, took)
            n -= took * each
    return [(tuple(c), n) for bins in open_bins.values() for c, n in bins]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """All patterns with their repeats: fitted ones, then best fit of the residuals.

    Where few lengths occur, patterns that fill sequences exactly can use up the short documents that
    long ones need. So patterns of up to three documents, of up to two, and of none are tried, and
    the first with the fewest sequences is taken.
    """
    best = None
    for size in range(PATTERN_SIZE, 0, -1):
        got, left = np.zeros(0, np.int64), histogram
        if size > 1:
            shape = patterns(capacity, histogram > 0, size)
            got, left = rounded(shape, fit(shape, histogram.astype(float)), histogram)
        packed = [(tuple(int(v) for v in shape[i] if v), int(got[i])) for i in np.flatnonzero(got)] + best_fit(left, capacity)
        count = sum(n for _, n in packed)
        if best is None or count < best[0]:
            best = (count, packed)
        if count * capacity - int((histogram * np.arange(capacity + 1)).sum()) < capacity:
            break  # no packing has fewer
    return best[1]


def slots(packed: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Where the documents of each length go: those numbered from ``low`` on, of ``length``, go to sequences from ``base`` on at ``offset``."""
    used = [0] * (capacity + 1)
    rows, base = [], 0
    for lengths, repeats in packed:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], base, offset))
            used[n] += repeats
            offset += n
        base += repeats
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"key": table[:, 0] << 48 | table[:, 1], "low": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def _place_batches(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(t["key"], length << 48 | rank, side="right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(t["base"][k] + rank - t["low"][k]), pa.array(t["offset"][k])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most ``capacity`` tokens; a row for each piece.

    A document is its ids and one end id. Only a longer one is cut, into pieces of ``capacity``, the
    first of them perhaps shorter. A null text is empty, that is one end id. Each row is a document
    of its own, so repeated rows are packed each for itself; a null id stays null. An empty table
    gives an empty table.

    The histogram of lengths (at most ``capacity`` rows) is all that the driver sees. Pieces of one
    length are numbered in groups dealt by hash, so a length that a third of all pieces have is
    no hot task. The table of slots that is broadcast has at most three rows for each pattern,
    and patterns depend on the capacity alone: about capacity**2 / 12 of them.
    """
    spark = df.sparkSession
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = written(texts.mapInArrow(_piece_batches(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity), capacity))
    parts = max(8, int(histogram.sum()) // RANK_ROWS)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = dealt.groupBy("length", "part").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    ).drop("count")
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("place", place).join(before, ["length", "part"]).withColumn("rank", (F.col("before") + F.col("place")).cast("long"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place_batches(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
