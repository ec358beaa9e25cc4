"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.tries import DoubleArray, double_array

SPACE = "▁"
#: Fixed value: how much worse than the worst piece a character without a piece is.
UNKNOWN_PENALTY = 10.0
#: Units whose pieces one worker keeps.
CACHE_UNITS = 300_000
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Unigram:
    """Pieces with log scores. ``octets[b]`` is the piece of byte b, ``spelled[i]`` what piece i stands for."""

    trie: DoubleArray
    scores: np.ndarray
    octets: np.ndarray
    spelled: list[bytes]
    longest: int
    unknown: float
    parted: bool  # no piece has a marker after another character, so units can be encoded apart

    def encode_units(self, units: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Pieces (32-bit little-endian ids), score and number of fallback bytes of each unit.

        All units go through the trie together, one symbol further a step, and through Viterbi
        together, one place further a step. A character of which no piece starts and ends with it
        can be spelled by its bytes. Of equally good paths the one with the longer last piece stays.
        """
        n = np.array([len(u) for u in units], np.int64)
        text, end = np.frombuffer(b"".join(units), np.uint8), np.cumsum(n)
        first = end - n
        begin = np.flatnonzero((text & 0xC0) != 0x80)
        stop = np.repeat(end, n)[begin] if len(text) else begin
        size = np.diff(np.append(begin, len(text)))  # bytes of the character
        edges, state, at, k = [], np.zeros(len(begin), np.int64), np.arange(len(begin)), 0
        single = np.zeros(len(begin), bool)
        while len(at):
            inside = begin[at] + k < stop[at]
            at, state = at[inside], state[inside]
            state, ok = self.trie.step(state, text[begin[at] + k].astype(np.int64))
            at, state, k = at[ok], state[ok], k + 1
            piece = self.trie.value[state]
            hit = piece >= 0
            edges.append((begin[at[hit]], np.full(hit.sum(), k), piece[hit].astype(np.int64), self.scores[piece[hit]]))
            single[at[hit & (size[at] == k)]] = True
        lone = ~single
        edges.append((begin[lone], size[lone], np.full(lone.sum(), -1), np.full(lone.sum(), self.unknown)))
        start, width, piece, score = (np.concatenate(x) for x in zip(*edges))
        # edges in order of how far into its unit each starts; none of one step meet in a place
        depth = start - np.repeat(first, n)[start] if len(text) else start
        order = np.lexsort((start, depth))
        start, width, piece, score, depth = (x[order] for x in (start, width, piece, score, depth))
        best, via = np.full(len(text) + len(units) + 1, -np.inf), np.full(len(text) + len(units) + 1, -1)
        shift = np.repeat(np.arange(len(units)), n)[start] if len(text) else start  # a place of its own for each unit's end
        source, target = start + shift, start + shift + width
        best[first + np.arange(len(units))] = 0
        cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True]) if len(depth) else []
        for lo, hi in zip(cuts, cuts[1:]):
            reached = best[source[lo:hi]] + score[lo:hi]
            better = np.flatnonzero(reached > best[target[lo:hi]])
            to = target[lo:hi][better]
            best[to], via[to] = reached[better], lo + better
        final = end + np.arange(len(units))
        here, unit, found = final.copy(), np.arange(len(units)), []
        while True:
            on = via[here] >= 0
            here, unit = here[on], unit[on]
            if not len(here):
                break
            edge = via[here]
            found.append((unit, edge))
            here = source[edge]
        if not found:
            return [b""] * len(units), np.zeros(len(units)), np.zeros(len(units), np.int64)
        unit, edge = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start[edge], unit))
        unit, edge = unit[order], edge[order]
        bare = piece[edge] < 0
        count = np.where(bare, width[edge], 1)
        unit, edge = np.repeat(unit, count), np.repeat(edge, count)
        within = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count)
        bare = piece[edge] < 0
        ids = piece[edge]
        ids[bare] = self.octets[text[start[edge[bare]] + within[bare]]]
        raw = ids.astype("<u4").tobytes()
        last = 4 * np.searchsorted(unit, np.arange(len(units)), side="right")
        at = np.append(0, last[:-1])
        return [raw[a:b] for a, b in zip(at.tolist(), last.tolist())], best[final], np.bincount(unit, bare, minlength=len(units)).astype(np.int64)

    def units(self, text: str) -> list[str]:
        """The text with markers for spaces, one in front, in parts that pieces never join."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not self.parted:
            return [marked]
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return _RUNS.findall(marked)
        return list(map(SPACE.__add__, text.split(" ")))

    def decode(self, ids: list[int]) -> str:
        """Text of pieces: bytes joined, markers to spaces, the first one dropped. What is no UTF-8 becomes U+FFFD."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def unigram(pieces: list[tuple[str, float]], control: frozenset[int] = frozenset()) -> Unigram:
    """Model of (piece, log score) in order of id. ``<0xNN>`` are byte pieces; control ids are never matched."""
    octets, plain, spelled = np.full(256, -1, np.int64), [], []
    for i, (p, _) in enumerate(pieces):
        m = _BYTE.fullmatch(p)
        if m and i not in control:
            octets[int(m[1], 16)] = i
            spelled.append(bytes([int(m[1], 16)]))
        elif i in control:
            spelled.append(b"")
        else:
            plain.append(i)
            spelled.append(p.encode())
    if (octets < 0).any():
        raise ValueError("a piece for each byte is needed")
    scores = np.array([s for _, s in pieces], np.float64)
    return Unigram(
        double_array((tuple(spelled[i]), i) for i in plain), scores, octets, spelled, max(map(len, spelled)),
        float(scores[plain].min()) - UNKNOWN_PENALTY, not any(SPACE in pieces[i][0].lstrip(SPACE) for i in plain),
    )


def load_pieces(model_path: str) -> tuple[list[tuple[str, float]], frozenset[int]]:
    """Pieces, scores and control ids of a SentencePiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    control = frozenset(i for i in range(len(m)) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(len(m))], control


_CACHES: dict[str, dict[str, tuple[bytes, float, int]]] = {}


def _encoded(model: Unigram, known: dict, texts: list[str]) -> Iterator[tuple[bytes, float, int]]:
    """Ids, score and fallback bytes of each text."""
    split = [model.units(t) for t in texts]
    if len(known) > CACHE_UNITS:
        known.clear()
    new = list({u for us in split for u in us}.difference(known))
    known.update(zip(new, zip(*model.encode_units([u.encode() for u in new]))))
    for us in split:
        got = [known[u] for u in us]
        yield b"".join([g[0] for g in got]), float(sum([g[1] for g in got])), int(sum([g[2] for g in got]))


def _batches(shared, key: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Unigram = shared.value
        known = _CACHES.setdefault(key, {})
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, rows, lists = part.column("text").to_pylist(), [], []
                for text, (raw, score, fallback) in zip(texts, _encoded(model, known, texts)):
                    ids = np.frombuffer(raw, "<u4")
                    lists.append(ids.astype(np.int32) if full else None)
                    back = None if full else model.decode(ids.tolist())
                    rows.append((len(ids), fallback, zlib.crc32(raw), score, back == text.replace(SPACE, " ")))
                n, fallback, crc, score, same = zip(*rows)
                cols = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, fallback, crc)), pa.array(score, pa.float64())]
                names = ["doc_id", "n_pieces", "n_fallback", "ids_crc32", "score"]
                extra = pa.array(lists, pa.list_(pa.int32())) if full else pa.array(same)
                yield pa.RecordBatch.from_arrays([*cols, extra], names=[*names, "ids" if full else "round_trip"])

    return run


def _run(df: DataFrame, pieces, control, full: bool) -> DataFrame:
    model = unigram(pieces, control)
    shared = df.sparkSession.sparkContext.broadcast(model)
    key = f"{zlib.crc32(repr(pieces).encode()):08x}"
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_batches(shared, key, full), f"doc_id long, n_pieces long, n_fallback long, ids_crc32 long, score double, {'ids array<int>' if full else 'round_trip boolean'}")


def encode(df: DataFrame, pieces: list[tuple[str, float]], control: frozenset[int] = frozenset()) -> DataFrame:
    """(doc_id, n_pieces, n_fallback, ids_crc32, score, ids) for each row of (doc_id, text).

    ``ids`` are the pieces of the best segmentation of the whole text by summed log scores, ``score``
    that sum, ``n_fallback`` how many ids are single bytes. Spaces become markers, with one in front.
    A null or empty text has no pieces and score 0. A null id stays null; each row stands alone,
    so repeated rows have equal results; an empty table gives an empty one. The model is built once
    and broadcast; its size depends on the vocabulary alone.
    """
    return _run(df, pieces, control, True)


def decode(df: DataFrame, pieces: list[tuple[str, float]], control: frozenset[int] = frozenset(), ids_col: str = "ids") -> DataFrame:
    """The input and ``decoded`` (replaced if there): the text of ``ids_col``. Null ids give null, ids that
    the model lacks and null entries count as control ids and give nothing. A marker decodes to a
    space, so a text that itself holds the marker character comes back with spaces there."""
    shared = df.sparkSession.sparkContext.broadcast(unigram(pieces, control))

    def run(column: pa.Array) -> pa.Array:
        model = shared.value
        top = len(model.spelled)
        return pa.array([None if ids is None else model.decode([i for i in ids if i is not None and 0 <= i < top]) for ids in column.to_pylist()], pa.string())

    return df.withColumn("decoded", F.arrow_udf(run, "string")(F.col(ids_col)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _run(documents, *load_pieces(public_tokenizers.path("piece_bpe_32k.model")), False)
