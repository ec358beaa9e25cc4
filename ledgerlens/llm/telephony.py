"""Telephony audio columns: G.711 expansion by table, IMA ADPCM across blocks, resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: WAV format tags.
FORMAT_PCM, FORMAT_ALAW, FORMAT_MULAW, FORMAT_IMA = 1, 6, 7, 17
#: Bits a sample of each.
BITS = {FORMAT_PCM: 16, FORMAT_ALAW: 8, FORMAT_MULAW: 8, FORMAT_IMA: 4}
BLOCK = 576
RATE_IN, RATE_OUT = 8000, 16000
#: Bytes of payload that are decoded at a time.
CHUNK = 1 << 20

#: Fixed values of IMA ADPCM: the change of the step index for a code's low three bits; step sizes.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, step = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, step + 8, (step + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks (n, block bytes): one step a sample, each step over all blocks.

    A block starts with its first sample (16 bits, little-endian) and step index (clipped to 0..88).
    """
    blocks = np.ascontiguousarray(blocks, np.uint8)
    n, width = blocks.shape
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    level = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = level
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            step = STEPS[index]
            change = step >> 3
            change += np.where(code & 4, step, 0)
            change += np.where(code & 2, step >> 1, 0)
            change += np.where(code & 1, step >> 2, 0)
            level = np.clip(np.where(code & 8, level - change, level + change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[code & 7], 0, 88)
            out[1 + 2 * k + half] = level
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16-bit PCM at twice the rate: each sample, then the rounded mean of it and its successor.

    ``starts`` are the places where clips begin; the last sample of a clip is its own successor.
    """
    after = np.empty_like(pcm)
    after[:-1] = pcm[1:]
    ends = np.append(starts[1:], len(pcm)) - 1
    after[ends] = pcm[ends]
    out = np.empty((len(pcm), 2), np.int16)
    out[:, 0] = pcm
    out[:, 1] = (pcm.astype(np.int32) + after + 1) >> 1
    return out.reshape(-1)


def wav(data: bytes, tag: int, rate: int, bits: int, align: int = 1) -> bytes:
    """A RIFF file with one channel of ``data``."""
    pad = len(data) & 1
    form = struct.pack("<HHIIHHH", tag, 1, rate, rate * align, align, bits, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(data))
    return struct.pack("<4sI4s4sI", b"RIFF", 4 + 8 + len(form) + len(fact) + 8 + len(data) + pad, b"WAVE", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * pad


def wav_parts(blob: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, data) of a RIFF file; ValueError if it isn't one."""
    if len(blob) < 12 or blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", blob, at + 8)
        elif name == b"data":
            return tag, rate, blob[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def wav_form(blob: bytes) -> tuple[int, int, int]:
    """(channels, block alignment, bits a sample) of a RIFF file that has a format chunk; ValueError if it has none."""
    at = 12
    while at + 8 <= len(blob) and blob[at : at + 4] != b"data":
        size = struct.unpack_from("<I", blob, at + 4)[0]
        if blob[at : at + 4] == b"fmt ":
            return struct.unpack_from("<2xH8xHH", blob, at + 8)
        at += 8 + size + (size & 1)
    raise ValueError("no format chunk")


def expand(data: bytes, tag: int, block: int = BLOCK) -> np.ndarray:
    """16-bit samples of a data chunk of one channel; the last block of ADPCM may be a short one."""
    raw = np.frombuffer(data, np.uint8)
    if tag == FORMAT_MULAW:
        return MULAW[raw]
    if tag == FORMAT_ALAW:
        return ALAW[raw]
    if tag == FORMAT_IMA:
        whole = len(raw) // block * block
        if block < 4 or 0 < len(raw) - whole < 4:
            raise ValueError("an ADPCM block is shorter than its header")
        samples = decode_ima(raw[:whole].reshape(-1, block)).reshape(-1)
        return np.concatenate([samples, decode_ima(raw[None, whole:]).reshape(-1)]) if whole < len(raw) else samples
    if tag == FORMAT_PCM:
        if len(raw) % 2:
            raise ValueError("the last sample is cut")
        return raw.view(np.int16)
    raise ValueError(f"format {tag} is not handled")


def decode_media(df: DataFrame, media_col: str = "media", block: int = BLOCK) -> DataFrame:
    """The input's columns and ``pcm`` (binary, a 16-bit PCM WAV at twice the rate), ``n_samples`` and ``error``.

    ``media_col`` holds WAV files of mu-law, A-law, IMA ADPCM or 16-bit PCM, one channel. ADPCM blocks
    are as long as the header says, ``block`` bytes if it says 0. A null gives nulls; what is no such
    file gives a null ``pcm`` and says why in ``error``. Columns of the input with these names are
    replaced.
    """
    def run(media: pa.Array) -> pa.Array:
        pcm, count, error = [], [], []
        for blob in media.to_pylist():
            try:
                if blob is None:
                    raise LookupError
                tag, rate, data = wav_parts(blob)
                channels, align, bits = wav_form(blob)
                if channels != 1:
                    raise ValueError(f"{channels} channels are not handled")
                if bits != BITS.get(tag, bits):
                    raise ValueError(f"{bits} bits a sample are not handled for format {tag}")
                samples = expand(data, tag, align or block)
                twice = resample(samples, np.zeros(min(1, len(samples)), np.int64)) if len(samples) else samples
                pcm.append(wav(twice.tobytes(), FORMAT_PCM, 2 * rate, 16, 2))
                count.append(len(twice))
                error.append(None)
            except LookupError:
                pcm.append(None), count.append(None), error.append(None)
            except (ValueError, struct.error) as why:
                pcm.append(None), count.append(None), error.append(str(why))
        return pa.StructArray.from_arrays([pa.array(pcm, pa.binary()), pa.array(count, pa.int64()), pa.array(error, pa.string())], ["pcm", "n_samples", "error"])

    decoded = F.arrow_udf(run, "pcm binary, n_samples long, error string")
    names = ("pcm", "n_samples", "error")
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{media_col}`").cast("binary").alias("media"))
    out = packed.select("row", decoded("media").alias("decoded"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in names], *[F.col("decoded").getField(n).alias(n) for n in names])


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and it with bytes 255 up to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def features(payloads: list[bytes]) -> list[str]:
    """For each payload: of its mu-law, A-law and ADPCM reading the mean, RMS, peak, sign changes and
    CRC-32 of the resampled PCM, all from whole numbers. Clips are decoded together, as one array."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    said: list[list[str]] = [[] for _ in payloads]
    first = np.cumsum(sizes) - sizes
    for name, pcm, starts in (
        ("mulaw", MULAW[raw], first),
        ("alaw", ALAW[raw], first),
        ("ima", decode_ima(raw.reshape(-1, BLOCK)).reshape(-1), first // BLOCK * (2 * (BLOCK - 4) + 1)),
    ):
        out, at = resample(pcm, starts), 2 * starts
        wide = out.astype(np.int64)
        n = np.diff(np.append(at, len(out)))
        total, power = np.add.reduceat(wide, at), np.add.reduceat(wide * wide, at)
        peak = np.maximum.reduceat(np.abs(wide), at)
        turn = np.zeros(len(out), np.int64)
        turn[1:] = (out[1:] < 0) != (out[:-1] < 0)
        turn[at] = 0
        turns = np.add.reduceat(turn, at)
        for i, (lo, k) in enumerate(zip(at, n)):
            said[i].append(f"{name}:{k},{total[i] / k:.3f},{(power[i] / k) ** 0.5:.3f},{peak[i]},{turns[i]},{zlib.crc32(out[lo : lo + k]):08x}")
    return [";".join(x) for x in said]


def _media_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        ids, rows, payloads, size, start = batch.column("doc_id"), [], [], 0, 0
        texts = batch.column("text").to_pylist()
        for i, text in enumerate(texts):
            n, payload = padded(text)
            media = wav(payload, FORMAT_MULAW, RATE_IN, 8)
            _, _, back = wav_parts(media)
            rows.append([n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest()])
            payloads.append(back)
            size += len(back)
            if size > CHUNK or i + 1 == len(texts):
                cols = list(zip(*rows))
                arrays = [pa.array(c, pa.string() if k in (2, 5) else pa.int64()) for k, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(rows)), *arrays, pa.array(features(payloads))], names=names)
                rows, payloads, size, start = [], [], 0, i + 1


def text_media(df: DataFrame) -> DataFrame:
    """Store each text of (doc_id, text) as mu-law samples in a WAV file, read it back and describe it.

    A null text is an empty one and becomes one block of padding. A null id stays null. Each row
    stands alone, so repeated rows have equal results and an empty table gives an empty one.
    """
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _media_batches,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
