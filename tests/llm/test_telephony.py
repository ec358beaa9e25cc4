"""Media columns against a decoder that takes one code at a time."""

import struct

import numpy as np
import pytest

from ledgerlens.llm import telephony as T


def ima(data, align):
    out = []
    for at in range(0, len(data), align):
        b = data[at : at + align]
        level, index = struct.unpack_from("<h", b)[0], min(b[2], 88)
        out.append(level)
        for code in (c for x in b[4:] for c in (x & 15, x >> 4)):
            step = int(T.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            level = max(-32768, min(32767, level - change if code & 8 else level + change))
            index = max(0, min(88, index + int(T.INDEX_CHANGE[code & 7])))
            out.append(level)
    return out


def file(data, tag, bits, align, channels=1):
    form = struct.pack("<HHIIHHH", tag, channels, 8000, 8000 * align, align, bits, 0)
    return b"RIFF" + struct.pack("<I", 20 + len(form) + len(data)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data


def decoded(spark, blobs):
    df = spark.createDataFrame(list(enumerate(blobs)), "i int, media binary")
    return [r for _, r in sorted((r["i"], r) for r in T.decode_media(df).collect())]


def test_adpcm_of_several_alignments_and_short_last_blocks(spark):
    r = np.random.default_rng(1)
    cases = [(r.integers(0, 256, align * blocks + short).astype(np.uint8).tobytes(), align) for align in (256, 512, 576, 1024) for blocks in (0, 3) for short in (0, 4, 100) if blocks + short]
    for (data, align), row in zip(cases, decoded(spark, [file(d, T.FORMAT_IMA, 4, a) for d, a in cases])):
        assert row["error"] is None
        assert np.frombuffer(T.wav_parts(bytes(row["pcm"]))[2], np.int16)[::2].tolist() == ima(data, align)


@pytest.mark.parametrize("tag, bits", [(T.FORMAT_MULAW, 8), (T.FORMAT_ALAW, 8), (T.FORMAT_PCM, 16)])
def test_other_formats(spark, tag, bits):
    (row,) = decoded(spark, [file(bytes(range(256)), tag, bits, bits // 8)])
    table = {T.FORMAT_MULAW: T.MULAW, T.FORMAT_ALAW: T.ALAW}.get(tag, np.arange(256, dtype=np.uint8).view(np.int16))
    assert row["error"] is None and np.frombuffer(T.wav_parts(bytes(row["pcm"]))[2], np.int16)[::2].tolist() == table.tolist()


def test_what_is_not_handled_is_said(spark):
    data = bytes(600)
    blobs = [file(data, T.FORMAT_PCM, 16, 4, 2), file(data, T.FORMAT_PCM, 8, 1), file(data, T.FORMAT_MULAW, 8, 2, 2), file(data, T.FORMAT_IMA, 3, 256), file(data[:258], T.FORMAT_IMA, 4, 256), file(data[:3], T.FORMAT_PCM, 16, 2), b"x", file(data, 85, 0, 1)]
    rows = decoded(spark, [*blobs, None])
    assert all(r["error"] and r["pcm"] is None and r["n_samples"] is None for r in rows[:-1])
    assert (rows[-1]["error"], rows[-1]["pcm"]) == (None, None)


def plain_features(payload):
    """The feature of a payload, one sample at a time."""
    import zlib

    def mulaw(b):
        b = ~b & 255
        size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
        return -size if b & 128 else size

    def alaw(b):
        b ^= 0x55
        part, low = b >> 4 & 7, b & 15
        size = (low << 4) + 8 if not part else (low << 4) + 0x108 << part - 1
        return size if b & 128 else -size

    said = []
    for name, pcm in (("mulaw", [mulaw(b) for b in payload]), ("alaw", [alaw(b) for b in payload]), ("ima", ima(payload, T.BLOCK))):
        out = [v for a, b in zip(pcm, [*pcm[1:], pcm[-1]]) for v in (a, (a + b + 1) >> 1)]
        turns = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:]))
        crc = zlib.crc32(struct.pack(f"<{len(out)}h", *out))
        said.append(f"{name}:{len(out)},{sum(out) / len(out):.3f},{(sum(v * v for v in out) / len(out)) ** 0.5:.3f},{max(abs(v) for v in out)},{turns},{crc:08x}")
    return ";".join(said)


def test_stored_texts_match_brute_force(spark):
    import hashlib
    import zlib

    long = "".join(chr(32 + k * k % 90) for k in range(150_000))
    rows = [(1, "short"), (2, None), (3, ""), (4, "ü" * 288), (5, "x" * 577), (6, long), (6, "short"), (None, "short"), (8, long[:9000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id or 0, r.n_bytes, r) for r in T.text_media(df).collect())
    want = sorted((i or 0, len((t or "").encode()), t or "") for i, t in rows)
    for (i, n, r), (j, m, text) in zip(got, want, strict=True):
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (i, n, r.payload_bytes) == (j, m, len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = T.wav(payload, T.FORMAT_MULAW, T.RATE_IN, 8)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and T.wav_parts(media)[2] == payload
        assert r.feature == plain_features(payload)
    assert T.text_media(df.limit(0)).count() == 0


def test_media_columns_of_any_names(spark):
    df = spark.createDataFrame([(file(bytes(range(256)), T.FORMAT_ALAW, 8, 1), "x", "y")], "`the media` binary, __decoded string, error string")
    (row,) = T.decode_media(df, "the media").collect()
    assert row["__decoded"] == "x" and row["error"] is None and row["n_samples"] == 512
    assert T.decode_media(df.limit(0), "the media").count() == 0
