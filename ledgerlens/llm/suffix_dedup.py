"""Suffix-array dedup: remove bytes of 100-byte strings that occur earlier in the corpus.

Whole texts never meet in one task. Each window of ``WINDOW`` bytes picks an anchor, the smallest of
its ``GRAM``-byte grams by hash, so equal windows pick equal anchors at equal places. Windows that
follow each other with one anchor form a context. Contexts that are alone with their anchor cannot
repeat, and contexts that are equal repeat as a whole; what is left, different contexts with the
same anchor, is gathered by anchor. There the contexts' suffixes are put in order: each shard has
its own Burrows-Wheeler transform, and the transforms are merged by interleave refinement. What is
one block after refining to ``WINDOW`` bytes is an interval of suffixes with that common prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import LAST_ID, unpack, with_document_key, written

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
#: Bytes of text hashed together, contexts' bytes ordered together, shards of these.
RUN_BYTES, BLOCK_BYTES, SHARDS = 1 << 18, 1 << 17, 4
#: Contexts with one anchor that are ordered in one block; those of larger groups are dealt by window.
ANCHOR_LIMIT = 32768
M = np.uint64
#: Odd multipliers of the gram hashes.
MIX = [M(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
PLACE = M((1 << 20) - 1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and each value's place in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, built by doubling."""
    h, step = (b.astype(np.uint64) + M(1)) * M(0xFF51AFD7ED558CCD), 1
    for mix in MIX:
        h = h[:-step] * mix + h[step:]
        h ^= h >> M(29)
        step *= 2
    return h


def contexts(b: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Anchors of the windows of ``b`` that start in first[i]..last[i] (inclusive), as arrays:
    anchor hash, context hash, context start, context end."""
    g = gram_hashes(b)
    low = (g * M(0x9FB21C651E98DF25)) & ~PLACE | np.arange(len(g), dtype=np.uint64)
    step = 1
    while step * 2 <= SPAN:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(low) - (SPAN - step)], low[SPAN - step :])
    inside = np.zeros(len(b) + 1, np.int32)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1])[: len(low)] > 0)
    place = (low[window] & PLACE).astype(np.int64)
    new = np.ones(len(place), bool)
    # the next text's first window never shares an anchor with this one's last
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(place)) - 1
    if not len(place):
        head = tail = np.zeros(0, np.int64)
    at, start, end = place[head], window[head], window[tail] + WINDOW
    h = ((end - start) * 256 + (at - start)).astype(np.uint64) * MIX[0]
    # a context has at most SPAN + WINDOW - 1 bytes; the last gram is moved back to its end, so all bytes count
    for k in range(-(-(SPAN + WINDOW - 1) // GRAM)):
        h = (h ^ g[np.minimum(start + GRAM * k, end - GRAM)]) * MIX[1 + k % 4]
        h ^= h >> M(31)
    return g[at], h, start, end


def merged(doc, th, start, stop):
    """Spans of each document joined where they touch, in order."""
    o = np.lexsort((start, th, doc))
    doc, th, start, stop = doc[o], th[o], start[o], stop[o]
    if not len(doc):
        return doc, th, start, stop
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    owner = np.cumsum(new)
    top = np.maximum.accumulate(stop + owner * (1 << 32)) - owner * (1 << 32)
    new[1:] |= start[1:] > top[:-1]
    head = np.flatnonzero(new)
    return doc[head], th[head], start[head], top[np.append(head[1:], len(doc)) - 1]


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, doc, th, span, stop): a row for each context, and rows without a context for
    spans that are known to repeat because the same context came earlier in the same batch."""
    for batch in batches:
        data, at = utf8(batch.column("body"))
        doc = batch.column("doc").to_numpy()
        th = batch.column("th").to_numpy()
        found, i = [], 0
        while i < len(doc):
            j = max(i + 1, int(np.searchsorted(at, at[i] + RUN_BYTES, side="right")) - 1)
            base = at[i]
            pieces = [(base, at[j])]
            if at[j] - base > RUN_BYTES:  # one long text, in pieces that share all but a byte of a window
                pieces = [(p, min(p + RUN_BYTES + WINDOW - 1, at[j])) for p in range(base, at[j], RUN_BYTES)]
            for lo, hi in pieces:
                own = np.arange(i, j)
                first, last = np.maximum(at[i:j], lo) - lo, np.minimum(at[i + 1 : j + 1], hi) - WINDOW - lo
                ok = last >= first
                if ok.any():
                    a, c, s, e = contexts(data[lo:hi], first[ok], last[ok])
                    k = np.searchsorted(at, s + lo, side="right") - 1
                    # texts without bytes have equal places
                    found.append((a, c, doc[k], th[k], s + lo - at[k], e - s))
            i = j
        if not found:
            continue
        a, c, d, t, s, n = (np.concatenate(x) for x in zip(*found))
        span = (s << 14) | n
        o = np.lexsort((span, t, d, c, a))
        a, c, d, t, span = a[o], c[o], d[o], t[o], span[o]
        again = np.zeros(len(a), bool)
        again[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(a))))
        known = again & ((d != d[head]) | (t != t[head]) | (span != span[head]))
        gd, gt, gs, ge = merged(d[known], t[known], *_unspan(span[known]))
        keep = ~again
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([a[keep].view(np.int64), (gd.astype(np.uint64) * MIX[0]).view(np.int64)])),
                pa.array(np.concatenate([c[keep].view(np.int64), np.zeros(len(gd), np.int64)]), mask=np.repeat([False, True], [keep.sum(), len(gd)])),
                pa.array(np.concatenate([d[keep], gd])),
                pa.array(np.concatenate([t[keep], gt])),
                pa.array(np.concatenate([span[keep], gs << 14])),
                pa.array(np.concatenate([np.zeros(keep.sum(), np.int64), ge]).astype(np.int32), mask=np.repeat([True, False], [keep.sum(), len(gd)])),
            ],
            names=["anchor", "context", "doc", "th", "span", "stop"],
        )


def _unspan(span):
    """Start and end of packed spans."""
    start = span >> 14
    return start, start + (span & 0x3FFF)


FOUND = "doc long, th long, start int, stop int, anchor long"


def _found(doc, th, start, stop, anchor=None) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor)
    ints = [pa.array(np.asarray(x).astype(np.int32)) for x in (start, stop)]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), *ints, none], names=["doc", "th", "start", "stop", "anchor"])


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of anchor, context and place: spans that repeat as whole contexts (no anchor),
    and the first of each context whose anchor has other contexts too (with the anchor)."""
    last = None  # anchor, context, doc, text hash and span of the current context's first row
    pending = None  # the anchor's first context, while it has no other
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "doc", "th", "span")]
        is_known = batch.column("context").is_null().to_numpy(zero_copy_only=False)
        context = batch.column("context").fill_null(0).to_numpy()
        if is_known.any():
            _, d, t, s = (x[is_known] for x in cols)
            yield _found(d, t, _unspan(s)[0], batch.column("stop").fill_null(0).to_numpy()[is_known])
        a, d, t, s = (x[~is_known] for x in cols)
        c = context[~is_known]
        if not len(a):
            continue
        if last is not None:
            a, c, d, t, s = (np.concatenate([[x], y]) for x, y in zip(last, (a, c, d, t, s)))
        new_a, new_c = np.ones(len(a), bool), np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_c[1:] = new_a[1:] | (c[1:] != c[:-1])
        head = np.maximum.accumulate(np.where(new_c, np.arange(len(a)), 0))
        gone = ~new_c & ((d != d[head]) | (t != t[head]) | (s != s[head]))
        if gone.any():
            yield _found(d[gone], t[gone], *_unspan(s[gone]))
        runs = np.flatnonzero(new_c)
        other = ~new_a[runs]  # a further context of its anchor
        if last is not None:
            other[0] = False  # the row carried over was told of already, or is pending
        need = other.copy()
        need[:-1] |= new_a[runs[:-1]] & other[1:]
        if last is not None and pending is None:
            need[0] = False
        if need.any():
            k = runs[need]
            yield _found(d[k], t[k], *_unspan(s[k]), a[k])
        # is the last context pending: the only one of its anchor so far
        alone = bool(new_a[runs[-1]]) if len(runs) > 1 or last is None else pending is not None
        pending = True if alone else None
        k = runs[-1]
        last = (a[k], c[k], d[k], t[k], s[k])


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the contexts that are asked for out of the texts."""
    for batch in batches:
        data, at = utf8(batch.column("body"))
        asked = batch.column("asked")
        counts = np.diff(asked.offsets.to_numpy())
        flat = asked.flatten()
        start, stop = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop"))
        owner = np.repeat(np.arange(len(counts)), counts)
        lo, n = at[owner] + start, stop - start
        ends = np.cumsum(n)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)
        offsets = np.append(0, ends).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[take].tobytes())])
        doc, th = (batch.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("doc", "th"))
        yield pa.RecordBatch.from_arrays(
            [flat.field("anchor"), pa.array(doc), pa.array(th), pa.array(start.astype(np.int32)), pieces],
            names=["anchor", "doc", "th", "start", "piece"],
        )


def packed_symbols(b: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Codes of the q bytes from each place on, under 2**16 - 1 of them, with q as large as that allows.

    q is 10, 5, 4, 2 or 1 and divides the window, so a window is window / q codes. Any order of the
    codes will do, as only equality of windows is asked of the order of suffixes.
    """
    for q in (5, 4, 2, 1):
        if window % q or len(b) < q:
            continue
        value = np.zeros(len(b) - q + 1, np.uint64)
        for k in range(q):
            value = value << M(8) | b[k : len(b) - q + 1 + k]
        code, names = pd.factorize(value)
        del value
        if len(names) < 65535:
            code = code.astype(np.uint16)
            break
    if q == 5 and window % 10 == 0 and len(b) >= 10:
        twice, names = pd.factorize(code[:-5].astype(np.int64) << 16 | code[5:])
        if len(names) < 65535:
            return twice.astype(np.uint16), 10
    return code, q


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic text in order of the ``depth`` symbols from there on: stable passes by one more symbol in front."""
    o = np.arange(len(text), dtype=np.int32)
    for _ in range(depth):
        o -= 1
        o[o < 0] = len(text) - 1
        o = o[np.argsort(text[o], kind="stable")]
    return o


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge Burrows-Wheeler transforms by iterative interleave refinement.

    Returns (row, block) in merged order: rows count through the transforms one after the other; rows
    of one block have their first ``depth`` symbols in common. The interleave starts as one
    transform after the other. A round reads the symbols in the order it has, and a stable
    distribution by symbol gives the order by one symbol more: no suffix is looked at again. A block
    splits where the symbols or the blocks that they came from differ, that is where the common
    prefix ends.
    """
    symbols = np.concatenate(transforms)
    label = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    block = np.zeros(len(symbols), np.int32)
    row = places = np.arange(len(symbols), dtype=np.int32)
    for _ in range(depth):
        read = symbols[row]
        o = np.argsort(read, kind="stable")
        label, read, block = label[o], read[o], block[o]
        split = (read[1:] != read[:-1]) | (block[1:] != block[:-1])
        del o
        block = np.zeros(len(read), np.int32)
        np.cumsum(split, out=block[1:])
        row = np.empty_like(places)
        row[np.argsort(label, kind="stable")] = places
    return row, block


def repeated_windows(b: np.ndarray, at: np.ndarray, rank: np.ndarray, window: int = WINDOW, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of each window that an earlier piece (smaller rank, or earlier offset) holds too.

    Piece i is b[at[i]:at[i+1]]. Places are 32 bits wide and dropped after their last use, as a block of the
    commonest anchors has millions of them and two tasks share an executor.
    """
    n = np.diff(at)
    code, q = packed_symbols(b, window)
    depth = window // q
    # each piece gives q strings, one for each phase, of codes that follow one another q bytes apart
    pieces = np.arange(len(n), dtype=np.int32)
    sizes = np.maximum(0, (n[:, None] - np.arange(q)) // q).astype(np.int64)  # codes of each phase
    strings = np.cumsum((sizes + 1).ravel())
    first = (strings - (sizes + 1).ravel()).reshape(sizes.shape)
    owner = np.repeat(pieces, n)
    offset = np.arange(len(b), dtype=np.int32) - at.astype(np.int32)[owner]
    whole = offset + q <= n.astype(np.int32)[owner]
    owner, offset = owner[whole], offset[whole]
    to = first.astype(np.int32)[owner, offset % q] + offset // q
    text = np.zeros(strings[-1], np.uint16)
    text[to] = code[np.flatnonzero(whole)] + 1  # 0 ends a string
    piece, start = np.full(len(text), -1, np.int32), np.zeros(len(text), np.int32)
    piece[to], start[to] = owner, offset
    del code, owner, offset, whole, to
    cuts = np.append(first[:: max(1, -(-len(n) // shards)), 0], len(text))
    orders = [suffix_order(text[lo:hi], depth) for lo, hi in zip(cuts, cuts[1:])]
    transforms = [text[lo:hi][o - 1] for (lo, hi), o in zip(zip(cuts, cuts[1:]), orders)]
    del text
    row, block = merge_transforms(transforms, depth)
    suffix = np.concatenate([o + np.int32(lo) for lo, o in zip(cuts, orders)])[row]
    del row, orders, transforms
    piece, start = piece[suffix], start[suffix]
    del suffix
    full = (piece >= 0) & (start + window <= n[piece])
    piece, start, block = piece[full], start[full], block[full]
    head = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    if not len(head):
        return piece, start
    key = rank[piece] * (1 << 32) + start
    least = np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(key))))
    gone = key > least
    return piece[gone], start[gone]


def _ordered_block(batch: pa.Table) -> pa.RecordBatch:
    column = pa.concat_arrays(batch.column("piece").chunks)
    data, at = utf8(column)
    data, at = data[at[0] : at[-1]], at - at[0]
    doc, th, begin = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "th", "start"))
    o = np.lexsort((begin, th, doc))
    new = np.ones(len(o), bool)
    new[1:] = (np.diff(doc[o]) != 0) | (np.diff(th[o]) != 0) | (np.diff(begin[o]) != 0)
    rank = np.empty(len(doc), np.int64)
    rank[o] = np.cumsum(new)  # repeats of one row come equally early
    piece, start = repeated_windows(data, at, rank)
    lo = begin[piece] + start
    return _found(*merged(doc[piece], th[piece], lo, lo + WINDOW))


def _ordered_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Order the contexts of whole anchors, about BLOCK_BYTES at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.column("piece").nbytes for x in held) < BLOCK_BYTES:
            continue
        table = pa.Table.from_batches(held)
        anchor = table.column("anchor").to_numpy()
        size = np.cumsum(np.diff(utf8(pa.concat_arrays(table.column("piece").chunks))[1]))
        edges = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        at = 0
        for edge in edges:
            if size[edge - 1] - (size[at - 1] if at else 0) >= BLOCK_BYTES:
                yield _ordered_block(table.slice(at, edge - at))
                at = edge
        held = table.slice(at).combine_chunks().to_batches()
    if held and sum(x.num_rows for x in held):
        yield _ordered_block(pa.Table.from_batches(held))


def _crowded(pieces: DataFrame) -> DataFrame:
    """Spans that repeat among contexts with a very common anchor: windows meet by their own hash,
    with map-side minima, so that no task gathers the anchor's contexts."""
    windows = pieces.select("doc", "th", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.octet_length("piece") - WINDOW + 1), lambda i: F.substring("piece", i, F.lit(WINDOW)))
    ).alias("o", "w"), "start").select("doc", "th", (F.col("start") + F.col("o")).alias("at"), F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), F.col("w")).alias("h2"))
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(first, ["h1", "h2"]).where(F.struct("doc", "th", "at") > F.col("first")).select(
        "doc", "th", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("stop")
    )


def repeated_spans(base: DataFrame, anchor_limit: int = ANCHOR_LIMIT) -> DataFrame:
    """(doc, th, start, stop) of bytes to remove, for ``base`` (doc, th, body)."""
    rows = base.select("doc", "th", "body").mapInArrow(_anchor_batches, "anchor long, context long, doc long, th long, span long, stop int")
    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "th", "span")
    found = written(ordered.mapInArrow(_shared_batches, FOUND), "contexts")
    asked = found.where("anchor is not null")
    wanted = asked.groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "start", "stop")).alias("asked"))
    texts = base.select("doc", "th", F.encode("body", "UTF-8").alias("body"))
    pieces = wanted.join(texts, ["doc", "th"]).select("doc", "th", "body", "asked").mapInArrow(
        _piece_batches, "anchor long, doc long, th long, start int, piece binary"
    )
    crowded = asked.groupBy("anchor").count().where(F.col("count") > anchor_limit).select("anchor")
    if crowded.limit(1).count():
        pieces = written(pieces, "pieces")
        apart = _crowded(pieces.join(crowded, "anchor", "left_semi"))
        pieces = pieces.join(crowded, "anchor", "left_anti")
    else:
        apart = None
    gathered = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc", "th", "start")
    spans = gathered.mapInArrow(_ordered_batches, FOUND).select("doc", "th", "start", "stop")
    spans = written(spans, "spans")
    spans = spans.unionAll(found.where("anchor is null").select("doc", "th", "start", "stop"))
    return spans if apart is None else spans.unionAll(apart)


def _cut(spans, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["stop"]) for x in spans or ()):
        lo, hi = min(s[0], size), min(s[1], size)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif hi > lo:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _kept(body: pa.Array, spans: pa.Array):
    """n_bytes, n_removed, n_spans and the bytes that stay, for each text."""
    for text, cut in zip(body, spans):
        raw = text.as_py()
        gone = _cut(cut.as_py(), len(raw))
        at, parts = 0, []
        for lo, hi in gone:
            parts.append(raw[at:lo])
            at = hi
        parts.append(raw[at:])
        yield len(raw), sum(hi - lo for lo, hi in gone), len(gone), b"".join(parts) if gone else raw


def _digest(body: pa.Array, spans: pa.Array) -> pa.Array:
    rows = [(a, b, c, hashlib.sha256(kept).hexdigest()) for a, b, c, kept in _kept(body, spans)]
    cols = list(zip(*rows)) or [()] * 4
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rest(body: pa.Array, spans: pa.Array) -> pa.Array:
    cols = list(zip(*_kept(body, spans))) or [()] * 4
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])


def _text(body: pa.Array, spans: pa.Array) -> pa.Array:
    """The text that stays, without the characters that a cut leaves in part; null where nothing is cut."""
    out = []
    for text, cut in zip(body, spans):
        raw = text.as_py()
        gone, at, parts = _cut(cut.as_py(), len(raw)), 0, []
        for lo, hi in [*gone, (len(raw), len(raw))]:
            parts.append(raw[at:lo].decode("utf-8", "ignore"))
            at = hi
        out.append("".join(parts) if gone else None)
    return pa.array(out, pa.string())


def _with_spans(df: DataFrame, id_col: str, text_col: str, anchor_limit: int) -> DataFrame:
    base = with_document_key(df, id_col, text_col)
    spans = repeated_spans(base, anchor_limit).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return base.withColumn("body", F.encode("body", "UTF-8")).join(spans, ["doc", "th"], "left")


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor_limit: int = ANCHOR_LIMIT) -> DataFrame:
    """The input's rows with ``kept`` (binary: the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans``.

    A byte goes if a string of WINDOW bytes over it also starts earlier: in a smaller id, or earlier
    in the same document. Strings are those of the input, never of what is left, and never cross
    documents. A null text is empty. Null ids come last. Rows that share an id and differ in text
    are different documents, in order of a hash; rows alike in both have equal results. Columns of
    the input named like a result keep the input's value. An empty table gives an empty table.
    """
    out = _with_spans(df, id_col, text_col, anchor_limit).withColumn("rest", F.arrow_udf(_rest, "n_bytes long, n_removed long, n_spans long, kept binary")("body", "spans"))
    return unpack(out, df, {}, {n: F.col("rest").getField(n) for n in ("kept", "n_bytes", "n_removed", "n_spans")})


def suffix_dedup_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor_limit: int = ANCHOR_LIMIT) -> DataFrame:
    """As suffix_dedup, but with the text that stays in place of the input's; one that isn't cut stays as it is."""
    out = _with_spans(df, id_col, text_col, anchor_limit)
    text = F.coalesce(F.arrow_udf(_text, "string")("body", "spans"), F.col("row").getField(text_col).cast("string"), F.lit(""))
    return unpack(out, df, {text_col: text}, {})


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = _with_spans(documents, "doc_id", "text", ANCHOR_LIMIT)
    digest = F.arrow_udf(_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.nullif(F.col("doc"), F.lit(LAST_ID)).alias("doc_id"), digest("body", "spans").alias("d")).select("doc_id", "d.*")
