import hashlib
import random

import numpy as np
import pytest

from ledgerlens.llm import suffix_dedup as S


def brute(rows, window=100):
    """{doc: (n_bytes, n_removed, n_spans, sha)} for rows (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                gone[i : i + window] = True
            seen.add(w)
        spans = int(gone[:1].sum() + ((~gone[:-1]) & gone[1:]).sum()) if len(raw) else 0
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def corpus(seed=5, n=120):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "éta", "delta", "of", "the", "zu", "\n"]
    passages = [" ".join(r.choices(words, k=k)) for k in (30, 40, 25, 18, 60)]
    texts = []
    for i in range(n):
        parts = [" ".join(f"{r.choice(words)}{r.randrange(999)}" for _ in range(r.randrange(1, 60))) for _ in range(r.randrange(1, 4))]
        for _ in range(r.randrange(0, 3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3][:150] + "X" + texts[3][150:], "a" * 450, "ab" * 300, "a" * 99, "a" * 100, "", None, "Ü, " * 200, "\0" * 230 + "q"]
    order = list(range(len(texts)))
    r.shuffle(order)
    return list(zip(order, texts))


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("limit", [S.ANCHOR_LIMIT, 3])
def test_matches_brute_force(spark, limit):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(S.suffix_dedup(df, anchor_limit=limit)) == brute(rows)


def test_long_text_is_cut_in_pieces(spark, monkeypatch):
    r = random.Random(1)
    block = "".join(r.choices("abcdefgh ", k=3000))
    long = "".join(r.choices("abcdefgh ", k=S.RUN_BYTES - 1500)) + block + "".join(r.choices("xyz ", k=5000)) + block
    rows = [(1, long), (2, "head " + block[100:2000] + " tail")]
    assert result(S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_merge_gives_intervals_of_common_prefixes():
    r = np.random.default_rng(0)
    text = r.integers(1, 3, 400).astype(np.uint16)
    text[::40] = 0
    cuts = [0, 120, 280, 400]
    orders = [S.suffix_order(text[a:b], 6) for a, b in zip(cuts, cuts[1:])]
    row, block = S.merge_transforms([text[a:b][o - 1] for (a, b), o in zip(zip(cuts, cuts[1:]), orders)], 6)
    at = np.concatenate([o + a for a, o in zip(cuts, orders)])[row]
    shard_end = np.searchsorted(cuts, at, side="right")
    prefix = []
    for p, e in zip(at, shard_end):
        lo, hi = cuts[e - 1], cuts[e]
        prefix.append(tuple(text[lo + (p - lo + k) % (hi - lo)] for k in range(6)))
    assert prefix == sorted(prefix)
    assert [b != a for a, b in zip(block, block[1:])] == [b != a for a, b in zip(prefix, prefix[1:])]


def test_memory_of_a_block_in_proportion_to_its_bytes():
    """A block of the commonest anchors has 5.5 MB of contexts; it took 122 bytes a byte of them."""
    import tracemalloc

    r = np.random.default_rng(5)
    n, size = 4000, 168
    b = np.tile(r.integers(97, 123, size).astype(np.uint8), (n, 1))
    b[np.arange(n), r.integers(0, size, n)] = 65 + r.integers(0, 26, n)
    tracemalloc.start()
    piece, start = S.repeated_windows(b.ravel(), np.arange(n + 1) * size, np.arange(n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    seen, want = set(), set()
    for i, row in enumerate(b):
        raw = row.tobytes()
        for k in range(size - S.WINDOW + 1):
            w = raw[k : k + S.WINDOW]
            if w in seen:
                want.add((i, k))
            seen.add(w)
    assert set(zip(piece.tolist(), start.tolist())) == want and len(piece) == len(want)
    assert peak < 80 * b.size


def test_nulls_repeats_clashes_and_empty(spark):
    text = "".join(random.Random(3).choices("abcdef", k=300))
    rows = [(None, text, "x"), (1, text, None), (1, text, "y"), (2, None, "z"), (3, text[:120], "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_spans string")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed, r.n_spans or "") for r in S.suffix_dedup(df).collect())
    assert [(a, b) for a, b, _ in got] == [(1, 0), (1, 0), (2, 0), (3, 120), (99, 300)]
    assert {c for *_, c in got} == {"x", "", "y", "z", "w"}
    assert S.suffix_dedup(df.limit(0)).count() == 0


def test_context_hash_covers_the_last_bytes():
    b = np.random.default_rng(4).integers(97, 123, 200_000).astype(np.uint8)
    anchor, h, start, end = S.contexts(b, np.array([0]), np.array([len(b) - S.WINDOW]))
    long = np.flatnonzero(end - start > 160)
    assert len(long) > 100
    changed = alike = 0
    for i in long:
        for back in range(1, end[i] - start[i] - 160 + 1):
            other = b[start[i] : end[i]].copy()
            other[-back] ^= 1
            a2, h2, s2, e2 = S.contexts(other, np.array([0]), np.array([len(other) - S.WINDOW]))
            # the change may move the anchor; else it is one context of the same shape
            if len(a2) == 1 and a2[0] == anchor[i]:
                changed, alike = changed + 1, alike + int(h2[0] == h[i])
    assert changed > 100 and not alike


def test_passages_that_diverge_at_their_end(spark):
    r = random.Random(9)
    letters = lambda k: "".join(r.choices("abcdefghij ", k=k))
    rows = []
    for k in range(400):
        passage = letters(r.randrange(170, 400))
        tail = letters(60)
        rows += [(4 * k, letters(20) + passage + tail), (4 * k + 1, letters(20) + passage + letters(60))]
        if k % 2:  # what comes after the passage repeats elsewhere too
            rows.append((4 * k + 2, letters(20) + passage[-110:] + rows[-1][1][-60:]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(S.suffix_dedup(df)) == brute(rows)


@pytest.mark.parametrize("limit", [S.ANCHOR_LIMIT, 3])
def test_texts_without_an_id_stay_apart(spark, limit):
    import xxhash

    r = random.Random(11)
    letters = lambda k: "".join(r.choices("abcdefghij ", k=k))
    shared = [letters(130) for _ in range(40)]
    texts = [letters(r.randrange(100, 300)) + (r.choice(shared) if k % 3 else "") + letters(r.randrange(60)) for k in range(3000)]
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    low = {}
    for t in texts:
        low.setdefault(signed(t) & 0xFFFF, []).append(t)
    assert sum(len(v) > 1 for v in low.values()) > 30
    # a document's place in the order is its text's hash; they have no id
    want = brute([(signed(t), t) for t in texts])
    got = S.suffix_dedup(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(5), anchor_limit=limit).collect()
    assert len(got) == len(texts)
    assert {signed(x.text): (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in got} == want
