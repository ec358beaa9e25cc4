import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", " a", "a  b", "a \n b", "it's we'll 12 3", "x  y", "tail ", "  ", "\n\n", "Ü, Ü", "日本 語", "a<|endoftext|>b", "%%% ### \t x"]


def test_units_give_the_same_ids_as_whole_texts():
    t = Tokenizer.from_file(PATH)
    texts = [*ODD, " ".join(ODD), "\n".join(ODD)]
    assert P.UnitIds(PATH)(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_very_long_white_space_is_encoded():
    texts = ["a" + blank * 1_500_000 + "b c" for blank in (" ", "\n")]
    t = Tokenizer.from_file(PATH)
    assert P.UnitIds(PATH)(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_texts_are_encoded_whole(monkeypatch):
    """A text is one call, and nothing of it is kept: units that don't recur were encoded and put together one by one."""
    ids = P.UnitIds(PATH)
    calls, encode = [], ids.encoding.encode_ordinary
    monkeypatch.setattr(ids.encoding, "encode_ordinary", lambda x: calls.append(x) or encode(x))
    texts = [f"w{i} x{i} y{i}" for i in range(9)]
    ids(texts)
    assert calls == texts


def check(rows, texts, capacity):
    t = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_fit_and_hold_every_id(spark, documents):
    texts = {i: x for i, x in enumerate([*ODD, None, "word " * 5000, "ab cd\n" * 2040])} | {100 + i: "some words " * (i % 90) for i in range(400)}
    rows = P.pack(documents(list(texts.items())), PATH, 256).collect()
    n = check(rows, texts, 256)
    assert n <= -(-sum(r.length for r in rows) // 256) * 1.02 + 1
    assert P.pack(documents(list(texts.items())).limit(0), PATH).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z"), (None, None)], "doc_id long, text string")
    rows = P.pack(df, PATH).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_the_histogram(seed):
    r = np.random.default_rng(seed)
    h = np.zeros(301, np.int64)
    h[1:] = r.integers(0, 40, 300) * (r.random(300) < (0.2 + 0.25 * seed))
    packed = P.plan(h, 300)
    back = np.zeros_like(h)
    for lengths, n in packed:
        assert sum(lengths) <= 300 and n > 0
        for v in lengths:
            back[v] += n
    assert (back == h).all()
    assert sum(n for _, n in packed) <= 1.02 * sum(n for _, n in P.best_fit(h, 300)) + 1
