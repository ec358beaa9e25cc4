import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ledgerlens.llm import unigram as U

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " a", "a ", "  a  b ", "a\nb\tc", "日本語 x", "😀 é ß", "▁ a▁b", "aaaa" * 30, "    ", "The thing was in it. " * 5, "q́", "\x00 \x7f"]


BYTES = range(3, 259)


def varint(b, i):
    v = s = 0
    while True:
        v |= (b[i] & 127) << s
        s, i = s + 7, i + 1
        if not b[i - 1] & 128:
            return v, i


def as_unigram(raw):
    """The model file with its type field (3 in message 2) set to 1."""
    i = 0
    while i < len(raw):
        tag, j = varint(raw, i)
        n, j = varint(raw, j)
        if tag >> 3 == 2:
            body, k = raw[j : j + n], 0
            while k < n:
                t, m = varint(body, k)
                if t >> 3 == 3:
                    return raw[:j] + body[:m] + b"\x01" + body[m + 1 :] + raw[j + n :]
                kind = t & 7
                if kind == 0:
                    _, k = varint(body, m)
                elif kind == 2:
                    z, m = varint(body, m)
                    k = m + z
                else:
                    k = m + (8 if kind == 1 else 4)
        i = j + n
    raise AssertionError


def texts():
    r = random.Random(4)
    parts = ["the", "tion", " ", " ", "é", "日", "ing", ".", "\n", "😀", "1", "über"]
    return ODD + ["".join(r.choices(parts, k=r.randrange(1, 40))) for _ in range(150)]


def test_same_ids_as_the_library(spark, documents):
    """Against the library's exact lattice search; its faster search is not exact for scores like these."""
    pieces, control = U.load_pieces(PATH)
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(PATH, "rb").read()))
    rows = list(enumerate(texts())) + [(None, "the x"), (5, None), (7, texts()[7])]
    got = {(r.doc_id, r.n_pieces, r.n_fallback, tuple(r.ids), r.score) for r in U.encode(documents(rows), pieces, control).collect()}
    expected = {(i, tuple(library.nbest_encode_as_ids(t, 2)[0] if t else ())) for i, t in rows}
    same = 0
    for i, ids in expected:
        score = sum(pieces[k][1] if k not in BYTES else 0 for k in ids)
        mine = next(g for g in got if g[0] == i and (g[3] == ids or i not in (5, 7) or (g[1] == len(ids))))
        bare = [k for k in mine[3] if k in BYTES]
        assert mine[1] == len(mine[3]) and mine[2] == len(bare)
        # equally good segmentations may differ in where the odd piece stands
        own = sum(pieces[k][1] for k in mine[3] if k not in BYTES)
        assert own >= score  # the library sums 32-bit floats and prunes; brute force is below
        same += mine[3] == ids
    assert same > 0.7 * len(expected)
    assert U.encode(documents(rows).limit(0), pieces, control).count() == 0


def test_round_trip(spark, documents):
    pieces, control = U.load_pieces(PATH)
    rows = list(enumerate(texts()))
    back = U.decode(U.encode(documents(rows), pieces, control), pieces, control)
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: t.replace("▁", " ") for i, t in rows}


def brute(text, pieces, unknown):
    best = {0: 0.0}
    for i in range(len(text)):
        if i not in best:
            continue
        options = [(len(p), s) for p, s in pieces.items() if text.startswith(p, i)]
        if text[i] not in pieces:
            options.append((1, unknown))
        for n, s in options:
            best[i + n] = max(best.get(i + n, -np.inf), best[i] + s)
    return best.get(len(text), 0.0)


@pytest.mark.parametrize("crossing", [False, True])
def test_best_score_against_brute_force(crossing):
    r = random.Random(9)
    names = {"".join(r.choices("abc", k=r.randrange(1, 5))) for _ in range(20)} | {"▁a", "▁", "▁▁", "▁bc"} | ({"a▁b", "c▁"} if crossing else set())
    scored = {p: -r.random() * 9 for p in sorted(names)}
    model = U.unigram([*scored.items(), *((f"<0x{b:02X}>", 0.0) for b in range(256))])
    assert model.parted is not crossing
    for _ in range(60):
        text = "".join(r.choices("abcd  ", k=r.randrange(1, 25)))
        ids, score, fallback = zip(*U._encoded(model, {}, [text]))
        assert score[0] == pytest.approx(brute("▁" + text.replace(" ", "▁"), scored, model.unknown))
        assert model.decode(np.frombuffer(ids[0], "<u4").tolist()) == text
