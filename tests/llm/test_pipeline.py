"""Stages of the corpus pipeline against brute force."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def first_of_each(rows):
    """Rows (id, text) that stay: the first of each component of links with a Jaccard similarity of 0.8 or more."""
    sets = [_shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if label[i] != label[j] and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    return [r for k, r in enumerate(rows) if label[k] == k]


def test_simhash_stage_drops_planted_near_copies(spark, documents):
    r = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    common = r.choices(words, k=30)
    rows, planted = [], 0
    for i in range(150):
        w = r.choices(words, k=r.randrange(6, 300)) + (common if i % 3 == 0 else [])
        rows.append((2 * i, " ".join(w)))
        copy = [r.choice(words) if r.random() < 1 / 60 else v for v in w]
        rows.append((2 * i + 1, " ".join(copy)))
        planted += copy != w and 5 * len(_shingles(" ".join(w)) & _shingles(" ".join(copy))) >= 4 * len(_shingles(" ".join(w)) | _shingles(" ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "short text"), (1003, "Short  text")]
    assert planted > 50
    got = sorted(x["doc_id"] for x in P.simhash_stage(spark, documents(rows), "").collect())
    assert got == [i for i, _ in first_of_each(rows)]


def test_simhash_stage_of_nothing(spark, documents):
    assert P.simhash_stage(spark, documents([]), "").count() == 0


def test_simhash_stage_keeps_one_of_rows_without_an_id(spark, documents):
    text = " ".join(f"v{k}" for k in range(50))
    other = " ".join(f"z{k}" for k in range(50))
    rows = [(None, text), (None, text), (None, other), (None, other), (None, other), (7, text), (8, "seven words that no other text has"), (8, "seven words that no other text has")]
    got = sorted((x["doc_id"] or 99, x["text"]) for x in P.simhash_stage(spark, documents(rows), "").collect())
    assert got == [(7, text), (8, rows[-1][1]), (99, other)]


def test_suffix_stage_trims_cut_characters_only(spark, documents):
    r = random.Random(5)
    letters = lambda k: "".join(r.choices("abcdefgh ", k=k))
    shared = letters(150)
    # U+00E9 and U+00E8 share their first byte, U+00E9 and U+0129 their last
    rows = [
        (1, "clean \ufffd text"), (2, letters(30) + "\u00e9" + shared + "\u00e9" + letters(30)), (3, "A\ufffdB" + "\u0129" + shared + "\u00e8" + "C\ufffdD"), (4, None),
    ]
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in P.suffix_stage(spark, documents(rows), "").collect()}
    assert got == {1: ("clean \ufffd text", 12), 2: (rows[1][1], len(rows[1][1])), 3: ("A\ufffdBC\ufffdD", 6), 4: ("", 0)}


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ODD = [(None, None), (None, ""), (1, None), (2, ""), (3, "a line of some length\nx"), (3, "a line of some length\nx"), (4, "A Line of some length \ny"), (None, "a line of some length"), (5, "word " * 4000), (6, "a line of some length\nx")]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(i, 1 if i < 300 else 0) for i in range(600)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_quality_stage_drops_what_it_rejects(spark, documents, folder):
    rows = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(60))) for i in range(300)] + [(i, "BUY!! | " * (20 + i % 9)) for i in range(300, 600)] + ODD[:1]
    got = P.quality_stage(spark, documents(rows), folder)
    assert got.columns == COLUMNS
    ids = {r.doc_id for r in got.collect()}
    assert {i for i in range(300)} <= ids and not ids & set(range(300, 600))


def test_line_stage_matches_brute_force(spark, documents):
    first = {}
    for i, text in ODD:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").lower()
            first.setdefault(key, set()).add(i if i is not None else 1 << 62)
    def kept(i, text):
        i = i if i is not None else 1 << 62
        lines = []
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").lower()
            if len(key) < 10 or len(first[key]) < 2 or min(first[key]) == i:
                lines.append(line)
        return "\n".join(lines)

    got = P.line_stage(spark, documents(ODD), "")
    assert got.columns == COLUMNS
    order = lambda rows: sorted((str(i), t, n) for i, t, n in rows)
    assert order((r.doc_id, r.text, r.n_chars) for r in got.collect()) == order((i, kept(i, t), len(kept(i, t))) for i, t in ODD)


def test_packing_stage_holds_every_token(spark, documents):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = P.packing_stage(spark, documents(ODD), "").collect()
    want = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in ODD)
    assert sum(r.length for r in rows) == want
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) == -(-want // 2048)


@pytest.mark.parametrize("stage", [P.line_stage, P.simhash_stage, P.suffix_stage, P.packing_stage])
def test_stages_of_nothing(spark, documents, stage):
    assert stage(spark, documents([]), "").count() == 0


def test_suffix_stage_keeps_rows_without_repeats(spark, documents):
    rows = [(i, t) for i, t in ODD if i != 5]
    got = P.suffix_stage(spark, documents(rows), "")
    assert got.columns == COLUMNS
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in got.collect()) == sorted((str(i), t or "", len(t or "")) for i, t in rows)
