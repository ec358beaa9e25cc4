"""Quality scores, language-model scores, line dedup and SimHash against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from ledgerlens.llm import line_dedup, quality, simhash, suffix_tree_lm

TEXTS = [
    (1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, None), (4, ""), (5, "a\nthe very same line here\nb"),
    (6, "x\n THE very same line here \ny"), (7, "alpha beta gamma delta epsilon"), (11, "solo"), (12, "word " * 5000), (None, "no id at all"),
]


def test_line_dedup_keeps_the_first(documents):
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(documents(TEXTS)).collect()}
    assert got[5] == ("a\nthe very same line here\nb", 3, 0)
    assert got[6] == ("x\ny", 3, 1)
    assert got[3] == ("", 1, 0) and got[4] == ("", 1, 0)
    assert got[1][2] == 0 and got[2] == ("", 1, 1)


def test_line_dedup_of_nothing(documents):
    assert line_dedup.line_dedup(documents([])).count() == 0


def _fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fp, errors=2):
    """The smallest id of each row's group; fp has (id, fingerprint) rows."""
    label = list(range(len(fp)))
    for i, (_, x) in enumerate(fp):
        for j in range(i):
            if label[i] != label[j] and bin(x ^ fp[j][1]).count("1") <= errors:
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    ids = {}
    for k, (i, _) in enumerate(fp):
        ids.setdefault(label[k], []).append(i)
    return [min((i for i in ids[k] if i is not None), default=None) for k in label]


@pytest.mark.parametrize("limit", [8192, 2])
def test_simhash_matches_brute_force(documents, limit):
    r = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    base = [" ".join(r.choices(words, k=60)) for _ in range(12)]
    near = [" ".join(w if r.random() > 0.03 else r.choice(words) for w in t.split()) for t in base for _ in range(6)]
    rows = [*TEXTS, (None, "no id at all"), (None, None), (None, base[0]), (None, "quite alone here"), (5, base[1]), (5, base[2]), *((100 + k, t) for k, t in enumerate(base + near))]
    fp = [(i, _fingerprint(t)) for i, t in rows]
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.simhash_table(documents(rows), group_limit=limit).collect())
    assert got == sorted((str(i), f"{x:016x}", str(c)) for (i, x), c in zip(fp, components(fp)))
    assert any(c is not None and c < i for (i, _), c in zip(fp, components(fp)) if i is not None and i >= 112)


def test_simhash_keeps_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", 7), (2, "a b c d", "y", None), (2, "a b c d", "y", None)], "doc_id long, text string, fingerprint string, fp int")
    got = sorted((r.doc_id, r.fingerprint, r.fp or 0, r.component_id) for r in simhash.simhash_groups(df).collect())
    assert got == [(1, "x", 7, 1), (2, "y", 0, 1), (2, "y", 0, 1)]
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_line_dedup_with_clashes_and_repeats(spark):
    rows = [(1, "the same long line\nb", "h"), (1, "the same long line\nb", "h"), (2, "The same long line", None), (3, None, "x"), (None, "the same long line", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    got = sorted((str(r.doc_id), r.text, r.h1 or "", r.n_dropped) for r in line_dedup.line_dedup(df).collect())
    assert got == [("1", "the same long line\nb", "h", 0), ("1", "the same long line\nb", "h", 0), ("2", "", "", 1), ("3", "", "x", 0), ("None", "", "y", 1)]
    three = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.line_dedup(df, min_documents=3).collect())
    assert three == [("1", 0), ("1", 0), ("2", 1), ("3", 0), ("None", 1)]
    assert {r.n_dropped for r in line_dedup.line_dedup(df, min_documents=4).collect()} == {0}


def test_quality_learns_from_others_than_held_out(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(60)) + ".") for i in range(300)]
    bad = [(i + 1000, "BUY!! " * 60) for i in range(300)]
    docs = spark.createDataFrame(good + bad + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (7000, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.rules
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, model).collect()}
    held = [i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["predicted"] == (1 if i < 1000 else 0) for i in held)
    assert 0 <= got[5000]["score"] == got[5001]["score"] <= 1


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", 9.0)], "doc_id long, text string, score double")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    row = quality.quality_scores(docs, model).first()
    assert row["score"] == 9.0 and row["predicted"] == 1


def test_language_model_base_and_sums(documents):
    rows = [(i, " ".join("abc"[(i + k) % 3] for k in range(30)) + (" zz" if i == 4 else "")) for i in range(60)] + [(100, None), (101, "never seen words")]
    got = {r["doc_id"]: r for r in suffix_tree_lm.suffix_tree_scores(documents(rows)).collect()}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in rows}
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10}
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, words in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(words), sum(c[w] > 0 for w in words), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)) < 1e-9
    # the order of the three words is certain, so contexts have to help
    assert all(got[i]["score"] > got[i]["base_score"] + 5 for i in range(60) if i not in train)


def test_language_model_of_nothing(documents):
    assert suffix_tree_lm.suffix_tree_scores(documents([])).count() == 0


