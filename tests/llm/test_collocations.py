"""Collocations against plain dictionaries, with numbered words and with words as text."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import collocations as c


def pieces(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, longest=4, least=30, top=2000, cover=80):
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f = Counter(tuple(p[s : s + m]) for x, t in rows if (x or "und") == lang for p in pieces(t) for m in range(1, longest + 1) for s in range(len(p) - m + 1))
        n = sum(v for k, v in f.items() if len(k) == 1)
        often = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        gone = {k[s : s + m] for k, v in often.items() for m in range(2, len(k)) for s in range(len(k) - m + 1) if 100 * v >= cover * f[k[s : s + m]]}
        kept = []
        for k, a in often.items():
            if k not in gone:
                score, cut = min((2000000 * a // (f[k[:j]] + f[k[j:]]), j) for j in range(1, len(k)))
                kept.append((-score, -a, " ".join(k).encode(), f[k[:cut]], f[k[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    words = ["The", "of", "new", "york", "é", "Ünd", "x\x00y", "日本", *[f"w{k}" for k in range(20)]]
    rows = []
    for k in range(n):
        t = ""
        for _ in range(rng.randrange(0, 60)):
            t += rng.choice(["new york times square", "of the", *words]) + rng.choice([" ", " ", "\t", "  ", " ", ". ", ",", "\n", "\r\n", " !?"])
        rows.append((rng.choice(["en", "en", "de", None, "und"]), t))
    return rows + [("en", None), ("fr", None), ("fr", "..."), ("es", "lone words here"), *rows[:20]]


@pytest.mark.parametrize("vocabulary", [10**6, 0])
@pytest.mark.parametrize("longest", [4, 3, 2, 5])
def test_equals_brute_force(spark, vocabulary, longest):
    rows = rows_of(longest)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = c.collocations(df, longest=longest, least=10, top=25, vocabulary=vocabulary).collect()
    want = brute(rows, longest, 10, 25)
    assert sorted(tuple(r) for r in got) == want and len(want) > 20


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(c, "CHUNK", 64)
    rng = random.Random(1)
    texts = ["", "a" * 300, *["".join(rng.choice("ab cé.\n!") for _ in range(rng.randrange(400))) for _ in range(40)], ""]
    got = Counter()
    for data, offsets in c._chunks(pa.array(texts)):
        words, piece = c.split(data, offsets)
        columns = c.lead_columns(np.arange(1, len(words) + 1), piece, 3)
        names = ["", *words.to_pylist()]
        got.update(tuple(names[k] for k in w) for w in zip(*[x.tolist() for x in columns]))
    want = Counter(tuple([*p, "", ""][s : s + 3]) for t in texts for p in pieces(t) for s in range(len(p)))
    assert got == want


def test_nothing_and_other_columns(spark):
    assert c.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    df = spark.createDataFrame([("x y z", 1, "p", 2)] * 40, "`te.xt` string, `la.ng` int, phrase string, n int")
    got = c.collocations(df, lang_col="la.ng", text_col="te.xt").collect()
    assert [tuple(r) for r in got] == [("1", 1, "x y z", 40, 40, 40, 120, 1000000)]


def test_rare_pairs_of_frequent_words_make_no_windows(spark, monkeypatch):
    rng, made, written = random.Random(7), {}, c.written
    texts = [" ".join(rng.choices([f"w{k}" for k in range(40)], k=30)) for _ in range(100)] + ["new york times square"] * 40

    def counted(df, name):
        out = written(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(c, "written", counted)
    rows = [("en", t) for t in texts]
    got = c.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert made["windows"] < 100


@pytest.mark.parametrize("bits", [1, 64, 1000])
def test_a_full_sieve_changes_no_count(spark, monkeypatch, bits):
    monkeypatch.setattr(c, "BITS", bits)
    rows = rows_of(9)
    got = c.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(4), least=10, top=25).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4, 10, 25)


def test_texts_come_in_small_batches_and_the_session_keeps_its_bound(spark, monkeypatch):
    key, seen, written = "spark.sql.execution.arrow.maxBytesPerBatch", {}, c.written
    before = spark.conf.get(key)

    def noted(df, name):
        seen[name] = spark.conf.get(key)
        return written(df, name)

    monkeypatch.setattr(c, "written", noted)
    df = spark.createDataFrame([("en", "x y z")] * 40, "lang string, text string")
    assert c.collocations(df).count() == 1
    assert seen["words"] == seen["windows"] == str(c.BATCH) and seen["phrases"] == spark.conf.get(key) == before
