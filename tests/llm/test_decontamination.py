"""Windows of benchmark items in documents against plain Python, by both ways of the join."""

import hashlib
import random
import re

import pytest

from ledgerlens.llm.decontamination import decontaminate, op12_decontamination


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(documents, items, window=10):
    """{row number: (n_words, n_hit, items)}"""
    windows = {}
    for i, t in items:
        w = tokens(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("null" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in documents:
        w, hit, named = tokens(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    named |= own
        out.append((d, len(w), len(hit), tuple(sorted(named))))
    return sorted(out, key=str)


def found(df):
    for r in df.collect():
        assert r.contaminated == (r.n_hit > 0) and len({p for s in r.spans for p in range(s.start, s.end)}) == r.n_hit
        yield r.doc_id, r.n_words, r.n_hit, tuple(r["items"])


@pytest.mark.parametrize("limit", [1 << 26, 0])
@pytest.mark.parametrize("shingle", [5, 2])
def test_equals_brute_force(spark, documents, limit, shingle):
    rng = random.Random(5)
    vocabulary = ["a", "b", "The", "ÀB", "c3", "ünd", "zz", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 4, 9, 10, 11, 14, 30]))) for k in range(30)] + [(3, text(12)), (None, "only here, of seven words it is"), (50, None), (51, " ,. "), (52, "")]
    items += [(60 + k, items[7][1]) for k in range(3)]
    rows = [(k, text(rng.randrange(0, 60)) + "-" + " ".join(items[k % 30][1].split()[: rng.randrange(1, 31)]).upper() + "." + text(5)) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "..."), (None, items[5][1]), (7, rows[7][1]), (7, "other " + items[2][1]), (503, ", ".join(x for _, x in items if x)), (504, "a " * 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(found(decontaminate(documents(rows), bench, shingle=shingle, broadcast_bytes=limit)), key=str) == brute(rows, items)


def test_nothing_and_other_columns(spark, documents):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(documents([]), bench).collect() == []
    assert list(found(decontaminate(documents([(1, "one two three"), (2, None)]), none))) == [(1, 3, 0, ()), (2, 0, 0, ())]
    odd = spark.createDataFrame([(1, "x one two three", "w", 5, "h")], "`doc.id` long, `te.xt` string, words string, n_hit int, h string")
    r = decontaminate(odd, bench, id_col="doc.id", text_col="te.xt").first()
    assert (r["n_hit"], r["words"], r["h"], r["n_words"], r["items"]) == (5, "w", "h", 4, ["1"])


def test_one_passage_in_a_third_of_all(spark, documents):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, (passage if k % 3 == 0 else "") + f" own{k} words") for k in range(600)]
    items = [(k, f"{passage} q{k}") for k in range(200)]
    out = list(found(decontaminate(documents(rows), spark.createDataFrame(items, "item_id long, text string"))))
    assert all((n_hit, len(named)) == ((40, 200) if d % 3 == 0 else (0, 0)) for d, _, n_hit, named in out) and len(out) == 600


def test_query(spark):
    r = {x.doc_id: x for x in op12_decontamination(spark, "/root/testdata/sf0.001").collect()}
    assert len(r) == 200
    clean = next(x for x in r.values() if not x.contaminated)
    assert clean.items_sha256 == hashlib.sha256(b"").hexdigest() and clean.n_items == 0
