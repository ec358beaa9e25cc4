"""The suffix tree's scores against one that is built from plain dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerlens.llm import suffix_tree_lm as L


def brute(rows, depth):
    """{row: (score, kept contexts)} of (id, text) rows, and the distributions' sums."""
    tokens = [[*(t or "").lower().split(), None] for _, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i, _ in rows]
    c = Counter(w for t, own in zip(tokens, train) if own for w in t)
    total, kinds = sum(c.values()), len(c)
    base = lambda w: (c[w] + 0.1) / (total + 0.1 * (kinds + 1))
    node: dict[tuple, Counter] = defaultdict(Counter)
    for t, own in zip(tokens, train):
        for i, w in enumerate(t):
            for k in range(1, min(depth, i) + 1):
                if own:
                    node[tuple(t[i - k : i])][w] += 1
    kept: dict[tuple, bool] = {}

    def prob(context, w):
        if not context:
            return base(w)
        low = prob(context[1:], w)
        if not held(context):
            return low
        n, seen = node[context], sum(node[context].values())
        return max(n[w] - L.DISCOUNT, 0) / seen + L.DISCOUNT * len(n) / seen * low

    def held(context):
        if context not in kept:
            n, gain = node[context], 0.0
            seen = sum(n.values())
            for w, m in n.items():
                q = 2 ** (-round(-L.STEPS * math.log2(prob(context[1:], w))) / L.STEPS)
                gain += m * math.log(0.5 + 0.5 * (m - 1) / (seen * q))
            kept[context] = seen >= L.LEAST_SEEN and gain >= L.DIVERGENCE
        return kept[context]

    scores = [sum(math.log10(prob(tuple(t[max(0, i - depth) : i]), w)) for i, w in enumerate(t)) for t in tokens]
    sums = [sum(prob(s, w) for w in c) + prob(s, "never seen") for s in list(node)[:300]]
    return scores, sums, sum(kept.values())


def corpus(seed=3):
    r = random.Random(seed)
    phrases = [" ".join(r.choices("abcdefghij", k=k)) for k in (4, 6, 9, 12)]
    rows = [(i, " ".join(r.choice(phrases) if r.random() < 0.4 else r.choice("abcdefghijKLMNOP") for _ in range(r.randrange(1, 40)))) for i in range(150)]
    return rows + [(7, rows[7][1])] * 3 + [(None, "a b c"), (None, "a b c"), (500, None), (501, ""), (502, "  \n"), (503, "unheard of words a b"), (504, "x " * 3000)]


@pytest.mark.parametrize("depth, share, block", [(3, 8, 1 << 22), (2, 8, 3000), (4, 1000, 2000)])
def test_scores_match_brute_force(spark, documents, depth, share, block):
    rows = corpus()
    want, sums, kept = brute(rows, depth)
    assert kept > 20 and all(abs(s - 1) < 1e-9 for s in sums)
    got = L.suffix_tree_scores(documents(rows), depth=depth, hot_share=share, block_bytes=block).collect()
    key = lambda i, s: (-1 if i is None else i, s)
    for (i, s), (j, x) in zip(sorted(key(r.doc_id, r.score) for r in got), sorted(key(i, s) for (i, _), s in zip(rows, want)), strict=True):
        assert i == j and s == pytest.approx(x, rel=1e-5)


def test_other_columns_do_not_matter(spark):
    rows = [(i, "a b c d a b", "x", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens double")
    assert {r.n_tokens for r in L.suffix_tree_scores(df).collect()} == {7}
    assert not spark.catalog.listTables() or all(not t.name.startswith("blocks_") for t in spark.catalog.listTables())
