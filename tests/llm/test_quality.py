"""The compiled rules against their evaluation in numpy, and fits on odd tables."""

import math

import numpy as np

from ledgerlens.llm import quality as Q


def rows():
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(60)) + f". Line {i}\nof text") for i in range(150)]
    bad = [(i + 1000, "BUY!! | " * (20 + i % 9)) for i in range(150)]
    return good, bad


def test_column_expression_matches_numpy(spark):
    good, bad = rows()
    odd = [(5000, None), (5001, ""), (None, "Mixed CASE words 123"), (3, "other text of a repeated id"), (5002, "long " * 60_000), (5003, "éß \t\n日")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(7, 1), (None, 1), (9, None), (11, 5)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    assert len(model.rules) > 1
    got = sorted((r.doc_id or -1, r.text or "", r.score, r.predicted) for r in Q.quality_scores(docs, model).collect())

    def score(text):
        stat = Q.text_statistics(text)
        total = model.bias + sum(r.weight for r in model.rules if all((stat[k] > at) == above for k, above, at in r.terms))
        return 1 / (1 + math.exp(-total))

    for (i, text, value, label), (j, other) in zip(got, sorted((i or -1, t or "") for i, t in good + bad + odd), strict=True):
        assert (i, text) == (j, other)
        assert abs(value - score(text)) < 1e-12 and label == int(score(text) >= Q.THRESHOLD)


def test_statistics_by_hand():
    got = dict(zip(Q.FEATURES, Q.text_statistics("Aa aa, aa | 12!\nZ")))
    assert got["log_chars"] == math.log1p(17) and got["log_words"] == math.log1p(6)
    assert (got["upper_share"], got["bar_share"], got["bang_share"], got["digit_share"]) == (2 / 17, 1 / 17, 1 / 17, 2 / 17)
    assert (got["line_share"], got["distinct_share"], got["repeat_share"], got["upper_word_share"]) == (1 / 6, 1.0, 0.0, 1 / 6)
    assert Q.text_statistics("") == [0.0] * len(Q.FEATURES)


def test_the_fit_is_bounded_and_repeatable(spark):
    good, bad = rows()
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    assert Q.train(docs, labels) == Q.train(docs.repartition(5), labels.repartition(3))
    assert Q.train(docs, labels, sample_rows=10).rules == ()
    assert Q.fit_rules(np.zeros((0, len(Q.FEATURES))), np.zeros(0, int)).rules == ()
