"""Centroid clustering against Python integers; vectors that don't count; empty and small tables."""

import hashlib
import math

import numpy as np
import pytest

from ledgerlens.llm.centroids import cluster_vectors


def brute(rows, dims, clusters, rounds):
    """{id: (cluster, distance, centroid)}; the centroids and inertia too."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "none", r[1]))
    centres = [q for _, q in order[:clusters]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        centres = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else c for k, c in enumerate(centres)]
    found = [(i, *near(q)) for i, q in kept]
    return sorted((i if i is not None else -1, k, d, centres[k]) for i, d, k in found)


def test_equals_integers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) + 3 * (i % 5)]) for i in range(300)]
    rows += [(i, v) for i, v in rows[:40]] + [(7, [0.5] * 6), (None, [1.0] * 6)]
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 5 + [None]), (904, [float("nan")] + [1.0] * 5), (905, [float("inf")] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(5)
    got = cluster_vectors(df, clusters=7, rounds=4, dimensions=6)
    found = got.collect()
    want = brute(rows + bad, 6, 7, 4)
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.centroid) for r in found) == want
    assert {r.inertia for r in found} == {sum(d for _, _, d, _ in want)}
    for r in found:
        assert r.cluster_inertia == sum(d for _, k, d, _ in want if k == r.cluster)


def test_ties_and_empty_clusters(spark):
    # copies: all seeds are the same vector, so all but centroid 0 stay empty and where they are
    df = spark.createDataFrame([(i, [0.25, -0.25]) for i in range(50)], "vec_id long, embedding array<float>")
    found = cluster_vectors(df, dimensions=2).collect()
    assert len(found) == 50 and {(r.cluster, r.distance, tuple(r.centroid)) for r in found} == {(0, 0, (256, -256))}


def test_nothing_and_other_columns(spark):
    schema = "vec_id long, embedding array<float>, cluster string, q int, n int"
    assert cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    assert cluster_vectors(spark.createDataFrame([(1, None, "x", 1, 1)], schema)).collect() == []
    df = spark.createDataFrame([(1, [0.5] * 64, "mine", 4, 5), (2, [0.25] * 64, None, None, 5)], schema)
    found = {r.vec_id: r for r in cluster_vectors(df).collect()}
    assert found[1].asDict().keys() == {"vec_id", "embedding", "cluster", "q", "n", "distance", "cluster_inertia", "inertia", "centroid"}
    assert (found[1].cluster, found[1].q, found[2].cluster, found[1].distance) == ("mine", 4, None, 0)


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e6, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="or more"):
        cluster_vectors(df, dimensions=2)
