"""Links of embeddings against brute force, and the audit of the small-world search where links are few."""

import numpy as np
import pytest

from ledgerlens.llm import hnsw


def test_few_links_of_a_shard_are_found():
    rng = np.random.default_rng(6)
    w, v = rng.normal(size=(600, 24)), rng.normal(size=(1024, 24))
    where = {100: 7, 301: 450, 777: 599}
    for query, node in where.items():
        v[query] = w[node]
    unit = [hnsw._unit(x).astype(np.float32) for x in (w, v)]
    g = hnsw.Graph(unit[0])
    # nodes that the graph doesn't reach
    g.links = [np.full_like(x, -1) for x in g.links]
    a, b = hnsw.Search(g, 0.9).pairs(unit[1])
    assert dict(zip(a.tolist(), b.tolist())) == where


def test_beams_are_widened_until_links_are_found():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    x = hnsw._unit(np.concatenate([c + rng.normal(size=(60, 16)) * 0.1 for c in centres])).astype(np.float32)
    g = hnsw.Graph(x)
    # a graph that has lost most of its links
    g.links[0][rng.random(g.links[0].shape) < 0.6] = -1
    search = hnsw.Search(g, 0.9, 8)
    a, b = search.pairs(x)
    truth = int((x @ x.T >= 0.9).sum())
    assert search.audited is None and len(set(zip(a.tolist(), b.tolist()))) >= 0.97 * truth


def brute(rows, cosine=0.9):
    """[(id, n_links, component)] in the order of the rows."""
    unit = [None if v is None or None in v or not len(v) or not np.isfinite(v).all() or not np.any(v) or i is None else np.array(v, float) / np.linalg.norm(v) for i, v in rows]
    label, links = list(range(len(rows))), [0] * len(rows)
    for i, x in enumerate(unit):
        for j in range(i):
            y = unit[j]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= cosine:
                links[i], links[j] = links[i] + 1, links[j] + 1
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[label[k]] = i if i is None else min(i, least.get(label[k], i))
    return [(i, links[k], least[label[k]]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("kind, shards", [("float", 3), ("double", 5), ("float", None)])
def test_links_and_components_match_brute_force(spark, kind, shards):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + rng.normal(size=(25, 8)) * 0.15 for c in centres] + [np.repeat(centres[:1], 20, 0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    # rows that repeat an id, with their vector or another's, other lengths, and what links with nothing
    rows += [(3, x[3].tolist()), (5, x[90].tolist()), (5, (-x[90]).tolist()), (700, [1.0, 0.0]), (701, [2.0, 0.0]), (702, [1.0]), (703, [-1.0])]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, []), (904, [None] + [1.0] * 7), (None, x[3].tolist()), (None, None)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links string").repartition(3)
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in hnsw.embedding_links(df, shards=shards, first_beam=8).collect()))
    want = sorted((i is None, i or 0, n, c or 0, i is None or c == i) for i, n, c in brute(rows))
    assert got == want


def test_links_of_nothing(spark):
    assert hnsw.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert hnsw.embedding_links(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")).count() == 1


def _lossy(x, share):
    g = hnsw.Graph(x)
    g.links[0][np.random.default_rng(1).random(g.links[0].shape) < share] = -1
    return g


def test_links_of_a_node_to_itself_are_no_evidence():
    rng = np.random.default_rng(8)
    # pairs of copies among vectors that link with nothing: a beam finds a node from itself even where links to its copy are lost
    half = rng.normal(size=(1500, 16))
    x = hnsw._unit(np.concatenate([half, half + rng.normal(size=half.shape) * 0.05])).astype(np.float32)
    search = hnsw.Search(_lossy(x, 0.9), 0.9, 8)
    search.pairs(x, own=True)
    truth = int((np.triu(x @ x.T, 1) >= 0.9).sum())
    assert 0 < search.truth <= truth and search.width > 8


def test_each_querying_shard_is_audited():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16))
    nodes = hnsw._unit(np.concatenate([c + rng.normal(size=(40, 16)) * 0.1 for c in centres] + [rng.normal(size=(400, 16))])).astype(np.float32)
    search = hnsw.Search(_lossy(nodes, 0.6), 0.9, 8)
    # a first shard without any link tells nothing, so beams stay as they are
    far = hnsw._unit(rng.normal(size=(1500, 16))).astype(np.float32)
    far = far[(far @ nodes.T).max(1) < 0.9]
    search.pairs(far)
    assert search.width == 8 and search.truth == 0
    # the next one has many
    near = hnsw._unit(np.concatenate([c + rng.normal(size=(50, 16)) * 0.1 for c in centres])).astype(np.float32)
    a, b = search.pairs(near)
    truth = set(zip(*(v.tolist() for v in np.nonzero(near @ nodes.T >= 0.9 - hnsw.MARGIN))))
    got = set(zip(a.tolist(), b.tolist()))
    assert search.width > 8 and got <= truth and len(got) >= 0.97 * len(truth) and search.found >= hnsw.RECALL * search.truth


def test_nodes_only_pass_through_layers_above_their_own(monkeypatch):
    wide, search = {}, hnsw.Graph.search

    def counted(self, q, width, layer, start):
        if width == hnsw.BUILD_BEAM:
            wide[layer] = wide.get(layer, 0) + len(q)
        return search(self, q, width, layer, start)

    monkeypatch.setattr(hnsw.Graph, "search", counted)
    g = hnsw.Graph(_unit_rows(3000, 5))
    # all but the entry, which is there first
    assert wide == {k: int((g.level >= k).sum()) - 1 for k in range(int(g.level[g.entry]) + 1)}


def test_a_search_that_opens_some_nodes_at_a_time_finds_what_brute_force_does():
    x = _unit_rows(3000, 6)
    g = hnsw.Graph(x)
    r = np.random.default_rng(7)
    q = x[:600] + r.standard_normal((600, x.shape[1])).astype(np.float32) * 0.04
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    a, b = hnsw._block_pairs(g, q, 0.9, hnsw.FIRST_BEAM)
    want = set(zip(*(v.tolist() for v in np.nonzero(q @ x.T >= 0.9))))
    got = set(zip(a.tolist(), b.tolist()))
    assert got <= want | {(i, j) for i, j in got if abs(q[i] @ x[j] - 0.9) < 1e-5} and len(want & got) >= 0.99 * len(want) > 500


def _unit_rows(n, seed):
    x = np.random.default_rng(seed).standard_normal((n, 64)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
