"""Embedding near-dedup: a hierarchical navigable small-world graph a shard, every shard queried by every vector.

Equal vectors are one node with a multiplicity. A shard's graph is built in waves: a wave's vectors
search the graph that is there, and each other, for their neighbours. A task holds one graph, and the
vectors of half of the other shards, or its own, come to it; of two shards one is the other's host.
Queries run in blocks: the beams of a block go through the graph together. A beam that is full of
links is widened, at the end to the whole shard. Of each shard that queries a graph, its own too,
some queries are held against the whole graph, until enough links are seen or AUDIT_QUERIES are
asked, and keep what that finds; beams for the rest are as wide as it takes to find these links and
those of the shards before. If none of that many queries links, with 95 % confidence at most 0.3 %
of the shard's vectors do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import connected_components, discard, written

COSINE = 0.9
#: Shards at least (also as many as the cluster has cores), and vectors of a shard at most, on average.
SHARDS, SHARD_ROWS = 8, 1 << 18
#: Neighbours of a node (twice as many on the ground layer), beams while building and at first while querying.
DEGREE, BUILD_BEAM, FIRST_BEAM = 12, 48, 48
#: Vectors that join a graph together, and queries of a block; a block's marks of seen nodes take SEEN_BYTES at most.
WAVE, QUERIES, SEEN_BYTES = 256, 512, 1 << 26
#: Bytes of vectors that are multiplied at a time.
PRODUCT_BYTES = 1 << 17
#: A search opens a node at a time for each OPEN places of its beams.
OPEN = 12
#: Links that end the audit of a querying shard, a vector's link to itself not counted, the queries that it asks at most (rounded up to a
#: block), and the share of links that beams have to find.
AUDIT_LINKS, AUDIT_QUERIES, RECALL = 500, 1024, 0.99
#: Float products this far below the threshold are verified too.
MARGIN = 1e-4


def _merge(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's best ``width`` distinct ids, best first; an absent one is -1."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
    sims[ids < 0] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isneginf(sims), -1, ids), sims


def _products(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows ``a`` of x and rows ``b`` of y; as many at a time as a core's cache holds."""
    out, step = np.empty(len(a), np.float32), max(1, PRODUCT_BYTES // (4 * x.shape[1]))
    left, right = np.empty((2, min(step, len(a)), x.shape[1]), np.float32)
    for lo in range(0, len(a), step):
        k = min(step, len(a) - lo)
        np.take(x, a[lo : lo + k], axis=0, out=left[:k], mode="clip")
        np.take(y, b[lo : lo + k], axis=0, out=right[:k], mode="clip")
        out[lo : lo + k] = (left[:k, None] @ right[:k, :, None])[:, 0, 0]
    return out


class Graph:
    """Unit vectors ``x`` (float32), a level for each, and neighbours by layer (-1: none)."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        self.x, n = x, len(x)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(DEGREE)).astype(np.int64), 4)
        self.links = [np.full((n, DEGREE * (1 if k else 2)), -1, np.int32) for k in range(5)]
        self.entry = int(np.argmax(self.level)) if n else -1
        if n:
            first = np.r_[self.entry, np.delete(np.arange(n), self.entry)]
            for at in range(1, n, WAVE):
                self._insert(first[at : at + WAVE], first[:at])

    def search(self, q: np.ndarray, width: int, layer: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beams of ``width`` ids and their products for each query, from the ids in ``start`` (queries, any)."""
        rows = np.arange(len(q))
        ids, sims = _merge(start.astype(np.int32), np.einsum("qkd,qd->qk", self.x[start], q), width)
        pad = width - ids.shape[1]
        if pad > 0:
            ids, sims = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
        seen = np.zeros((len(q), len(self.x) + 1), bool)
        seen[rows[:, None], ids] = True
        # the last column is that of absent nodes
        seen[:, -1] = True
        done = ids < 0
        live = rows
        links = self.links[layer]
        while len(live := live[~done[live].all(1)]):
            # the best nodes that are not opened yet, some at a time: their new neighbours are compared and sorted together
            left, at, to = ~done[live], [], []
            for _ in range(max(1, width // OPEN)):
                pick = np.argmax(left, 1)
                has = np.flatnonzero(left[np.arange(len(live)), pick])
                left[has, pick[has]] = False
                near = links[ids[live[has], pick[has]]]
                r, k = np.nonzero(~seen[live[has, None], near])
                at.append(has[r])
                to.append(near[r, k])
                seen[live[at[-1]], to[-1]] = True
            done[live] = ~left
            at, to = np.concatenate(at), np.concatenate(to)
            found = _products(self.x, to, q, live[at])
            better = found > sims[live[at], -1]
            at, to, found = at[better], to[better], found[better]
            if len(at):
                order = np.argsort(at, kind="stable")
                at, to, found = at[order], to[order], found[order]
                those, first, count = np.unique(at, return_index=True, return_counts=True)
                row, slot = np.repeat(np.arange(len(those)), count), width + np.arange(len(at)) - np.repeat(first, count)
                those = live[those]
                more = ((0, 0), (0, int(count.max())))
                i, s, d = np.pad(ids[those], more, constant_values=-1), np.pad(sims[those], more, constant_values=-np.inf), np.pad(done[those], more, constant_values=True)
                i[row, slot], s[row, slot], d[row, slot] = to, found, False
                order = np.argsort(-s, axis=1)[:, :width]
                ids[those], sims[those], done[those] = (np.take_along_axis(v, order, 1) for v in (i, s, d))
        return np.where(np.isneginf(sims), -1, ids), sims

    def descend(self, q: np.ndarray) -> np.ndarray:
        """For each query the node where its search of the ground layer starts."""
        at = np.full((len(q), 1), self.entry)
        for layer in range(int(self.level[self.entry]), 0, -1):
            at = self.search(q, 4, layer, at)[0][:, :1]
        return at

    def _insert(self, new: np.ndarray, there: np.ndarray) -> None:
        q = self.x[new]
        at = np.full((len(new), 1), self.entry)
        mutual = q @ q.T
        np.fill_diagonal(mutual, -np.inf)
        for layer in range(int(self.level[self.entry]), -1, -1):
            # nodes that are not in this layer only pass through it
            here = self.level[new] >= layer
            own, rest = np.flatnonzero(here), np.flatnonzero(~here)
            ids, sims = self.search(q[own], BUILD_BEAM, layer, at[own])
            then = np.full((len(new), 4), self.entry)
            then[own], then[rest] = ids[:, :4], self.search(q[rest], 4, layer, at[rest])[0]
            at = np.where(then < 0, self.entry, then)
            if not len(own):
                continue
            peers = mutual[np.ix_(own, own)]
            ids = np.concatenate([ids, np.broadcast_to(new[own].astype(np.int32), peers.shape)], 1)
            width = self.links[layer].shape[1]
            ids, sims = _merge(ids, np.concatenate([sims, peers], 1), width * 2)
            keep = self._diverse(ids, sims, width // 2)
            self.links[layer][new[own], : keep.shape[1]] = keep
            self._link_back(new[own], keep, layer)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, count: int) -> np.ndarray:
        """Neighbours nearer to the node than to any neighbour taken before; free places go to the nearest of the rest."""
        x = self.x[ids]
        between = x @ x.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            near = np.where(taken, between[:, k], -np.inf).max(1)
            taken[:, k] = (ids[:, k] >= 0) & (near < sims[:, k]) & (taken.sum(1) < count)
        rank = np.where(taken, 0, 1) * ids.shape[1] + np.arange(ids.shape[1])
        order = np.argsort(np.where(ids >= 0, rank, 10**6), axis=1)[:, :count]
        return np.take_along_axis(ids, order, 1)

    def _link_back(self, new: np.ndarray, keep: np.ndarray, layer: int) -> None:
        links = self.links[layer]
        to, back = keep.ravel(), np.repeat(new, keep.shape[1]).astype(np.int32)
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(nodes), min(int(count.max(initial=0)), 64)), -1, np.int32)
        slot = np.arange(len(to)) - np.repeat(first, count)
        ok = slot < extra.shape[1]
        extra[np.repeat(np.arange(len(nodes)), count)[ok], slot[ok]] = back[ok]
        ids = np.concatenate([links[nodes], extra], 1)
        sims = np.where(ids >= 0, np.einsum("qkd,qd->qk", self.x[ids], self.x[nodes]), -np.inf)
        ids, sims = _merge(ids, sims, links.shape[1] * 2)
        full = (ids >= 0).sum(1) > links.shape[1]
        out = ids[:, : links.shape[1]].copy()
        if full.any():
            out[full] = self._diverse(ids[full], sims[full], links.shape[1])
        links[nodes, : out.shape[1]] = out


class Search:
    """Finds the links of queries in one graph; counts how many of those that brute force finds beams find too."""

    def __init__(self, graph: Graph, cosine: float, first_beam: int = FIRST_BEAM):
        self.graph, self.at, self.width = graph, cosine - MARGIN, first_beam
        self.size = int(max(16, min(QUERIES, SEEN_BYTES // (len(graph.x) + 1))))
        #: Links seen by all audits so far, and those of them that beams have found.
        self.truth, self.found, self.audited = 0, 0, []

    def pairs(self, q: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) candidates with products of at least the cosine less a margin; ``own``: the queries are the graph's nodes.

        Some queries are answered by brute force, and then asked again with beams, which are widened until
        they find RECALL of the links that audits have seen. Beams answer all other queries.
        """
        out, rows = [], np.random.default_rng(0).permutation(len(q))
        audited, seen, asked = [], 0, 0
        while len(rows) and seen < AUDIT_LINKS and asked < AUDIT_QUERIES:
            now, rows = rows[: self.size], rows[self.size :]
            a, b = np.nonzero(q[now] @ self.graph.x.T >= self.at)
            out.append((now[a], b))
            # a node's link to itself is none, and a link between two nodes counts once
            real = now[a] > b if own else np.ones(len(a), bool)
            audited.append((q[now], a[real], b[real]))
            seen, asked = seen + int(real.sum()), asked + len(now)
        if len(rows):
            self._settle([x for x in audited if len(x[1])], seen)
        for lo in range(0, len(rows), self.size):
            now = rows[lo : lo + self.size]
            a, b = _block_pairs(self.graph, q[now], self.at, self.width)
            out.append((now[a], b))
        a, b = (np.concatenate([np.zeros(0, np.int64), *v]) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return a, b

    def _settle(self, linked: list, seen: int) -> None:
        """Widen beams until they find enough of the links of the queries that have been audited now, and of all before.

        Those that narrower beams found before are found by wider ones too.
        """
        n = len(self.graph.x)
        while True:
            found = 0
            for q, a, b in linked:
                x, y = _block_pairs(self.graph, q, self.at, self.width)
                found += int(np.isin(a * n + b, x * n + y).sum())
            if (found >= RECALL * seen and self.found + found >= RECALL * (self.truth + seen)) or self.width * 4 >= n:
                break
            self.width *= 4
        self.truth, self.found, self.audited = self.truth + seen, self.found + found, None


def _block_pairs(graph: Graph, q: np.ndarray, at: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with products of at least ``at`` that beams find. A beam full of them is widened fourfold, up to the whole shard."""
    out, rows, start = [], np.arange(len(q)), None
    while len(rows):
        if beam * 4 >= len(graph.x):
            a, b = np.nonzero(q[rows] @ graph.x.T >= at)
            out.append((rows[a], b))
            break
        start = graph.descend(q) if start is None else start
        ids, sims = graph.search(q[rows], beam, 0, start[rows])
        full = sims[:, -1] >= at
        a, k = np.nonzero((sims >= at) & ~full[:, None])
        out.append((rows[a], ids[a, k].astype(np.int64)))
        rows, beam = rows[full], beam * 4
    a, b = (np.concatenate(v) for v in zip(*out))
    return a, b


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, jump := label[label]):
            label = jump
        if np.array_equal(before, label):
            return label
    return label


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes; a vector that links with nothing has none."""
    for batch in batches:
        column = batch.column("v")
        kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
        out = []
        for v in column:
            x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind)
            out.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "v"])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


GRAPHS_DDL = "shard long, size long, v binary, id binary, many binary, level binary, entry long, links array<binary>"
GRAPHS = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}[t]) for n, t in (f.split() for f in GRAPHS_DDL.split(", "))])


def _build_batches(kind):
    """A row for each shard and length of vectors, with its graph; rows come in order of these two."""

    def built(shard: int, size: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        v = b"".join(x for p in parts for x in p.column("v").to_pylist())
        ids, many = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("id", "many"))
        g = Graph(_unit(np.frombuffer(v, kind).reshape(len(ids), -1)).astype(np.float32))
        row = {"shard": shard, "size": size, "v": v, "id": ids.tobytes(), "many": many.tobytes(), "level": g.level.tobytes(), "entry": g.entry, "links": [x.tobytes() for x in g.links]}
        return pa.RecordBatch.from_pylist([row], schema=GRAPHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in ("shard", "size")], 1)
            cut = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1), len(names)] if len(names) else []
            for lo, hi in zip(cut, cut[1:]):
                now = (int(names[lo, 0]), int(names[lo, 1]))
                if held and now != key:
                    yield built(*key, held)
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield built(*key, held)

    return run


def _load(row: dict, unit: np.ndarray) -> Graph:
    g = Graph(np.zeros((0, unit.shape[1]), np.float32))
    g.x, g.entry, g.level = unit.astype(np.float32), row["entry"], np.frombuffer(row["level"], np.int64)
    g.links = [np.frombuffer(x, np.int32).reshape(len(unit), -1) for x in row["links"]]
    return g


class _Host:
    """A shard's graph in its task, and what links with it."""

    def __init__(self, row: dict, kind, cosine: float, first_beam: int):
        self.key, self.cosine = (row["shard"], row["size"]), cosine
        self.id, self.many = (np.frombuffer(row[k], np.int64) for k in ("id", "many"))
        self.unit = _unit(np.frombuffer(row["v"], kind).reshape(len(self.id), -1))
        self.search = Search(_load(row, self.unit), cosine, first_beam)

    def links(self, ids: np.ndarray, many: np.ndarray, unit: np.ndarray, same: bool) -> pa.RecordBatch:
        """Links of a block of queries, counted on both sides, and edges between what links."""
        w = self.unit
        a, b = self.search.pairs(unit.astype(np.float32), same)
        ok = np.zeros(len(a), bool)
        for lo in range(0, len(a), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            ok[s] = (unit[a[s]] * w[b[s]]).sum(1) >= self.cosine
        a, b = a[ok], b[ok]
        if same:
            # a link within the shard may be found from either end
            low, high = np.minimum(a, b), np.maximum(a, b)
            a, b = low[low != high], high[low != high]
        code = np.sort(a * len(w) + b)
        code = code[np.r_[True, code[1:] != code[:-1]]] if len(code) else code
        a, b = code // len(w), code % len(w)
        q_n, w_n = np.bincount(a, self.many[b], len(ids)).astype(np.int64), np.bincount(b, many[a], len(w)).astype(np.int64)
        # a spanning forest of the links between the two blocks
        label = _components(len(ids) + len(w), a, b if same else b + len(ids))
        every = np.concatenate([ids, self.id])
        at = np.flatnonzero(label != np.arange(len(label)))
        ends = np.concatenate([every, every[at]]), np.concatenate([every, every[label[at]]])
        n = np.concatenate([q_n, w_n, np.zeros(len(at), np.int64)])
        keep = (n > 0) | (ends[0] != ends[1])
        return pa.RecordBatch.from_arrays([pa.array(ends[0][keep]), pa.array(ends[1][keep]), pa.array(n[keep])], names=["a", "b", "n"])


def _query_batches(kind, cosine: float, first_beam: int):
    """What links with each shard: rows come in order of the shard and of the vectors' length, each graph before the blocks that query it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["q_shard"] < 0:
                    host = _Host(row, kind, cosine, first_beam)
                    yield host.links(host.id, host.many, host.unit, True)
                elif host and host.key == (row["shard"], row["size"]):
                    ids, many = (np.frombuffer(row[k], np.int64) for k in ("id", "many"))
                    yield host.links(ids, many, _unit(np.frombuffer(row["v"], kind).reshape(len(ids), -1)), False)

    return run


def _hosts(shard: Column, shards: int) -> Column:
    """The shards that a shard's vectors query: of any two shards one is the other's, and all are hosts of about as many."""
    other = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    return F.filter(other, lambda j: F.when((shard + j) % 2 == 1, j > shard).otherwise(j < shard))


def _one_each(spark: SparkSession, parts: int) -> Column:
    """An array of ``parts`` numbers, one for each partition that they are dealt to by hash."""
    few = spark.range(64 * parts + 1024).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    found = {r["p"]: r["id"] for r in few}
    return F.array(*[F.lit(found.get(p, p)).cast("long") for p in range(parts)])


def embedding_links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shards: int | None = None, first_beam: int = FIRST_BEAM) -> DataFrame:
    """One row a vector: id, ``n_links``, ``component_id`` and ``kept``.

    Links are pairs with a cosine of ``cosine`` or more in double precision. A vector that is null,
    empty, zero or holds null or non-finite components links with nothing; vectors of different
    lengths never link. Rows need an id: those with a null id link with nothing and are kept. Rows
    that repeat an id and a vector count as two vectors. Other columns of the input are dropped. An
    empty table gives an empty table.

    Equal vectors are one node, so a vector that a third of all rows hold costs one node. Shards are
    of even size by hash, as many as there are cores unless memory asks for more, so that the work of
    a core is that of its vectors. A beam full of links widens up to the whole shard (a beam of a
    quarter of it is the whole shard), so nothing is cut off. Pairs are counted and joined to forests
    where they are found; they are never written out.
    """
    spark = df.sparkSession
    kind = np.float32 if df.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    vectors = F.col(f"`{vector_col}`") if kind is np.float32 else F.col(f"`{vector_col}`").cast("array<double>")
    rows = written(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vectors.alias("v")).mapInArrow(_usable, "id long, v binary"), "vectors")
    nodes = rows.where("v is not null and id is not null").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("many"))
    # numbered in order of their ids, which may repeat
    nodes = written(nodes.repartitionByRange("first", "v").sortWithinPartitions("first", "v").withColumn("node", F.monotonically_increasing_id()), "nodes")
    shards = shards or max(SHARDS, spark.sparkContext.defaultParallelism, -(-nodes.count() // SHARD_ROWS))
    place = _one_each(spark, shards)
    to = F.element_at(place, F.col("shard").cast("int") + 1)
    dealt = nodes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), F.octet_length("v").cast("long").alias("size"), "v", F.col("node").alias("id"), "many").withColumn("to", to)
    graphs = written(dealt.repartition(shards, "to").sortWithinPartitions("shard", "size", "id").drop("to").mapInArrow(_build_batches(kind), GRAPHS_DDL), "graphs")
    asked = graphs.select("shard", F.explode(_hosts(F.col("shard"), shards)).alias("host"), "size", "v", "id", "many").select(
        F.col("host").alias("shard"), "size", F.col("shard").alias("q_shard"), "v", "id", "many", *[F.lit(None).cast(t).alias(n) for n, t in (("level", "binary"), ("entry", "long"), ("links", "array<binary>"))]
    )
    both = graphs.select("shard", "size", F.lit(-1).cast("long").alias("q_shard"), "v", "id", "many", "level", "entry", "links").unionAll(asked).withColumn("to", to)
    ordered = both.repartition(shards, "to").sortWithinPartitions("shard", "size", "q_shard").drop("to")
    found = written(ordered.mapInArrow(_query_batches(kind, cosine, first_beam), "a long, b long, n long"), "links")
    discard(graphs)
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    label = connected_components(found.where("a <> b").select("a", "b"))
    # the least node of a component has its least id
    names = nodes.select(F.col("node").alias("component"), F.col("first").alias("component_id"))
    known = nodes.join(counts, "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")).join(names, "component").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"
    )
    # a hot vector has one row on the other side, so Spark can split its rows
    out = rows.where("v is not null and id is not null").join(known, "v").select("id", "n_links", "component_id")
    alone = rows.where("v is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
