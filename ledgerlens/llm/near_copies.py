"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, all of them.

Texts with the same set count once. SimHash fingerprints of the sets' texts are linked by the trie join
(``simhash``), and what it links is verified against the whole sets. Fingerprints reach a part of
the links only, so the rest is found by shingles: a set and its near copy share one of the first
n - ceil(0.8 n) + 1 shingles of any order that all texts agree on, so texts meet by these and no pair
is missed. Shingles that a sample finds often come last in the order. Pairs that share too few of
these to reach the similarity with all the rest are dropped; what is left is verified. First every
text is held against its neighbour, the first and the hubs in each meeting; then all pairs that this
left unconnected, each in the first of its meetings that the texts' heads tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import connected_components, discard, with_document_key, written
from ledgerlens.llm.simhash import BATCH_BYTES, folded, shingle_hashes, simhash_links

WORDS = 5
#: The least similarity, as a fraction.
SHARE, OF = 4, 5
#: Rows whose shingles are counted for the order, and the most shingles that come last in it.
SAMPLE_ROWS, COMMON = 20000, 50000
#: Candidate pairs that a task holds at a time.
PAIRS = 1 << 20
#: Texts of a meeting that all others in it are held against first.
HUBS = 2
#: First shingles of a text that go with it to its meetings, so that two texts that meet often are paired once.
HEAD = 8


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes in order; a text without words has one that stands for it."""
    return np.unique(np.array(shingle_hashes(text, words) or [0], np.uint64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's fingerprint, and two hashes of its set."""
    for batch in batches:
        each, out, size = [], [], 0
        texts = batch.column("body").to_pylist()
        for k, t in enumerate(texts):
            hashes = shingle_hashes(t, WORDS)
            own = np.unique(np.array(hashes or [0], np.uint64)).tobytes()
            out.append((xxhash.xxh64_intdigest(own, 0), xxhash.xxh64_intdigest(own, 1)))
            each.append(hashes)
            size += len(t)
            if size > BATCH_BYTES or len(each) == 255 or k + 1 == len(texts):
                at = k + 1 - len(each)
                h = np.array(out, np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(at, len(each)), batch.column("th").slice(at, len(each)), pa.array(folded(each).view(np.int64)), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc", "th", "fp", "h1", "h2"]
                )
                each, out, size = [], [], 0


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in batch.column("body").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], names=["s"])


def _prefixes(common: np.ndarray):
    """(s, n, doc, th): the shingles by which a text meets others, and the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes, many = [], [], []
            for t in batch.column("body").to_pylist():
                s = shingle_set(t)
                at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
                last = common[at] == s if len(common) else np.zeros(len(s), bool)
                k = len(s) - -(-SHARE * len(s) // OF) + 1
                out.append(s[np.argsort(last, kind="stable")[:k]])
                sizes.append(len(s))
                many.append(k)
            if out:
                of = [pa.array(np.repeat(batch.column(c).to_numpy(), many)) for c in ("doc", "th")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int32), many)), *of], names=["s", "n", "doc", "th"])

    return run


def _by_shingle(each):
    """Calls ``each`` with columns of whole meetings; rows come in order of the shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = [c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if cut:
                yield from each(*(x[:cut] for x in now))
            kept = [x[cut:] for x in now]
        if kept is not None and len(kept[0]):
            yield from each(*kept)

    return run


def _shared(s, n, doc, th):
    same = s[1:] == s[:-1]
    keep = np.r_[False, same] | np.r_[same, False]
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (s, n, doc, th)], names=["s", "n", "doc", "th"])


def _pairs(a, b):
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _first_pairs(s, n, node, w, marks):
    """Each text with the one before it in a meeting, with the meeting's first, and with its HUBS: those of whose first shingles the
    largest share is met elsewhere. Of many copies of one text that is the text itself."""
    new = np.r_[True, s[1:] != s[:-1]]
    at = np.flatnonzero(~new)
    start = np.flatnonzero(new)
    head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    a, b = [at - 1, head[at]], [at, at]
    best = np.lexsort((-w / (n - -(-SHARE * n // OF) + 1), head))
    size = np.diff(np.append(start, len(s)))
    for k in range(HUBS):
        has = np.flatnonzero(size > k)
        hub = best[start[has] + k]
        rows = np.repeat(hub, size[has])
        members = np.concatenate([np.arange(lo, lo + m) for lo, m in zip(start[has], size[has])]) if len(has) else np.zeros(0, np.int64)
        a, b = [*a, rows], [*b, members]
    a, b = np.concatenate(a), np.concatenate(b)
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    ok = (SHARE * high <= OF * low) & (node[a] != node[b])
    yield _pairs(node[a[ok]], node[b[ok]])


def _met_before(s, x, y):
    """Which pairs have a shingle before ``s`` in both heads (rows of HEAD shingles): they meet by that one, too."""
    out = np.zeros(len(s), bool)
    for k in range(x.shape[1]):
        out |= (x[:, k] < s) & (y == x[:, k : k + 1]).any(1)
    return out


def _other_pairs(s, n, node, label, w, marks, head):
    """All pairs of a meeting that may be similar and are in different components; rows come in order of size.

    ``marks`` has a bit for each first shingle that is met elsewhere, so a bit that one text has alone stands
    for a shingle that the other lacks: what two texts share among these is bounded without looking at them.
    ``head`` has the least of these shingles. A pair is left to an earlier meeting that both heads tell; the
    first one of all has none before it, so no pair is lost.
    """
    at, k, found, held = np.arange(len(s)), 1, [], 0
    while len(at):
        at = at[at + k < len(s)]
        at = at[(s[at + k] == s[at]) & (SHARE * n[at + k] <= OF * n[at])]
        ok = at[label[at] != label[at + k]]
        x, y = marks[ok], marks[ok + k]
        most = np.minimum(w[ok] - np.bitwise_count(x & ~y), w[ok + k] - np.bitwise_count(y & ~x)) - (-SHARE * n[ok + k].astype(np.int64) // OF) - 1
        ok = ok[most * (SHARE + OF) >= (n[ok].astype(np.int64) + n[ok + k]) * SHARE]
        ok = ok[~_met_before(s[ok], head[ok], head[ok + k])]
        found.append(np.stack([np.minimum(node[ok], node[ok + k]), np.maximum(node[ok], node[ok + k])], 1))
        held, k = held + len(ok), k + 1
        if held > PAIRS or not len(at):
            # texts that share one shingle often share more, also beyond their heads
            both = np.concatenate(found)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.r_[True, (both[1:] != both[:-1]).any(1)]] if len(both) else both
            yield _pairs(both[:, 0], both[:, 1])
            found, held = [], 0


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: dict[int, set] = {}
        ok = []
        for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
            x, y = (sets[k] if k in sets else sets.setdefault(k, set(shingle_set(t).tolist())) for k, t in ((a, ta), (b, tb)))
            both = len(x & y)
            ok.append(OF * both >= SHARE * (len(x) + len(y) - both))
            if len(sets) > 500:
                sets.clear()
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])


def _possible(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) without those that can't be similar. ``firsts`` has each text's set size and shared first shingles.

    Of two sets, let x be the one whose first shingles end earlier in the order: what they share is
    among the first shingles of both, or among the rest of x, which is ceil(0.8 n) - 1 shingles.
    """
    of = lambda k: firsts.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("own").alias(f"own{k}"))
    rest = F.expr(f"({SHARE} * greatest(na, nb) + {OF - 1}) div {OF} - 1")
    most = F.size(F.array_intersect("owna", "ownb")) + rest
    return pairs.join(of("a"), "a").join(of("b"), "b").where(most * (SHARE + OF) >= (F.col("na") + F.col("nb")) * SHARE).select("a", "b")


def _verified_edges(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) of ``sets`` those that are similar. Only the texts that are asked for are moved."""
    pairs = written(pairs.distinct(), "candidates")
    asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    bodies = written(texts.join(asked.join(sets.select("node", "doc", "th"), "node"), ["doc", "th"]).select("node", "body"), "bodies")
    left, right = bodies.select(F.col("node").alias("a"), F.col("body").alias("ta")), bodies.select(F.col("node").alias("b"), F.col("body").alias("tb"))
    out = written(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long").distinct(), "similar")
    discard(pairs, bodies)
    return out


def first_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the rows that links of similar texts join to an earlier row.

    Earlier is the smaller id, for one id the smaller hash of the text; null ids come last. Every
    row takes part, so of repeated rows, and of copies without an id, one stays. Words are those of
    the fingerprints in ``simhash``; a text of fewer than WORDS words is one shingle, and all texts
    without words are alike. An empty table gives an empty table.
    """
    base = with_document_key(df, id_col, text_col)
    signed = written(base.select("doc", "th", "body").mapInArrow(_signatures, "doc long, th long, fp long, h1 long, h2 long"), "signatures")
    # one row a set, numbered in order of its first text; a set that a third of all rows have is one row from each task
    first = signed.groupBy("h1", "h2").agg(F.min(F.struct("doc", "th", "fp")).alias("f")).select("f.doc", "f.th", "f.fp")
    sets = written(first.repartitionByRange("doc", "th").sortWithinPartitions("doc", "th").withColumn("node", F.monotonically_increasing_id()), "sets")
    copies = written(signed.select("doc", "th").distinct().join(sets.select("doc", "th"), ["doc", "th"], "left_anti"), "copies")
    texts = base.select("doc", "th", "body").join(copies, ["doc", "th"], "left_anti")

    # what fingerprints link
    prints = written(sets.groupBy("fp").agg(F.min("node").alias("doc")), "prints")
    same = sets.select("fp", F.col("node").alias("b")).join(prints.withColumnRenamed("doc", "a"), "fp").where("a <> b").select("a", "b")
    linked = simhash_links(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = _verified_edges(linked.unionAll(same), sets, texts)

    # what shingles link besides
    step = max(1, sets.count() // SAMPLE_ROWS)
    sample = texts.where(F.pmod(F.xxhash64("doc", "th"), F.lit(step)) == 0).select("body").mapInArrow(_all_shingles, "s long")
    often = sample.groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).select("s").collect()
    common = np.sort(np.array([r["s"] for r in often], np.int64).view(np.uint64))
    met = lambda rows, each, ddl: rows.repartition("s").sortWithinPartitions(*rows.columns).mapInArrow(_by_shingle(each), ddl)
    rows = texts.mapInArrow(_prefixes(common), "s long, n int, doc long, th long")
    shared = written(met(rows, _shared, "s long, n int, doc long, th long"), "shared")
    meetings = written(shared.join(sets.select("doc", "th", "node"), ["doc", "th"]).select("s", "n", "node"), "meetings")
    discard(shared)
    firsts = written(meetings.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("s").alias("own")), "firsts")
    marks = F.expr("aggregate(own, 0L, (a, s) -> a | shiftleft(1L, cast(pmod(s, 64) as int)))")
    # short heads end with the largest number, which is before none
    head = F.slice(F.concat(F.sort_array("own"), F.array_repeat(F.lit((1 << 63) - 1), HEAD)), 1, HEAD)
    weighed = written(meetings.join(firsts.select("node", F.size("own").alias("w"), marks.alias("marks"), head.alias("head")), "node").select("s", "n", "node", "w", "marks", "head"), "weighed")
    discard(meetings)
    found = _verified_edges(_possible(met(weighed.drop("head"), _first_pairs, "a long, b long").distinct(), firsts), sets, texts)
    edges = written(edges.unionAll(found), "edges")
    label = connected_components(edges)
    labelled = weighed.join(label, "node", "left").select("s", "n", "node", F.coalesce("component", "node").alias("label"), "w", "marks", "head")
    found = _verified_edges(_possible(met(labelled, _other_pairs, "a long, b long").distinct(), firsts), sets, texts)
    edges = written(edges.unionAll(found), "edges")
    discard(weighed, firsts)
    later = connected_components(edges).where("component <> node").select("node").join(sets, "node").select("doc", "th")
    gone = written(copies.unionAll(later), "gone")
    # rows that repeat each other in id and text
    twice = written(signed.groupBy("doc", "th").count().where("count > 1").select("doc", "th"), "twice")
    once = base.select("row", "doc", "th").join(gone.unionAll(twice), ["doc", "th"], "left_anti").select("row")
    again = base.select("row", "doc", "th").join(twice.join(gone, ["doc", "th"], "left_anti"), ["doc", "th"]).groupBy("doc", "th").agg(F.first("row").alias("row")).select("row")
    return once.unionAll(again).select([F.col("row").getField(c).alias(c) for c in df.columns])
