"""SimHash near-dedup: fingerprints of word shingles, linked by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import LAST_ID, connected_components, unpack, with_document_key, written

SEED = 42
#: Bits of each byte value, lowest first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Texts whose shingles are counted at a time, and pairs of trie nodes held at a time.
BATCH_BYTES, FRONTIER = 1 << 20, 1 << 18
#: Fingerprints of one block value beyond which the group is dealt again by further bits.
GROUP_LIMIT = 8192


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each shingle of ``words`` words of the lower-cased (A-Z) text, repeats included."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(w) < words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else []
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(words)))), repeat(SEED)))


def fingerprints(texts: list[str], words: int) -> np.ndarray:
    """Unsigned fingerprints: a bit is set if it is set in over half of the text's shingle hashes."""
    return folded([shingle_hashes(t, words) for t in texts])


def folded(each: list[list[int]]) -> np.ndarray:
    """Fingerprints of texts by their shingle hashes."""
    many = len(each)
    sizes = np.array([len(x) for x in each], np.int64)
    owner = np.repeat(np.arange(many) << 8, sizes)
    octets = np.array([h for x in each for h in x], np.uint64).view(np.uint8).reshape(-1, 8)
    out = np.zeros(many, np.uint64)
    for k in range(8):
        seen = np.bincount(owner + octets[:, k], minlength=many << 8).reshape(many, 256)
        over = (2 * (seen @ BITS) > sizes[:, None]).astype(np.uint64)
        out |= (over << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * k)
    return out


def _fingerprint_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, start, size = batch.column("body").to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > BATCH_BYTES or i - start == 255 or i + 1 == len(texts):
                    out.append(fingerprints(texts[start : i + 1], words))
                    start, size = i + 1, 0
            fp = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(fp)], names=["doc", "th", "fp"])

    return run


def trie_pairs(group: np.ndarray, value: np.ndarray, errors: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the same group whose values differ in ``errors`` bits or fewer.

    Rows are sorted by group and value, so a trie node is a range of rows. Pairs of nodes go down
    together, one bit a step; a pair whose prefixes differ in more bits than allowed is pruned.
    A frontier over ``FRONTIER`` pairs is cut in two, so memory is bounded.
    """
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.r_[start[1:], len(group)]
    many = end - start > 1
    zero = np.zeros(many.sum(), np.int64)
    ones = np.zeros(len(value) + 1, np.int64)
    stack = [(bits - 1, start[many], end[many], start[many], end[many], zero)]
    while stack:
        bit, a0, a1, b0, b1, e = stack.pop()
        if not len(a0):
            continue
        if bit < 0:
            same = a0 == b0
            # distinct values: a leaf is one row
            yield a0[~same], b0[~same]
            continue
        if len(a0) > FRONTIER:
            h = len(a0) // 2
            stack += [(bit, *(x[h:] for x in (a0, a1, b0, b1, e))), (bit, *(x[:h] for x in (a0, a1, b0, b1, e)))]
            continue
        np.cumsum((value >> np.uint64(bit)) & np.uint64(1), out=ones[1:])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        self_ = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1)]
        parts.append(tuple(x[~self_] for x in (am, a1, b0, bm, e + 1)))
        joined = [np.concatenate(x) for x in zip(*parts)]
        a0, a1, b0, b1, e = joined
        single = (a0 == b0) & (a1 - a0 == 1)
        live = (a1 > a0) & (b1 > b0) & (e <= errors) & ~single
        stack.append((bit - 1, a0[live], a1[live], b0[live], b1[live], e[live]))


def smallest_labels(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the smallest row that the pairs lead to."""
    label = np.arange(n)
    if not pairs:
        return label
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, jump := label[label]):
            label = jump
        if np.array_equal(before, label):
            break
    return label


def _trie_edges(errors: int):
    """Edges (a, b) of a spanning forest of each group; groups arrive together and sorted."""

    def link(key, fp, doc):
        pairs = list(trie_pairs(key, fp, errors))
        label = smallest_labels(len(fp), pairs)
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(doc[label[at]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("level", "key", "fp", "doc")]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            if not len(new):
                kept = now
                continue
            cut = new[-1]
            group = np.searchsorted(new, np.arange(cut), side="right")
            yield link(group, now[2][:cut].view(np.uint64), now[3][:cut])
            kept = [x[cut:] for x in now]
        if kept is not None and len(kept[0]):
            yield link(np.zeros(len(kept[0]), np.int64), kept[2].view(np.uint64), kept[3])

    return run


def simhash_links(fps: DataFrame, errors: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) that connect what links: ``fps`` has distinct ``fp`` and ``doc``, which stands for it.

    Values within ``errors`` bits agree in at least one of ``errors + 1`` blocks, so each is dealt to
    one group for each block value and each group is a trie self-join. The values of a group beyond
    ``group_limit`` are dealt again by the same rule over the other bits, up to three times; then
    at most 2**19 values (for two errors) can share a group.
    """
    parts = errors + 1
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks, done, todo = [0], None, fps.select("fp", "doc", F.lit(0).alias("k"))
    for depth in range(3):
        # each mask of the level above gains one of `parts` blocks of the bits that it leaves free
        deeper = []
        for mask in masks:
            free = [b for b in range(64) if not mask >> b & 1]
            cuts = [len(free) * i // parts for i in range(parts + 1)]
            deeper.append([mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])])
        choice = F.array(*[F.array(*[F.lit(signed(m)) for m in own]) for own in deeper])
        rows = todo.select("fp", "doc", "k", F.posexplode(F.element_at(choice, F.col("k") + 1)).alias("j", "mask")).select(
            "fp", "doc", (F.col("k") * parts + F.col("j")).alias("k"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")
        ).withColumn("level", F.col("k") + 1000 * depth)
        if depth < 2:
            crowded = rows.groupBy("level", "key").count().where(F.col("count") > group_limit).select("level", "key", F.lit(True).alias("crowded"))
            rows = written(rows.join(crowded, ["level", "key"], "left"), "dealt")
            todo = rows.where("crowded").select("fp", "doc", "k")
            rows = rows.where("crowded is null")
        rows = rows.select("level", "key", "fp", "doc")
        done = rows if done is None else done.unionAll(rows)
        masks = [m for own in deeper for m in own]
    dealt = done.repartition("level", "key").sortWithinPartitions("level", "key", F.expr("fp < 0"), "fp")
    return dealt.mapInArrow(_trie_edges(errors), "a long, b long")


def _grouped(base: DataFrame, words: int, errors: int, group_limit: int) -> DataFrame:
    """(doc, th, fp, component) of each document of ``base`` (doc, th, body); component is the smallest id of its group.

    A node is a fingerprint, numbered in order of the smallest id that has it, so documents that share an id,
    or have none, are one node only if they share their fingerprint.
    """
    fps = written(base.select("doc", "th", "body").mapInArrow(_fingerprint_batches(words), "doc long, th long, fp long"), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("doc").alias("first"))
    nodes = written(first.repartitionByRange("first", "fp").sortWithinPartitions("first", "fp").withColumn("node", F.monotonically_increasing_id()), "distinct")
    components = connected_components(simhash_links(nodes.select("fp", F.col("node").alias("doc")), errors, group_limit))
    names = nodes.select(F.col("node").alias("least"), F.col("first").alias("component"))
    led = nodes.select("fp", "node").join(components.withColumnRenamed("component", "least"), "node", "left").withColumn("least", F.coalesce("least", "node"))
    return fps.join(led.join(names, "least").select("fp", "component"), "fp")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, errors: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The input's rows with ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that links of at most ``errors`` bits lead to. Words are runs
    of anything but blank and 0x09-0x0D, A-Z lower-cased; a text with fewer than ``words`` words is
    one shingle; a null, empty or blank text has the fingerprint zero, which links like any other.
    Rows with a null id take part but name no group: one that has no other row has a null
    ``component_id``. Repeated rows share their result. Columns of the input named like a result keep
    the input's value. An empty table gives an empty table.
    """
    base = with_document_key(df, id_col, text_col)
    found = _grouped(base, words, errors, group_limit).dropDuplicates(["doc", "th"])
    return unpack(base.drop("body").join(found, ["doc", "th"]), df, {}, {"fingerprint": _hexed(), "component_id": F.nullif("component", F.lit(LAST_ID))})


def simhash_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, errors: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """As simhash_groups, but only id, ``fingerprint`` and ``component_id``, so that no text is shuffled."""
    found = _grouped(with_document_key(df, id_col, text_col), words, errors, group_limit)
    return found.select(F.nullif(F.col("doc"), F.lit(LAST_ID)).alias(id_col), _hexed().alias("fingerprint"), F.nullif("component", F.lit(LAST_ID)).alias("component_id"))


def _hexed():
    return F.lpad(F.lower(F.hex("fp")), 16, "0")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_table(documents)
