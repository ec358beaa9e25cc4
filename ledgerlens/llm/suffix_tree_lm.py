"""LM scoring: a probabilistic suffix tree over words, grown level by level with shuffled counts.

Texts are tokenised once into blocks. On each level a block asks, for each distinct pair of a context
(a node of the tree, which has a number) and a next word, how often all training texts have it. Asks
of a context meet in one bucket; those of a context that is too common for a bucket are dealt by pair,
and only its sums are put together. A context is kept or not by a divergence test against its suffix;
pairs that are seen often become the contexts of the next level. Blocks get counts and numbers back.
Nothing of the model is held whole: it is as distributed as its counts, and grows with the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, release, shared_dir, written
from ledgerlens.llm.suffix_dedup import utf8

#: Words of the longest context: the memory of the tree. Shorter contexts end where the tests below end them.
DEPTH = 3
#: Bytes of text of a block, and blocks for each bucket of asks.
BLOCK_BYTES, BLOCKS_A_BUCKET = 1 << 22, 4
#: A context is looked at if it is seen so often, and kept if its distribution diverges so much (in nats, over all it is seen with).
LEAST_SEEN, DIVERGENCE = 4, 4.0
#: What is taken off each count of a kept context and given to its suffix's distribution.
DISCOUNT = 0.8
FLOOR = 0.1
#: A context with more than this share of a bucket's tokens is dealt by pair; there are never more than MOST_HOT of these.
HOT_SHARE, MOST_HOT = 8, 1 << 20
#: Steps of a probability, for the divergence test, in powers of two.
STEPS = 8
END = np.uint64(xxhash.xxh64_intdigest(b"\x00end", 1))
M = np.uint64
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
BLOCKS = "block long, id array<long>, n array<long>, train array<boolean>, words binary, tokens binary"
CODED = "block long, id array<long>, n array<long>, train array<boolean>, tokens binary, word binary, seen binary, known array<long>, base array<double>, done array<double>"
STATE = "block long, open binary, context binary, prob binary, done array<double>"
ASKS = "block long, bucket int, context binary, run binary, symbol binary, count binary, prob binary"
ANSWERS = "block long, bucket int, n binary, child binary, total binary, kinds binary, hot binary, sums binary, v long"
SCORES = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers or floats, byte by byte and without the leading bytes that are all zero, compressed."""
    octets = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize)
    width = a.itemsize
    if a.dtype.kind == "u":
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(octets[:, :width].T).tobytes())


def _unpacked(b: bytes, dtype=M) -> np.ndarray:
    width, octets, size = b[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8), np.dtype(dtype).itemsize
    out = np.zeros((len(octets) // width, size), np.uint8)
    out[:, :width] = octets.reshape(width, -1).T
    return out.view(dtype)[:, 0]


def _steps(a: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Differences of numbers that rise from each place in ``start`` on."""
    out = a.copy()
    out[1:] -= a[:-1]
    out[start] = a[start]
    return out


def _summed(d: np.ndarray, start: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The inverse of ``_steps``."""
    c = np.cumsum(d, dtype=M)
    return c - np.repeat(c[start] - d[start], run)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h + M(0x632BE59BD9B4E019)) * M(0x9E3779B97F4A7C15)
    h ^= h >> M(29)
    h *= M(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> M(32))


def _bucket(context: np.ndarray, symbol: np.ndarray | None, buckets: int) -> np.ndarray:
    """Where asks go: by the context, or by the pair if the context's lowest bit says that it is hot."""
    h = _mix(context)
    if symbol is not None:
        h = np.where(context & M(1) == 1, _mix(h ^ _mix(symbol)), h)
    return ((h >> M(20)) % M(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)


def _distinct(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of ``key`` in order, where each comes first, and each place's value's number; all are under ``top``."""
    bits = len(key).bit_length()
    if int(top).bit_length() + bits > 63:
        return np.unique(key, return_index=True, return_inverse=True)
    # the place rides along in the low bits, so that one plain sort does
    v = np.sort(key.astype(np.int64) << bits | np.arange(len(key)))
    at = v & ((1 << bits) - 1)
    v >>= bits
    start = _starts(v)
    new = np.zeros(len(v), np.int64)
    new[start[1:]] = 1
    number = np.empty(len(v), np.int64)
    number[at] = np.cumsum(new)
    return v[start].astype(key.dtype), at[start], number


def _words(data: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts in bytes, the words' places in that list text by text (an end token is one more), and each text's tokens."""
    data, at = LOWER[data[at[0] : at[-1]]], at - at[0]
    blank = BLANK[data]
    cut = np.sort(np.concatenate([at, np.flatnonzero(blank[1:] != blank[:-1]) + 1]))
    cut = cut[_starts(cut)]
    word = cut[:-1][~blank[cut[:-1]]]
    size = np.diff(cut)[~blank[cut[:-1]]]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[~blank].tobytes())]).dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    n = np.diff(np.searchsorted(word, at))
    tokens = np.full(len(word) + len(n), len(names), np.uint32)
    tokens[np.arange(len(word)) + np.repeat(np.arange(len(n)), n)] = coded.indices.to_numpy()
    return names, tokens, n + 1


def _block_batches(block_bytes: int):
    def block(number: int, rows: pa.Table) -> pa.RecordBatch:
        names, tokens, n = _words(*utf8(rows.column("body").combine_chunks()))
        hashes = np.array([xxhash.xxh64_intdigest(w, 0) for w in names], M)
        return _row(
            {"block": [number], "id": [rows.column("id").to_pylist()], "n": [n.tolist()], "train": [rows.column("train").to_pylist()], "words": [np.r_[hashes, END].tobytes()], "tokens": [_packed(tokens)]}, BLOCKS
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            size = np.cumsum(pc.binary_length(held.column("body")).to_numpy().astype(np.int64) + 64)
            at = 0
            while at < held.num_rows and size[-1] - (size[at - 1] if at else 0) > block_bytes:
                upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + block_bytes)) + 1
                made += 1
                yield block(part | made, held.slice(at, upto - at))
                at = upto
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield block(part | made + 1, held)

    return run


def _row(values: dict, ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(t) for k, t in kinds.items()}
    fields = [f.split(" ") for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(values[c], kinds[t]) for c, t in fields], names=[c for c, _ in fields])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one, as each may be some megabytes."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


class _Block:
    """A block's tokens by the numbers of their words."""

    def __init__(self, row: dict, total: int, kinds: int):
        self.n = np.array(row["n"], np.int64)
        self.tokens = _unpacked(row["tokens"], np.uint32)
        self.word, self.seen = _unpacked(row["word"]), _unpacked(row["seen"])
        self.last = np.zeros(len(self.tokens), bool)
        self.last[np.cumsum(self.n) - 1] = True
        self.word_prob = (self.seen + FLOOR) / (total + FLOOR * (kinds + 1))

    def summed(self, values: np.ndarray) -> np.ndarray:
        """The sum of each text's values, one a token."""
        return np.add.reduceat(values, np.cumsum(self.n) - self.n)

    def first_level(self):
        """Places whose word before is seen often enough to be a context, None as that is the context, and the places' probabilities."""
        at = np.flatnonzero((self.seen >= LEAST_SEEN)[self.tokens] & ~self.last) + 1
        return at, None, self.word_prob.astype(np.float32)[self.tokens[at]]

    def level(self, row: dict):
        if row.get("open") is None:
            return self.first_level()
        at = np.flatnonzero(np.unpackbits(np.frombuffer(row["open"], np.uint8), count=len(self.tokens)))
        return at, _unpacked(row["context"]), _unpacked(row["prob"], np.float32)

    def pairs(self, at: np.ndarray, context: np.ndarray | None, buckets: int):
        """Each place's pair, and the pairs' contexts, words and buckets in the order in which they are asked for."""
        # words that training texts lack share a number
        words, _, rank = _distinct(self.word, self.word.max(initial=M(0)))
        if context is None:
            contexts, c = words, rank[self.tokens[at - 1]]
        else:
            contexts, _, c = _distinct(context, context.max(initial=M(0)))
        pair, _, number = _distinct(c * len(words) + rank[self.tokens[at]], len(contexts) * len(words))
        context, symbol = contexts[pair // len(words)], words[pair % len(words)]
        bucket = _bucket(context, symbol, buckets)
        order = np.argsort(bucket, kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        return to[number], context[order], symbol[order], bucket[order].astype(np.int64)


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words = np.frombuffer(row["words"], M)
                train = np.repeat(np.array(row["train"], bool), row["n"])
                count = np.bincount(_unpacked(row["tokens"], np.uint32), train, len(words)).astype(M)
                order = _word_order(words, buckets)
                bucket = _bucket(words[order], None, buckets).astype(np.int64)
                cut = [*_starts(bucket), len(order)]
                out = {c: [] for c in ("block", "bucket", "context", "run", "symbol", "count", "prob")}
                for lo, hi in pairwise(cut):
                    for c, v in zip(out, (row["block"], bucket[lo], b"", b"", words[order][lo:hi].tobytes(), _packed(count[order][lo:hi]), b"")):
                        out[c].append(v)
                yield _row(out, ASKS)

    return run


def _word_order(words: np.ndarray, buckets: int) -> np.ndarray:
    return np.lexsort((words, _bucket(words, None, buckets)))


def _ask(buckets: int, total: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = _Block(row, total, kinds)
                at, context, prob = b.level(row)
                number, context, symbol, bucket = b.pairs(at, context, buckets)
                train = np.repeat(np.array(row["train"], bool), b.n)
                count = np.bincount(number[train[at]], minlength=len(context)).astype(M)
                own = np.empty(len(context), np.float32)
                own[number] = prob
                step = np.clip(np.rint(-STEPS * np.log2(own)), 0, 255).astype(np.uint8)
                out = {c: [] for c in ("block", "bucket", "context", "run", "symbol", "count", "prob")}
                for lo, hi in pairwise([*_starts(bucket), len(bucket)]):
                    own = context[lo:hi]
                    start = _starts(own)
                    run_ = np.diff(np.append(start, hi - lo)).astype(M)
                    values = (row["block"], bucket[lo], _packed(_steps(own[start], np.zeros(1, np.int64))), _packed(run_), _packed(_steps(symbol[lo:hi], start)), _packed(count[lo:hi]), _packed(step[lo:hi]))
                    for c, v in zip(out, values):
                        out[c].append(v)
                yield _row(out, ASKS)

    return run


def _numbered(n: np.ndarray, own: np.ndarray, bucket: int, buckets: int, hot: int) -> np.ndarray:
    """Numbers of this bucket's nodes, different from all other buckets': the lowest bit says whether a node is hot. 0 is none."""
    return ((M(1) + own.astype(M) * M(buckets) + M(bucket)) << M(1)) | (n >= M(hot)).astype(M)


def _answer_words(buckets: int, hot: int):
    """Sums a bucket's counts of words and numbers these, the commonest first."""

    def one(asks: list[dict]) -> pa.RecordBatch:
        symbol = [np.frombuffer(a["symbol"], M) for a in asks]
        sizes = np.cumsum([len(s) for s in symbol])[:-1]
        words, number = np.unique(np.concatenate(symbol), return_inverse=True)
        n = np.bincount(number, np.concatenate([_unpacked(a["count"]) for a in asks]), len(words)).astype(M)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, ~n))] = np.arange(len(words))
        node = np.where(n > 0, _numbered(n, rank, asks[0]["bucket"], buckets, hot), M(0))
        very = n >= M(hot)
        return _answers(asks, [_packed(x) for x in np.split(n[number], sizes)], [_packed(x) for x in np.split(node[number], sizes)], None, (node[very], n[very]), None, int((n > 0).sum()))

    return _by_bucket(one)


def _answers(asks, n, child, contexts, hot, sums, v=0) -> pa.RecordBatch:
    k = len(asks)
    total, kinds = contexts or ([b""] * k, [b""] * k)
    first = lambda x: [None if x is None or not len(x[0]) else b"".join(y.tobytes() for y in x), *[None] * (k - 1)]
    return _row({"block": [a["block"] for a in asks], "bucket": [a["bucket"] for a in asks], "n": n, "child": child, "total": total, "kinds": kinds, "hot": first(hot), "sums": first(sums), "v": [v, *[0] * (k - 1)]}, ANSWERS)


def _answer(buckets: int, hot: int, known):
    """Sums a bucket's counts of pairs, tests its contexts, and numbers the pairs that are contexts themselves.

    ``known`` has the nodes and counts of the hot contexts of this level.
    """

    def one(asks: list[dict]) -> pa.RecordBatch:
        runs = [_unpacked(a["run"]).astype(np.int64) for a in asks]
        context = [_summed(_unpacked(a["context"]), np.zeros(1, np.int64), np.array([len(r)])) for a, r in zip(asks, runs)]
        symbol = np.concatenate([_summed(_unpacked(a["symbol"]), np.cumsum(r) - r, r) for a, r in zip(asks, runs)])
        sizes, parts = np.cumsum([r.sum() for r in runs])[:-1], np.cumsum([len(r) for r in runs])[:-1]
        run_ = np.concatenate(runs)
        context = np.concatenate(context)
        contexts, _, c = _distinct(context, context.max(initial=M(0)))
        top = int(symbol.max(initial=M(0))) + 1
        if top * len(contexts) >> 63:
            symbol = _distinct(symbol, top)[2]
            top = len(symbol)
        pair, first, number = _distinct(np.repeat(c, run_) * top + symbol.astype(np.int64), top * len(contexts))
        n = np.bincount(number, np.concatenate([_unpacked(a["count"]) for a in asks]), len(pair)).astype(M)
        owner = pair // top
        total, kinds = np.bincount(owner, n, len(contexts)), np.bincount(owner, n > 0, len(contexts))
        is_hot = contexts & M(1) == 1
        if is_hot.any():
            node, count = known.value
            total[is_hot] = count[np.searchsorted(node, contexts[is_hot])]
        prob = np.exp2(-np.concatenate([_unpacked(a["prob"], np.uint8) for a in asks])[first].astype(float) / STEPS)
        gain = np.bincount(owner, _gain(n.astype(float), total[owner], prob), len(contexts))
        kept = (gain >= DIVERGENCE) & (total >= LEAST_SEEN) & ~is_hot
        often = n >= M(LEAST_SEEN)
        child = np.zeros(len(pair), M)
        child[often] = _numbered(n[often], np.arange(often.sum()), asks[0]["bucket"], buckets, hot)
        very = n >= M(hot)
        back = [c[lo:hi] for lo, hi in pairwise([0, *parts, len(c)])]
        told = [np.where(kept, x, 0).astype(M) for x in (total, kinds)]
        mine = [number[lo:hi] for lo, hi in pairwise([0, *sizes, len(number)])]
        return _answers(
            asks, [_packed(n[k]) for k in mine], [_packed(child[k[often[k]]]) for k in mine],
            tuple([_packed(x[k]) for k in back] for x in told), (child[very], n[very]),
            (contexts[is_hot], kinds[is_hot].astype(M), gain[is_hot]),
        )

    return _by_bucket(one)


def _gain(n: np.ndarray, total: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """What a pair adds to its context's divergence: of the distribution without the one occurrence, mixed half and half with
    the suffix's, against the suffix's. A word seen once speaks against the context."""
    return np.where(n > 0, n * np.log(0.5 + 0.5 * np.maximum(n - 1, 0) / (np.maximum(total, 1) * prob)), 0.0)


def _by_bucket(one):
    """Calls ``one`` with all asks of a bucket; a partition's asks come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in _rows(batch):
                if held and held[0]["bucket"] != row["bucket"]:
                    yield one(held)
                    held = []
                held.append(row)
        if held:
            yield one(held)

    return run


def _joined(answers: list[dict] | None, field: str) -> np.ndarray:
    return np.concatenate([_unpacked(a[field]) for a in answers]) if answers else np.zeros(0, M)


def _in_order(row: dict) -> list[dict]:
    return sorted(row["answers"] or [], key=lambda a: a["bucket"])


def _code(buckets: int, total: int, kinds: int):
    """Blocks by the numbers of their words, with each text's known tokens, base score, and score of the places that no context speaks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                answers = _in_order(row)
                order = _word_order(np.frombuffer(row["words"], M), buckets)
                word, seen = np.empty(len(order), M), np.empty(len(order), M)
                word[order], seen[order] = _joined(answers, "child"), _joined(answers, "n")
                row |= {"word": _packed(word), "seen": _packed(seen)}
                b = _Block(row, total, kinds)
                log = np.log10(b.word_prob)[b.tokens]
                done = log.copy()
                done[b.first_level()[0]] = 0
                known = b.summed((b.seen > 0).astype(np.int64)[b.tokens])
                row |= {"known": known.tolist(), "base": b.summed(log).tolist(), "done": b.summed(done).tolist()}
                yield _row({c: [v] for c, v in row.items()}, CODED)

    return run


def _take(buckets: int, total: int, kinds: int, hot, last: bool):
    """The places that a longer context is asked for, their contexts and probabilities so far; at the ``last`` level the scores.

    ``hot`` has the nodes, counts and kinds of the hot contexts that are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = _Block(row, total, kinds)
                answers = _in_order(row)
                at, context, prob = b.level(row)
                number, asked, _, bucket = b.pairs(at, context, buckets)
                n = _joined(answers, "n")
                often = n >= M(LEAST_SEEN)
                child = np.zeros(len(n), M)
                child[often] = _joined(answers, "child")
                # a context has a number a run of its pairs
                new = np.ones(len(asked), bool)
                new[1:] = (asked[1:] != asked[:-1]) | (bucket[1:] != bucket[:-1])
                which = np.cumsum(new) - 1
                seen, types = (_joined(answers, c)[which].astype(float) for c in ("total", "kinds"))
                node, count, many = hot.value
                if len(node):
                    k = np.minimum(np.searchsorted(node, asked), len(node) - 1)
                    own = node[k] == asked
                    seen[own], types[own] = count[k[own]], many[k[own]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    part, rest = np.maximum(n.astype(float) - DISCOUNT, 0) / seen, DISCOUNT * types / seen
                told = seen > 0
                prob = np.where(told[number], part[number] + rest[number] * prob, prob).astype(np.float32)
                go = often[number] & ~b.last[at] & (not last)
                open_ = np.zeros(len(b.tokens), bool)
                open_[at[go] + 1] = True
                ended = ~open_[at]
                log = np.zeros(len(b.tokens))
                log[at[ended]] = np.log10(prob[ended])
                done = np.array(row["done"]) + b.summed(log)
                if last:
                    yield _row({"id": row["id"], "train": row["train"], "n_tokens": row["n"], "n_known": row["known"], "base_score": row["base"], "score": done}, SCORES)
                    continue
                whole = np.zeros(len(b.tokens), np.float32)
                whole[at] = prob
                yield _row({"block": [row["block"]], "open": [np.packbits(open_).tobytes()], "context": [_packed(child[number[go]])], "prob": [_packed(whole[open_])], "done": [done.tolist()]}, STATE)

    return run


class _Bucketed:
    """A table of blocks by the hash of their number, so that answers come to them and they stay in place."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{self.name}"
        df.write.bucketBy(buckets, "block").sortBy("block").option("compression", "none").option("path", path).saveAsTable(self.name)
        release(self.spark)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        discard(self.df)
        self.spark.sql(f"DROP TABLE {self.name}")


def _hot_nodes(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hot nodes and their counts, at most MOST_HOT."""
    found = [np.frombuffer(r["hot"], M).reshape(2, -1) for r in answers.where("hot is not null").select("hot").collect()]
    node, count = np.concatenate(found, 1) if found else np.zeros((2, 0), M)
    order = np.argsort(node)
    return node[order], count[order]


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            got = np.frombuffer(row["sums"], np.int64).reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array(got[2].view(np.float64))], names=["node", "kinds", "gain"])


def _hot_sums(answers: DataFrame, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the hot contexts of a level those that are kept, with their counts and kinds."""
    if not len(node):
        return node, count, count
    rows = answers.where("sums is not null").select("sums").mapInArrow(_sum_rows, "node long, kinds long, gain double")
    kept = rows.groupBy("node").agg(F.sum("kinds").alias("kinds"), F.sum("gain").alias("gain")).where(F.col("gain") >= DIVERGENCE).toPandas().sort_values("node")
    own = kept["node"].to_numpy(np.int64).view(M)
    return own, count[np.searchsorted(node, own)], kept["kinds"].to_numpy(np.int64)


def suffix_tree_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, hot_share: int = HOT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Words are runs of anything but blank and 0x09-0x0D, A-Z lower-cased; each text has an end token
    besides. A null text is empty: its end token is scored. The model learns from documents whose
    CRC-32 of the id, modulo 10, is not 0 (a null id counts as an empty text) and scores all. Each
    row is a document of its own, so repeated rows count each. With no training texts all tokens are
    unknown. An empty table gives an empty table. Columns besides the two are not looked at.

    A token's probability is that of the longest kept context before it, of ``depth`` words at most. In
    a kept context each count is DISCOUNT less and what is taken off goes to the suffix's
    distribution; one that is not kept has its suffix's. With one symbol for all unknown words, all
    distributions sum to one.
    """
    spark = df.sparkSession
    train = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"), train.alias("train"))
    raw = written(texts.mapInArrow(_block_batches(block_bytes), BLOCKS), "blocks")
    learned = F.aggregate(F.arrays_zip("n", "train"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["train"], x["n"]).otherwise(0))
    size = raw.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(learned), F.lit(0)).alias("total")).first()
    buckets, total = max(12, size["blocks"] // BLOCKS_A_BUCKET), size["total"]
    # a context below this takes a small part of a bucket
    hot = max(LEAST_SEEN, total // (hot_share * buckets), total // MOST_HOT)
    blocks = _Bucketed(raw.repartition(buckets, "block"), buckets)
    discard(raw)

    def asked(rows: DataFrame, ask, answer) -> DataFrame:
        asks = rows.mapInArrow(ask, ASKS)
        return written(asks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, ANSWERS), "answers")

    def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
        back = answers.select("block", F.struct("bucket", "n", "child", "total", "kinds").alias("a")).repartition(buckets, "block")
        return rows.join(back.groupBy("block").agg(F.collect_list("a").alias("answers")).hint("merge"), "block", "left")

    answers = asked(blocks.df, _ask_words(buckets), _answer_words(buckets, hot))
    kinds = answers.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
    node, count = _hot_nodes(answers)
    coded = _Bucketed(with_answers(blocks.df, answers).mapInArrow(_code(buckets, total, kinds), CODED), buckets)
    blocks.drop()
    state = None
    for level in range(1, depth + 1):
        discard(answers)
        rows = coded.df if state is None else coded.df.drop("done").join(state.df.hint("merge"), "block")
        answers = asked(rows, _ask(buckets, total, kinds), _answer(buckets, hot, spark.sparkContext.broadcast((node, count))))
        kept = spark.sparkContext.broadcast(_hot_sums(answers, node, count))
        node, count = _hot_nodes(answers)
        taken = with_answers(rows, answers).mapInArrow(_take(buckets, total, kinds, kept, level == depth), SCORES if level == depth else STATE)
        if level == depth:
            out = written(taken, "scores")
        else:
            before, state = state, _Bucketed(taken, buckets)
            if before:
                before.drop()
    discard(answers)
    for table in (coded, state):
        if table:
            table.drop()
    return out.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
