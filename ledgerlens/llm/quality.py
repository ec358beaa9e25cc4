"""Quality classifier: a sparse rule ensemble over text statistics, scored by Spark column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most, taken in order of a hash of the id.
SAMPLE_ROWS = 20000
TREES, DEPTH, BINS, LEAST_ROWS, RATE, SHARE = 40, 3, 48, 15, 0.3, 0.5
#: Weight of the lasso penalty in the mean log loss, and steps of the fit.
PENALTY, STEPS = 0.0008, 600
THRESHOLD = 0.3
SYMBOLS = b"!#$%&*@^~<>{}[]\\_=+|/"
FEATURES = [
    "log_chars", "log_words", "mean_word", "upper_share", "symbol_share", "bar_share", "bang_share", "stop_share",
    "digit_share", "line_share", "distinct_share", "repeat_share", "upper_word_share", "letter_share",
]
#: Which byte values each share counts.
KINDS = np.stack([
    np.isin(np.arange(256), list(octets))
    for octets in (bytes(range(65, 91)), SYMBOLS, b"|", b"!", b".,;:?", b"0123456789", b"\n", bytes([*range(65, 91), *range(97, 123), *range(192, 256)]))
], 1).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is above, threshold), and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, feature: dict[str, Column]) -> Column:
        """The probability of label 1 as a column expression."""
        total = F.lit(self.bias)
        for rule in self.rules:
            held = F.lit(True)
            for k, above, at in rule.terms:
                held = held & (feature[FEATURES[k]] > at if above else feature[FEATURES[k]] <= at)
            total = total + F.when(held, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def text_statistics(text: str) -> list[float]:
    """The values of FEATURES; all zero for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    chars, words = len(text), raw.split()
    n, m = max(chars, 1), max(len(words), 1)
    upper, symbol, bar, bang, stop, digit, line, letter = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ KINDS
    return [
        math.log1p(chars), math.log1p(len(words)), chars / m, upper / n, symbol / n, bar / n, bang / n, stop / m, digit / n, line / m,
        len(set(words)) / m, sum(map(eq, words, words[1:])) / m, sum(map(bytes.isupper, words)) / m, letter / n,
    ]


def _statistics(body: pa.Array) -> pa.Array:
    rows = np.array([text_statistics(t or "") for t in body.to_pylist()], float).reshape(-1, len(FEATURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(FEATURES))], FEATURES)


def statistics(df: DataFrame, body: str) -> DataFrame:
    """``df`` with ``_stat``, a struct of the text's statistics; a null or empty text has zeros."""
    return df.withColumn("_stat", F.arrow_udf(_statistics, ", ".join(f"{n} double" for n in FEATURES))(F.col(body).cast("string")))


def _grow(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: tuple, found: list, step: np.ndarray) -> None:
    """One regression tree on binned columns; every node below the root leaves its path in ``found``."""
    best = None
    if depth:
        g, h = grad[rows], hess[rows]
        for k in columns:
            c = codes[rows, k]
            gs, hs, ns = (np.cumsum(np.bincount(c, w, BINS + 1)) for w in (g, h, np.ones(len(c))))
            gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
            gain[(ns < LEAST_ROWS) | (ns[-1] - ns < LEAST_ROWS)] = -1
            at = int(np.argmax(gain))
            if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                best = (gain[at], k, at)
    if best is None:
        step[rows] = grad[rows].sum() / (hess[rows].sum() + 1)
        return
    _, k, at = best
    above = codes[rows, k] > at
    for side in (False, True):
        own = (*path, (int(k), side, at))
        found.append(own)
        _grow(codes, grad, hess, rows[above == side], columns, depth - 1, own, found, step)


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps."""
    n, scale = len(y), np.maximum(np.sqrt(x.mean(0) * (1 - x.mean(0))), 1e-3)
    z = np.c_[np.ones(n), x / scale]
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(z @ v) ** 2 / n * 1.05)
    w = u = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(STEPS):
        new = u - rate * (z.T @ (1 / (1 + np.exp(-(z @ u))) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:] / scale


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleEnsemble:
    """Boosted trees give the rules, a lasso logistic fit their weights. With one label only, a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return RuleEnsemble(bias, ())
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    usable = np.array([k for k, c in enumerate(cuts) if len(c)])
    rng, margin, paths = np.random.default_rng(seed), np.full(len(y), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        columns = rng.permutation(usable)[: max(3, int(len(usable) * SHARE))]
        _grow(codes, y - p, p * (1 - p), np.arange(len(y)), columns, DEPTH, (), paths, step)
        margin = margin + RATE * step
    paths = [p for p in dict.fromkeys(paths) if all(at < len(cuts[k]) for k, _, at in p)]
    held = np.stack([np.logical_and.reduce([(codes[:, k] > at) == above for k, above, at in p]) for p in paths], 1)
    bias, weight = _lasso(held.astype(float), y.astype(float), PENALTY)
    return RuleEnsemble(bias, tuple(Rule(tuple((k, above, float(cuts[k][at])) for k, above, at in paths[i]), float(weight[i])) for i in np.flatnonzero(weight)))


def held_out(doc_id: Column | str) -> Column:
    """True for one document in five, by CRC-32 of its id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on labelled rows that are not held out: at most ``sample_rows`` of them, all that the driver sees.

    The broadcast side of the join is that sample, so its size is bounded by the parameter. Labels other
    than 0 and 1, null labels and null ids are passed over; a document with two labels, and each
    document of a repeated id, counts as often. Without labels the score is a constant.
    """
    sample = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "quality").limit(sample_rows)
    )
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "text").select("doc_id", "quality", "_stat.*")
    got = rows.toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    return fit_rules(got[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), got["quality"].to_numpy(int))


def quality_scores(df: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns with ``score`` and ``predicted`` (columns of these names stay the input's).

    A null or empty text is scored by statistics of zero. Each row is scored by itself, so ids may
    be null or repeat. An empty table gives an empty table.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text_col}`").alias("body"))
    stat = statistics(packed, "body").select("row", "_stat.*")
    scored = stat.select("row", model.score({n: F.col(n) for n in FEATURES}).alias("score"))
    new = {"score": F.col("score"), "predicted": (F.col("score") >= threshold).cast("int")}
    return scored.select(*[F.col("row").getField(c).alias(c) for c in df.columns], *[v.alias(k) for k, v in new.items() if k not in df.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return quality_scores(documents, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
