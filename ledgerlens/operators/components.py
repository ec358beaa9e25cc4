"""Connected components by grouped minima and joins, so that no task ever holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.store import discard, written

#: Rounds after which something must be wrong: each at least halves the nodes that are left.
ROUNDS = 64


def _to_roots(parents: DataFrame, keys: list[str]) -> DataFrame:
    """Pointer jumping: (keys, node, root) of (keys, node, root) rows that name a parent each, until every one names a root."""
    for _ in range(ROUNDS):
        up = parents.select(*keys, F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = written(parents.join(up, [*keys, "root"]).select(*keys, "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
        done = jumped.where("moved").limit(1).count() == 0
        discard(parents)
        parents = jumped.drop("moved")
        if done:
            return parents
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root) for every node of ``edges`` (keys, a, b: long); the root is the least node that can be reached.

    Edges join nodes with the same keys. In each round every node points to its least neighbour if that is less than
    itself; pointer jumping leads from there to nodes that are less than all around them, and edges are drawn between
    those. So the nodes at least halve in a round, and a path of any length takes about its logarithm of joins. All
    steps are written, so a lost executor costs one step; tables that are done with are deleted.
    """
    def distinct(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = written(distinct(edges))
    labels = None
    for _ in range(ROUNDS):
        if now.limit(1).count() == 0:
            break
        both = now.unionAll(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _to_roots(written(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))), keys)
        to = lambda c: roots.select(*keys, F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        after = written(distinct(now.join(to("a"), [*keys, "a"]).join(to("b"), [*keys, "b"]).select(*keys, F.col("a_root").alias("a"), F.col("b_root").alias("b"))))
        discard(now)
        now = after
        if labels is None:
            labels = roots
            continue
        further = roots.select(*keys, F.col("node").alias("root"), F.col("root").alias("further"))
        joined = written(labels.join(further, [*keys, "root"], "left").select(*keys, "node", F.coalesce("further", "root").alias("root")))
        discard(labels, roots)
        labels = joined
    else:
        raise RuntimeError("components did not settle")
    return labels if labels is not None else now.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
