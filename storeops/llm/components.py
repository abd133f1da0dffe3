"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each partition first reduces its links to a forest by union-find, so that what
is shuffled is bounded by the nodes. The rounds then hook every node to the
smallest one that it knows (Kiveris et al., "Connected Components in MapReduce
and Beyond"). Minima are aggregated before they are shuffled and no list of
neighbours is ever built, so a hub with any number of links is no hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeops.llm.shared import Scratch

EDGES = "a bigint, b bigint"
#: Links that one task holds at once when it reduces them.
BLOCK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for nodes that aren't smallest."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(nodes))], dtype=np.int64)
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > BLOCK:
            a, b = forest(a, b)
            if len(a) > BLOCK // 2:
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
                a, b = a[:0], b[:0]
    if len(a):
        a, b = forest(a, b)
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node can reach, for nodes that reach a smaller one.

    ``links`` has two columns a and b of bigint ids, in any order, with
    repeats; null ids and links of a node with itself are left out. Nodes that
    aren't in the result, with links or without, are components of their own.
    """
    links = links.select(F.col(links.columns[0]).cast("bigint").alias("a"), F.col(links.columns[1]).cast("bigint").alias("b"))
    links = links.filter("a is not null and b is not null and a <> b")
    at = scratch.write(links.mapInArrow(_reduce, EDGES), f"{name}0")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = state(at)
    for k in range(1, rounds):
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        large = scratch.write(large, f"{name}{k}large")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
        at = scratch.write(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}", f"{name}{k}large")
        now = state(at)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return at.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
