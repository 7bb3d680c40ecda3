"""Connected components by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrisk.llm.common import stored

EDGES = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as (node, smallest node of its tree)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    for k in range(0, len(nodes), 10_000):
        some = nodes[k:k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(map(root, some)), pa.int64())], ["a", "b"])


def _hung(edges: DataFrame, both: bool) -> DataFrame:
    """Hangs neighbours on the smallest one around each node.

    The smallest neighbour is found with partial sums; it is stored, so that
    the join has plain exchanges on both sides and AQE can split a hub.
    """
    around = edges
    if both:
        around = around.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(around.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "graph-least")
    joined = around.join(least, "a")
    if both:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(
        least.where("m < a").select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node with an edge.

    edges: a, b (long), in any direction, repeats allowed. Each partition first
    keeps a forest of its edges; then large and small stars alternate until the
    edges are stars, which no further round changes.
    """
    edges = stored(edges.select("a", "b").where("a != b").mapInArrow(_forest, EDGES), "graph-forest")
    before = None
    for _ in range(rounds):
        edges = stored(_hung(edges, True).where("a > b").distinct(), "graph-large")
        edges = stored(_hung(edges, False).distinct(), "graph-small")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
