"""Connected components of a graph of links by union-find inside tasks and contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.storage import materialize


class UnionFind:
    """Disjoint sets of integers whose roots are their smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _forest(links: DataFrame) -> DataFrame:
    """(node, root): each task's own components, a row per node."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets.union(a, b)
        nodes = list(sets.parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(sets.find, nodes), pa.int64())], ["node", "root"])

    return links.select("a", "b").mapInArrow(join, "node long, root long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b); a component is named by its smallest node.

    Each round joins what each task sees, keeps the smallest root of a node, and
    goes on with the links between roots; a round's links are fewer than its
    nodes, and only their number reaches the driver. A task holds the nodes of
    its own partition of links.
    """
    rounds: list[DataFrame] = []
    while True:
        forest = materialize(_forest(links))
        best = materialize(forest.groupBy("node").agg(F.min("root").alias("component")))
        rounds.append(best)
        # The smallest root of each node links to its other roots.
        links = materialize(forest.join(best, "node").where("root <> component").select(F.col("root").alias("a"), F.col("component").alias("b")).distinct())
        if links.isEmpty():
            break
    labels = rounds.pop()
    while rounds:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        labels = rounds.pop().join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return labels
