"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import stored


class Sets:
    """Disjoint sets of numbers; the least member names a set."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        """Join two sets; False if they were one already."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one batch as stars: no more of them than nodes."""
    for batch in batches:
        sets = Sets()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
        pairs = [(x, sets.find(x)) for x in list(sets.parent)]
        pairs = [(a, b) for a, b in pairs if a != b]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _larger_to_least(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("n")).where("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = edges.join(least, F.col("a") == F.col("n")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the least node that can be reached, for the nodes that
    have an edge to another one. Ids are whole numbers; edges with a null are left out.

    Two alternating steps move edges towards the least node until the graph is a set of
    stars, in about as many rounds as the logarithm of the longest path. A node with very
    many edges is an aggregate with a map-side step and a join that Spark can split; each
    round is written as a table.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = stored(edges.mapInArrow(_forest, "a long, b long"), "edges")
    while True:
        # Stars: no node has two parents, and none is both child and parent.
        nodes = edges.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
        nodes = nodes.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        if nodes.where("child > 1 or (child > 0 and parent > 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        edges = stored(_smaller_to_least(_larger_to_least(edges)), "edges")
