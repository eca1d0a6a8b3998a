"""Connected components over an edge table, by alternating stars.

No edge, node or component ever reaches the driver: it sees one row of two
numbers per round (how many edges there are and the sum of their hashes) and
stops when a round changes neither.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class Forest:
    """Union-find with the smallest node of each tree as its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a < b:
            self.up[b] = a
        elif b < a:
            self.up[a] = b

    def edges(self) -> tuple[list[int], list[int]]:
        """(node, root) for every node that isn't its own root."""
        pairs = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        return [p[0] for p in pairs], [p[1] for p in pairs]


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.join(x, y)
    x, y = forest.edges()
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with at most one edge per node and partition."""
    return edges.mapInArrow(_contract, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of ``edges(a long, b long)``.

    ``root`` is the smallest node of the component, and has a row too.  Each
    round is a large star (every larger neighbour of a node is hung on the
    node's smallest neighbour) and a small star (every smaller neighbour too),
    as in Kiveris et al. 2014; the number of rounds grows with the logarithm of
    the longest path.  Minima are combined before the shuffle, and the joins
    are plain equi-joins, so that the adaptive planner can split a node with
    very many neighbours.  More than ``most_rounds`` rounds (a path of some 2^60
    nodes) end in an error, never in a partial answer.  Self-loops and repeated edges are allowed; an empty
    table gives an empty one.
    """
    common.shipped(edges.sparkSession)
    now = common.written(
        contracted(edges.filter("a is not null and b is not null and a <> b")).distinct(), "cc"
    )
    sign = None
    for _ in range(most_rounds):
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(got) == sign or not got[0]:
            break
        sign = tuple(got)
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        # every b here is below its a: hang the node and its neighbours on the lowest
        small = large.join(least, "a").select(
            F.explode(
                F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
            ).alias("e")
        )
        new = common.written(small.select("e.a", "e.b").filter("a <> b").distinct(), "cc")
        common.dropped(now)
        now = new
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
