"""Connected components of a graph given by its edges, with the smallest node of each as its name.

Union-find runs within each partition first, which leaves a forest of at most one
edge a node and task. Then large-star and small-star rounds (each node's
neighbours are linked to the smallest of them) go on until every edge leads
straight to the smallest node of its component; each round's edges are written to
the shared folder, so lineage stays short and a lost executor loses nothing. Hubs
are only ever grouped by a minimum, which is combined before the shuffle, and
joined by `spread_join`, so a hub's edges aren't one task's work.

Defined results: an edge from a node to itself and an edge with a null end are
left out; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import spread_join, written


class Forest:
    """Union-find over values of one ordered type whose roots are the smallest of their trees."""

    def __init__(self) -> None:
        self.above: dict = {}

    def root(self, x):
        above, path = self.above, []
        while (y := above.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            above[p] = x
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.above[b] = a
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, kind = Forest(), None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = list(forest.above)
    for i in range(0, len(nodes), 100_000):
        some = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array(list(map(forest.root, some)), kind)], ["a", "b"])


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """`node`, `component` for every node of `edges` (columns a, b: both long or both binary) but each component's smallest."""
    kind = edges.schema["a"].dataType.simpleString()
    now = written(edges.select("a", "b").filter("a <> b").mapInArrow(_forest, f"a {kind}, b {kind}"), name)
    while True:
        both = now.select("a", "b", F.lit(1).alias("_out")).unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("_out")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("_m"), F.count("*").alias("_n"), F.sum("_out").alias("_out"))
        least = written(least, f"{name}-nodes")
        # done if no node has two edges up, or one up and one down
        total, left = least.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count_if((F.col("_out") > 0) & (F.col("_n") > 1))).first()
        if not left:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours
        large = spread_join(both.select("a", "b"), least.select("a", "_m", "_n"), "a", total).filter("b > a and b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        large = written(large, f"{name}-large")
        # small star: a node and its smaller neighbours are linked to the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("_m"), F.count("*").alias("_n"))
        ends = F.explode(F.array(F.col("a"), F.col("b"))).alias("x")
        small = spread_join(large, lowest, "a", total).select(ends, "_m").filter("x <> _m")
        now = written(small.select(F.col("x").alias("a"), F.col("_m").alias("b")).distinct(), name)
