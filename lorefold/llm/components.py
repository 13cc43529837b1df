"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges that one task contracts.
CONTRACT = 500_000


def spanning_stars(pairs) -> dict[int, int]:
    """Union-find over (a, b) pairs: each node that isn't the smallest of its component, and that smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent if root(x) != x}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one partition by stars that span the same components; memory is bounded by the partition."""
    pairs = (p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    stars = spanning_stars(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(stars.keys(), pa.int64()), pa.array(stars.values(), pa.int64())], names=["a", "b"])


def _contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges with those of each CONTRACT rows replaced by stars; and whether one task saw them all."""
    e = materialise(edges.distinct(), "edges")
    parts = max(1, -(-e.count() // CONTRACT))
    return materialise(e.coalesce(parts).mapInArrow(_contract, "a long, b long").distinct(), "edges"), parts == 1


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the edges (a long, b long): one row (node, component) for each node of an edge between two nodes; the component is its smallest node.

    Tasks replace CONTRACT edges at a time by stars that span the same components. What one task has seen whole is done. Otherwise rounds follow: each
    hangs the larger neighbours of a node, then its smaller ones, on the smallest it knows (the alternating star method), and contracts again, which
    takes a number of rounds that grows as the logarithm of the longest path. Only a few numbers a round reach the driver. Edges with a null end
    and loops are left out, repeated edges count once; without edges the result is empty.
    """
    e, done = _contracted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    seen = None
    while not done:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b")
        e, done = _contracted(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
