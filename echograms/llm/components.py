"""Connected components of a link table: union-find inside tasks, then large-star and small-star rounds between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograms.llm.runtime import cut

EDGE = "a long, b long"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each component of the task's own links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a > b). Both join a node's links with the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for every node of links (a, b), the smallest node that can be reached from it.

    links: two long columns; order, repeats, self-links and null ends (dropped) do not matter. An empty table gives an empty result.
    Every round is written to the shared folder, so that a lost executor costs one round at most."""
    named = links.toDF("x", "y").where("x is not null and y is not null and x <> y")
    edges = named.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).mapInArrow(_contract, EDGE).where("a > b").distinct()
    edges = cut(edges, "links")
    for _ in range(rounds):
        stars = edges.groupBy("a").agg(F.count("*").alias("n"))
        loose = edges.alias("e").join(edges.select(F.col("a").alias("c")).distinct(), F.col("e.b") == F.col("c"), "left_semi")
        if loose.isEmpty() and stars.where("n > 1").isEmpty():  # every node points at a root, and at one only
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = cut(_star(_star(edges, True), False), "links")
    raise RuntimeError("the links did not settle")
