"""Connected components of a distributed edge list, by large-star and small-star steps with local contraction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Edges that a task contracts at once.
HELD = 500_000


def forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(smallest node of the component, node) for each other node of the graph of these pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(r, x) for x in parent if (r := root(x)) != x]


def edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=_EDGES)


def contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges become a star forest: never more rows than nodes, whatever a node's degree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            if len(held) > 2 * HELD:
                held = forest(held)
                if len(held) > HELD:
                    yield edge_batch(held)
                    held = []
        if held:
            yield edge_batch(forest(held))

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def shrunk(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Edges in shared storage, contracted by tasks of at most about HELD edges each, each of several stored partitions;
    and whether one task had them all, so that what it gives are the components."""
    stored = written(edges.filter("a <> b"), "edges")
    tasks = max(1, -(-stored.count() // HELD))
    out = written(contract(stored.coalesce(tasks)), "links")
    discard(stored)
    return out, tasks == 1


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node it knows."""
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("n"), F.col("a").alias("v")))
    least = both.groupBy("n").agg(F.least(F.min("v"), F.first("n")).alias("m"))
    return both.filter("v > n").join(least, "n").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them.  Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return edges.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))


def is_stars(edges: DataFrame) -> bool:
    """Whether each node is either a centre or the leaf of one edge; then the stars are the components."""
    roles = edges.select(F.col("a").alias("n"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")).union(edges.select("b", F.lit(0), F.lit(1)))
    return roles.groupBy("n").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf")).filter("leaf > 1 or leaf = 1 and centre = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a: smallest node of the component, b: node), for every node that isn't the smallest of its own.

    edges has columns a and b (long).  Loops, repeated edges and either direction are allowed; an empty list gives
    an empty result.  Each round is a large-star, a small-star and a contraction of bounded parts, written to shared
    storage; minima come together per task first, and a hub's edges are an equi-join side that Spark can split.
    """
    now, done = shrunk(edges)
    while not done and not is_stars(now):
        before, (now, done) = now, shrunk(_small_star(_large_star(now)))
        discard(before)
    return now
