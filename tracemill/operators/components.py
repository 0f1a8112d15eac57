"""Connected components by alternating star contractions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import settled

# A round reads and writes its links in partitions of about this many.
LINKS_A_PARTITION = 100_000
# Edges that a task joins to its forest at a time.
FOREST_EDGES = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("_m"))
    return (
        both.join(smallest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("_m"))
    moved = down.join(smallest, "u").filter(F.col("v") != F.col("_m")).select(
        F.col("v").alias("u"), F.col("_m").alias("v")
    )
    return moved.unionByName(smallest.select("u", F.col("_m").alias("v"))).distinct()


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (u, v) with the smallest one connected to it; smallest ones are left out."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def local_forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components as ``edges``: in each partition no more than it has nodes.

    A task holds its forest and about a million edges at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, more, rows = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        for batch in batches:
            more.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= FOREST_EDGES:
                u, v = _stars(np.concatenate([u, *[m[0] for m in more]]), np.concatenate([v, *[m[1] for m in more]]))
                more, rows = [], 0
        if more:
            u, v = _stars(np.concatenate([u, *[m[0] for m in more]]), np.concatenate([v, *[m[1] for m in more]]))
        for lo in range(0, len(u), FOREST_EDGES):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + FOREST_EDGES]) for x in (u, v)], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _partitions(links: int) -> int:
    return max(1, math.ceil(links / LINKS_A_PARTITION))


def connected_components(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, component): ``component`` is the smallest id connected to ``id``.

    ``edges`` is (u, v). Only minima are aggregated, so hubs never gather their
    neighbours in one task; the number of rounds grows with the logarithm of the
    longest path. Who knows that there are at most ``most`` edges says so, and they go to few files.
    """
    links = edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct()
    current = settled(links if most is None else links.coalesce(_partitions(most)))
    state = _state(current)
    while state[0]:
        parts = _partitions(state[0])
        current = settled(_small_star(_large_star(current.coalesce(parts))).coalesce(parts))
        previous, state = state, _state(current)
        if state == previous:
            break
    roots = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(roots, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
