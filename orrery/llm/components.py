"""Connected components by alternating large-star and small-star steps.

Links inside a partition are first contracted to stars, about a million nodes at a time, so what
is shuffled is at most one edge per node and such a part; the steps then need about log2 of the
longest path left.  Each step's edges are a written table.  A node with many neighbours only has them in a grouped
minimum, which is combined before the shuffle, and in a join that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import lean, saved


class Sets:
    """Disjoint sets of ids; a set's root is its smallest id."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        low, high = min(a, b), max(a, b)
        self.up[high] = low
        self.up.setdefault(low, low)
        return True


#: Nodes that a task holds at a time when it contracts links.
NODES = 1_000_000


def _stars(sets: Sets) -> Iterator[pa.RecordBatch]:
    """Each node that isn't its set's root, and the root."""
    nodes = [x for x in sets.up if sets.root(x) != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        roots = np.array([sets.root(x) for x in part], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(part, np.int64)), pa.array(roots)], ["u", "v"])


def _contract(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in lean(batches):
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets.join(u, v)
            if len(sets.up) > most:
                yield from _stars(sets)
                sets = Sets()
        yield from _stars(sets)

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node in a link (u, v) but each component's smallest.

    Null or self links are ignored; no links give no rows.
    """
    links = links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    edges = saved(links.mapInArrow(_contract(NODES), "u long, v long").distinct(), "edges")  # u > v
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
