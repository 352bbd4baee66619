"""Connected components of a link table by alternating star contraction.

Every round is two groupings and two joins on the link table, written to the shared folder. No
adjacency list is ever gathered: a node only ever learns the minimum of its neighbours, which is a
partially aggregated value, so a hub costs as much as any other node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


def spanning_forest(a: np.ndarray, b: np.ndarray, nodes: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Positions of pairs (a, b) that connect what all of them connect; lighter pairs first."""
    root, kept = np.arange(nodes), []

    def find(x: np.ndarray) -> np.ndarray:
        while not np.array_equal(x, y := root[x]):
            x = y
        return x

    for w in [None] if weight is None else np.unique(weight):
        at = np.arange(len(a)) if w is None else np.flatnonzero(weight == w)
        while len(at):
            ra, rb = find(a[at]), find(b[at])
            new = ra != rb
            at, ra, rb = at[new], ra[new], rb[new]
            high, first = np.unique(np.maximum(ra, rb), return_index=True)
            root[high] = np.minimum(ra, rb)[first]
            kept.append(at[first])
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return ``(node, root)`` for every node that has a link; root is the smallest node reachable.

    Null ends and self links are ignored; repeated links and either direction are fine; an empty
    table gives an empty table.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = materialize(small, "links")
        drop_materialized(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free checksum: the rounds end when both stay as they are."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(row)
