"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def labels(edges: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable, for each of n nodes; edges has two rows of indices."""
    label = np.arange(n)
    a, b = edges
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        before = label.copy()
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def forest(edges: np.ndarray, n: int) -> np.ndarray:
    """At most n - 1 edges with the same components."""
    used, at = np.unique(edges, return_inverse=True)
    label = labels(at.reshape(edges.shape), len(used))
    own = np.flatnonzero(label != np.arange(len(used)))
    return np.stack([used[own], used[label[own]]])


def _solve(batches):
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    t = pa.Table.from_batches(batches)
    edges = np.stack([t.column(0).to_numpy(), t.column(1).to_numpy()])
    used, at = np.unique(edges, return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(used[labels(at.reshape(edges.shape), len(used))])], names=["node", "root"])


def connected_components(edges: DataFrame, local_edges: int = 1_000_000, max_rounds: int = 60) -> DataFrame:
    """(node, root) with the smallest node of each component, for every node of ``edges`` (a, b longs, no nulls).

    Up to ``local_edges`` edges (16 MB) one task solves them. Beyond, large-star and small-star steps alternate until
    nothing changes, each a shuffle of the edges written to the shared folder; a hot node's edges are spread by the
    skew join, as its minimum comes from a map-side combined aggregate and not from a list of its neighbours.
    """
    if edges.limit(local_edges + 1).count() <= local_edges:
        return edges.repartition(1).mapInArrow(_solve, "node long, root long")
    cur = common.materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = common.materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b")
        new = common.materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
        same = new.count() == cur.count() and new.join(cur, ["a", "b"], "left_anti").isEmpty()
        common.release(large, cur)
        cur = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
