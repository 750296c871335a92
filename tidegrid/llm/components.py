"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import discard, materialize


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the edges x-y that are enough to connect what they connect; works on one bounded bucket (Boruvka's algorithm)."""
    if not len(x):
        return x, y
    nodes, ids = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = ids[: len(x)], ids[len(x) :]
    root, chosen = np.arange(len(nodes)), []
    while len(open_ := np.flatnonzero(root[a] != root[b])):
        first = np.full(len(nodes), len(a))  # the first edge that leaves each component
        np.minimum.at(first, root[a[open_]], open_)
        np.minimum.at(first, root[b[open_]], open_)
        took = np.unique(first[first < len(a)])
        chosen.append(took)
        u, v = root[a[took]], root[b[took]]
        hook = np.arange(len(nodes))
        while True:
            low = np.minimum(hook[u], hook[v])
            new = hook.copy()
            np.minimum.at(new, hook[u], low)
            np.minimum.at(new, hook[v], low)
            new = new[new]
            if (new == hook).all():
                break
            hook = new
        root = hook[root]
    own = np.concatenate(chosen) if chosen else np.empty(0, np.int64)
    return x[own], y[own]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of the component.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until nothing changes. Each round's edges are
    written to the shared folder. Every node's neighbours meet through aggregation and a join on the node, never in one list."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "components")
    last = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.filter("u <> v").distinct(), "components")
        discard(before)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == last or not state[0]:
            break
        last = state
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    flat = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return flat.unionByName(flat.select(F.col("root").alias("node"), "root").distinct())
