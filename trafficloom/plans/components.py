"""Connected components of an edge table, by alternating star contraction.

Every round is two equi-joins with map-side combined minima; no adjacency list
is ever collected, and the minima of hubs are broadcast, so the rows of a hub with any number of neighbours stay spread.
Once a round leaves no more than SMALL edges, a few megabytes, one task finishes them with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release

#: A node with this many edges, and this share of them, is a hub: at most 2 / HUB_SHARE nodes are.
HUB_EDGES, HUB_SHARE = 1000, 0.005
TRACKED = 4000
#: Edges that one task takes.
SMALL = 100_000


def _with_minima(rows: DataFrame, low: DataFrame, hubs: list) -> DataFrame:
    """rows join low on u; hubs are known beforehand, so theirs is a broadcast of as many rows."""
    if not hubs:
        return rows.join(low, "u")
    hub = F.col("u").isin(hubs)
    return rows.filter(hub).join(F.broadcast(low.filter(hub)), "u").unionByName(rows.filter(~hub).join(low.filter(~hub), "u"))


def _large_star(edges: DataFrame, hubs: list) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _with_minima(both.filter("v > u"), low, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hubs: list) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_minima(edges, low, hubs).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple[tuple, list]:
    """What tells whether the edges changed, and the hubs: no later node of the round has more edges than it has now."""
    top = [F.expr(f"approx_top_k({c}, {int(1 / HUB_SHARE)}, {TRACKED})").alias(c) for c in ("u", "v")]
    found = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), *top).first()
    degree: dict = {}
    for item, n in [*(found.u or []), *(found.v or [])]:
        degree[item] = degree.get(item, 0) + n
    return (found.n, found.x), sorted(k for k, n in degree.items() if n >= max(HUB_EDGES, HUB_SHARE * found.n))


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The component of each node of a small edge table: smaller labels spread along edges, and labels take their own labels."""
    held = [frame for frame in frames if len(frame)]
    if not held:
        return
    edges = pd.concat(held)
    nodes, place = np.unique(np.concatenate([edges.u.to_numpy(), edges.v.to_numpy()]), return_inverse=True)
    u, v = place[:len(edges)], place[len(edges):]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        for end in (label[u], label[v], u, v):
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            yield pd.DataFrame({"node": nodes, "component": nodes[label]})
            return


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    Nodes without any edge are not listed; loops and repeated edges don't
    matter; null ends are ignored. The loop runs until a round changes nothing, or few edges are left.
    """
    a, b = F.col(src), F.col(dst)
    now = materialize(edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen, hubs = _digest(now)
    while seen[0] > SMALL:
        after = materialize(_small_star(_large_star(now, hubs), hubs), "edges")
        found, hubs = _digest(after)
        release(now)
        now = after
        if found == seen:
            break
        seen = found
    if seen[0] <= SMALL:
        kind = dict(now.dtypes)["u"]
        return now.repartition(1).mapInPandas(_finish, f"node {kind}, component {kind}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
