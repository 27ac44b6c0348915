"""Connected components of an edge table, distributed, without collecting links or labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.runtime import discard, materialise, ship

#: Nodes of so many links or more are hubs; at most so many of them are broadcast.
HUB, HUBS = 4096, 4096
#: Links that a task contracts at once at least, where it has so many.
CONTRACTED = 1 << 18


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links (u, v) and the smallest nodes that they reach by them; those that reach no smaller one are left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, parent = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        # both ends are roots: the larger one hangs under its smallest neighbour, then every path is shortened to its root
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while ((up := parent[parent]) != parent).any():
            parent = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[below], nodes[parent[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) as stars that connect the same nodes, run by run of a task's links, so that fewer rounds follow."""

    def stars(held: list) -> pa.RecordBatch:
        found = _stars(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CONTRACTED:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def _degrees(pairs: DataFrame) -> DataFrame:
    """Links of every node to smaller (``ups``) and to larger nodes (``downs``); sums are taken before the shuffle."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(pairs.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return materialise(ends.groupBy("x").agg(F.sum("up").alias("ups"), F.sum("down").alias("downs")), "cc-degrees")


def _join(rows: DataFrame, low: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``rows`` with the minimum of their ``u``; rows of hubs stay where they are."""
    if hubs is None:
        return rows.join(low, "u")
    few = low.join(F.broadcast(hubs), "u", "left_semi")  # at most HUBS rows
    return rows.join(F.broadcast(few), "u").unionByName(rows.join(F.broadcast(hubs), "u", "left_anti").join(low, "u"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` with the smallest node it can reach.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each round sends every node
    to the smallest label among its neighbours; the number of rounds grows with the logarithm of the
    component size (``max_rounds`` stands for far more nodes than there can be). Rounds end when all components are stars. Tasks
    contract the links they have before each round, a bounded number at once, which saves most rounds. Minima are
    pre-aggregated before each shuffle and hubs are joined by broadcast, so a hub costs a row per task. Every round is written to the shared folder.

    Self loops label their node. Edges with a null end are ignored; repeated edges count once.
    An empty table gives an empty table. Returns ``node``, ``root`` (both bigint), one row per node.
    """
    ship(edges.sparkSession)
    raw = edges.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    nodes_alone = raw.where("x = y").select(F.col("x").alias("node"))
    links = raw.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    pairs = materialise(links.mapInArrow(_contract, "u bigint, v bigint"), "cc-edges")
    for _ in range(max_rounds):
        degrees = _degrees(pairs)
        state = degrees.agg(F.max("ups").alias("ups"), F.max(F.least("ups", "downs")).alias("between"), F.max(F.col("ups") + F.col("downs")).alias("most")).first()
        if (state["ups"] or 0) <= 1 and not state["between"]:
            break  # every node has one smaller neighbour, which has none
        hubs = None
        if state["most"] >= HUB:
            links = F.col("ups") + F.col("downs")
            hubs = materialise(degrees.where(links >= HUB).orderBy(F.desc(links), "x").limit(HUBS).select(F.col("x").alias("u")), "cc-hubs")
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = _join(both.where("v > u"), low, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = _join(large, large.groupBy("u").agg(F.min("v").alias("m")), hubs)
        small = (
            joined.select("u", F.col("m").alias("v"))
            .unionAll(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        new = materialise(small.mapInArrow(_contract, "u bigint, v bigint"), "cc-round")
        discard(pairs, degrees, *([hubs] if hubs is not None else []))
        pairs = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(degrees)
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))
    alone = nodes_alone.select("node", F.col("node").alias("root"))
    return stars.unionAll(roots).unionAll(alone).groupBy("node").agg(F.min("root").alias("root"))
