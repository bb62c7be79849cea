"""Connected components of an edge table without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Rounds of: take the least neighbour as label (an aggregate with map-side combine, so hubs are no
    hot spot), follow the label once more, contract. A star ends after one round, a path of n nodes after
    O(log n). Null ends, loops and repeated edges are ignored; without edges the result is empty.
    """
    edge = scratch.table(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b").distinct(),
        "edges",
    )
    out = edge.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    first = True
    while edge.take(1):
        near = edge.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edge.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        label = near.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("l"))
        label = scratch.table(label, "label")
        jumped = scratch.table(
            label.join(label.select(F.col("u").alias("l"), F.col("l").alias("l2")), "l").select("u", F.col("l2").alias("l")),
            "jumped",
        )
        if first:
            grown = jumped.select(F.col("u").alias("node"), F.col("l").alias("component"))
        else:
            step = jumped.select(F.col("u").alias("component"), "l")
            grown = out.join(step, "component", "left").select("node", F.coalesce("l", "component").alias("component"))
        contracted = (
            edge.join(jumped.select(F.col("u").alias("a"), F.col("l").alias("la")), "a")
            .join(jumped.select(F.col("u").alias("b"), F.col("l").alias("lb")), "b")
            .where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct()
        )
        grown, contracted = scratch.table(grown, "components"), scratch.table(contracted, "edges")
        scratch.drop(label, jumped, edge)
        if not first:
            scratch.drop(out)
        out, edge, first = grown, contracted, False
    return out
