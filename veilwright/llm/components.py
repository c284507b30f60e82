"""Connected components of an edge table by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Steps from a node to its smallest neighbour that are followed in one round.
JUMPS = 3


def _followed(low: DataFrame) -> DataFrame:
    """(node, up): ``JUMPS`` more steps from each node's ``up``, which is a node of the table itself."""
    out = low
    for k in range(JUMPS):
        step = low.select(F.col("node").alias(f"at{k}"), F.col("up").alias(f"to{k}"))
        out = out.join(step, F.col("up") == F.col(f"at{k}")).select("node", F.col(f"to{k}").alias("up"))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge to another, with the smallest node of its component.

    ``edges`` is read several times, so it should be a written table. Loops and
    repeated edges change nothing; an empty table gives none. In each round a
    node is drawn to its smallest neighbour, and that one's, and so on; edges
    are renamed and what is left within one node goes. The smallest node of a
    component is always drawn to itself, so it gives the name in the end. Names
    should be in no order along the edges (hashes), then a round leaves a
    fraction of the nodes. Minima are combined before the shuffle and then
    joined, so that a node with very many neighbours is never gathered in one
    task.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    out = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")), "lowest")
        up = materialise(_followed(low), "followed")
        if out is None:
            out = up.select("node", F.col("up").alias("component"))
        else:
            step = up.select(F.col("node").alias("at"), "up")
            out = out.join(step, F.col("component") == F.col("at"), "left").select("node", F.coalesce("up", "component").alias("component"))
            out = materialise(out, "components")
        x = up.select(F.col("node").alias("x"), F.col("up").alias("x_up"))
        y = up.select(F.col("node").alias("y"), F.col("up").alias("y_up"))
        now = now.join(x, F.col("a") == F.col("x")).join(y, F.col("b") == F.col("y")).select(F.col("x_up").alias("a"), F.col("y_up").alias("b"))
        now = materialise(now.filter("a <> b").distinct(), "contracted")
        if now.isEmpty():
            return out
