"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Rounds of contraction: each node is replaced by the neighbour (or itself) that comes first in an order drawn
    anew each round, until no edge joins two different nodes; a chain of any length shrinks by a constant factor
    a round. A node of many edges never meets them in one task: the neighbour is found by an
    aggregate, and the joins have one row for each node on one side, so that Spark can split the other.
    Edges are written after each round, so a lost executor costs one round at most. Ids may be of any type that
    has an order; null ids and loops take no part. No edges: no rows.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    left = materialize(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", rank("a")).alias("near"))
        step = materialize(first.select("node", F.col("near.to").alias("to")), "step")
        # Two hops: a node's new place is the new place of that place.
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        step = materialize(step.join(hop, "to", "left").select("node", F.coalesce("to2", "to").alias("to")), "step")
        steps.append(step)
        for side in ("a", "b"):
            left = left.join(step.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        left = materialize(left.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).limit(0)
    found = steps[-1]
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("to"), F.col("to").alias("later"))
        found = step.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("to"))
    names = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(names, "to").select("node", F.least("component", "to").alias("component"))
