"""Connected components of a graph by repeated random contraction, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keysift.sources.staging import Staging


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); nodes of one component share a label.

    In each round every node points to the neighbour, or itself, that comes first in a random order drawn
    anew for the round, and edges are rewritten to what their ends point to.  That about halves the nodes
    of any component that is not yet one node, so the number of rounds grows with the logarithm of its size, whatever
    its shape.  Every round is written to the shared folder; labels are then read off backwards.  The minimum
    is pre-aggregated, and joins meet unique keys on one side, so a node with very many neighbours can be split.
    """
    steps, k = [], 0
    edges = staging.write(edges.select("a", "b").filter("a <> b").distinct(), "edges0")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = F.struct(F.xxhash64("b", F.lit(k)).alias("h"), F.col("b").alias("id"))
        own = F.struct(F.xxhash64("a", F.lit(k)).alias("h"), F.col("a").alias("id"))
        points = staging.write(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(order), F.min(own)).alias("x"))
            .select("node", F.col("x.id").alias("to")), f"points{k}")
        steps.append(points)
        a, b = points.toDF("a", "a2"), points.toDF("b", "b2")
        moved = edges.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        k += 1
        edges = staging.write(moved.filter("a <> b").distinct(), f"edges{k}")
        staging.drop(f"edges{k - 1}")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps.pop().toDF("node", "label")
    for i in range(len(steps) - 1, -1, -1):
        onward = labels.toDF("to", "label")
        labels = staging.write(steps[i].join(onward, "to", "left").select("node", F.coalesce("label", "to").alias("label")),
                               f"labels{i}")
    return labels
