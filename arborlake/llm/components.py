"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): every node of an edge with the smallest node that it is connected to.

    Each round gives every node the smallest of itself and its neighbours and draws the edges between those;
    a node that many edges share is combined before the shuffle. It ends when no edge is left.
    """
    rest = materialize(edges.filter("a <> b").select("a", "b").distinct(), "component-edges")
    labels: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "component-least")
        if labels is None:
            labels = least.select(F.col("a").alias("node"), F.col("least").alias("component"))
        else:
            step = least.select(F.col("a").alias("component"), "least")
            labels = materialize(
                labels.join(step, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "component-labels"
            )
        left, right = least.select("a", F.col("least").alias("x")), least.select(F.col("a").alias("b"), F.col("least").alias("y"))
        # one join at a time, each between written tables
        half = materialize(rest.join(left, "a").select("b", "x"), "component-half")
        drawn = half.join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        rest = materialize(drawn.filter("a <> b").distinct(), "component-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return labels
