"""Connected components of a graph of links, by rounds of joins.

Each round takes every node to the smallest number among its neighbours' labels and then jumps to the label's own label,
so distances shrink fast. Rounds are written to the shared folder, which cuts the lineage; nothing of
the graph reaches the driver but one number per round. A hot node's links are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staytide.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node. NULL ends are left out."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != F.col("y"))
    )
    edges = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = materialize(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        # the smallest label around, told to a node and to the node its label names
        seen = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("low"))
        told = labels.join(seen, labels["node"] == seen["x"]).select("node", "label", "low")
        hooks = told.select(F.col("label").alias("node"), "low").unionByName(told.select("node", F.least("label", "low").alias("low")))
        best = hooks.groupBy("node").agg(F.min("low").alias("low"))
        hooked = labels.join(best, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        hooked = materialize(hooked, "labels")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = materialize(hooked.join(up, "label").select("node", F.least("label", "further").alias("label"), "old"), "labels")
        changed = jumped.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
