"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odspark.llm.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b).

    Hooking whole groups and pointer jumping: each label takes the smallest
    label over all edges that leave the nodes having it, and each node takes
    what its label took. A local minimum draws its neighbours in, so rounds grow
    with the logarithm of a path's length (18 for 100,000 nodes). Labels only
    fall, so it ends without a cap. Neighbour and group minima are partial
    aggregates, so a node or group with a third of all edges sends one row per
    task. Labels are written between rounds, so a lost executor costs one round
    at most."""
    e = edges.where("a <> b")
    e = staged(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = staged(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = (e.join(label, F.col("b") == F.col("node"))
                .groupBy("a").agg(F.min("component").alias("m")))
        hook = (label.join(near, F.col("node") == F.col("a"))
                .groupBy(F.col("component").alias("group")).agg(F.min("m").alias("r")))
        step = (label.join(hook, F.col("node") == F.col("group"), "left")
                .select(F.col("node").alias("p"), F.least("component", F.coalesce("r", "component")).alias("to")))
        new = staged(label.join(step, F.col("component") == F.col("p"))
                     .select("node", F.col("component").alias("was"), F.col("to").alias("component")), "labels")
        label = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return label
