"""Connected components of a graph given as edges, by rounds of joins that hand on the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, comp) of (a, b): comp is the smallest node reachable. Nodes without edges don't appear.

    known: labels (node, comp) of an earlier call whose edges are among these; they are where the rounds begin. In a round
    every node takes the smallest label of its neighbours and then the label that this label's own node had, so labels
    travel along stars at once and along chains in ever longer leaps. A round is one table; the number of nodes whose
    label changed is all that reaches the driver.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    labels = both.select(F.col("a").alias("node")).distinct()
    if known is None:
        labels = labels.withColumn("comp", F.col("node"))
    else:
        labels = labels.join(known.select(F.col("node").alias("k_node"), F.col("comp").alias("k_comp")), F.col("node") == F.col("k_node"), "left").select("node", F.coalesce("k_comp", "node").alias("comp"))
    labels = materialize(labels.withColumn("changed", F.lit(True)), "component-labels")
    while True:
        named = labels.select(F.col("node").alias("b"), "comp")
        nearest = both.join(named, "b").groupBy(F.col("a").alias("near")).agg(F.min("comp").alias("near_comp"))
        hooked = labels.join(nearest, F.col("node") == F.col("near")).select("node", "comp", F.least("comp", "near_comp").alias("least"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("to_comp"))
        leapt = hooked.join(jump, F.col("least") == F.col("to"), "left").select("node", "comp", F.least("least", "to_comp").alias("new"))
        labels = materialize(leapt.select("node", F.col("new").alias("comp"), (F.col("new") < F.col("comp")).alias("changed")), "component-labels")
        if not labels.where("changed").head(1):
            return labels.select("node", "comp")
