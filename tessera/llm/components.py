"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (src, dst): the label is
    the smallest node of its component.

    Each round hooks every vertex of the contracted graph to its smallest
    neighbour, shortens the pointers twice and contracts again, so the edges
    that are left shrink geometrically; pointers only go to smaller nodes, so
    they form no cycle. Rounds are written to shared storage."""
    edges = materialize(links.select("src", "dst").filter("src <> dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")))
    while not edges.isEmpty():
        both = edges.union(edges.select("dst", "src"))
        hook = both.groupBy("src").agg(F.min("dst").alias("dst")) \
            .select(F.col("src").alias("v"), F.least("src", "dst").alias("p"))
        hook = materialize(hook)
        for _ in range(2):
            up = hook.select(F.col("v").alias("v2"), F.col("p").alias("p2"))
            hook = hook.join(up, hook["p"] == up["v2"], "left").select("v", F.coalesce("p2", "p").alias("p"))
        hook = materialize(hook)
        labels = materialize(labels.join(hook, labels["label"] == hook["v"], "left")
                             .select("node", F.coalesce("p", "label").alias("label")))
        src = hook.select(F.col("v").alias("src"), F.col("p").alias("a"))
        dst = hook.select(F.col("v").alias("dst"), F.col("p").alias("b"))
        edges = materialize(edges.join(src, "src").join(dst, "dst").filter("a <> b")
                            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    return labels
