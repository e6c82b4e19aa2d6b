"""Connected components by hooking and contraction, all of it joins and groupings over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each linked node reaches. ``links`` has columns a and b; loops and nulls are ignored.

    Every round hooks each node to its smallest neighbour where that is smaller, follows these hooks to their ends by
    doubling, and contracts the links to what is left between ends. Links at least halve, and no node's links are gathered.
    """
    edges = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = cut_lineage(both.groupBy("a").agg(F.min("b").alias("up")).filter("up < a"), "hooks")
        while True:
            further = hooks.select(F.col("a").alias("up"), F.col("up").alias("next"))
            jumped = cut_lineage(hooks.join(further, "up", "left").select("a", F.coalesce("next", "up").alias("up"),
                                                                          F.col("next").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("a", "up")
            if jumped.filter("moved").isEmpty():
                break
        root = {c: hooks.select(F.col("a").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b", "component")}
        labels = cut_lineage(labels.join(root["component"], "component", "left").select(
            "node", F.coalesce("component_up", "component").alias("component")), "labels")
        edges = edges.join(root["a"], "a", "left").select(F.coalesce("a_up", "a").alias("a"), "b")
        edges = edges.join(root["b"], "b", "left").select("a", F.coalesce("b_up", "b").alias("b")).filter("a <> b")
        edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
