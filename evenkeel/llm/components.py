"""Connected components of a table of links, without collecting any of it.

Each round, every node hooks onto its smallest neighbour if that is smaller than itself; the trees are
flattened by pointer jumping, and links between different trees go on to the next round. A node with
very many links is only grouped with map-side combining and joined; adaptive execution splits its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import stored


def _flatten(parents: DataFrame) -> DataFrame:
    """Point every node at the root of its tree."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = stored(
            parents.join(up, "label", "left").select(
                "node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")
            ),
            "jump",
        )
        parents = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return parents


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b: long); label is the smallest node it can reach.

    Links of a node with itself and repeated links do no harm. No links give no rows.
    """
    edges = stored(links.where("a <> b").select("a", "b"), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).where("label < node")
        roots = _flatten(stored(parents, "parents"))
        if labels is None:
            labels = roots
        else:
            over = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
            moved = labels.join(over, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
            labels = stored(moved.union(roots.join(labels, "node", "left_anti")), "labels")
        for side in ("a", "b"):
            to = roots.select(F.col("node").alias(side), F.col("label").alias("root"))
            edges = edges.join(to, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    return labels.union(roots)
