"""Greedy joining of labels along ordered edges, with rooted labels never joined together.

Joining edges smallest first, and refusing to join two rooted components, gives the
minimum spanning forest of the graph in which all rooted labels are one virtual vertex.
Each round every free component takes its smallest edge, so the number of components
at least halves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.session import cut_lineage

# An edge: free label a, other label b, whether b is rooted, and its order.
EDGE = ["a", "b", "b_rooted", "rank"]


def lightest(edges: DataFrame) -> DataFrame:
    """Per free label the smallest edge to a rooted one; per free pair the smallest edge."""
    key = F.when(F.col("b_rooted"), F.lit(None)).otherwise(F.col("b"))
    ordered = edges.withColumns(
        {
            "_a": F.when(F.col("b_rooted"), F.col("a")).otherwise(F.least("a", "b")),
            "_b": F.when(F.col("b_rooted"), F.col("b")).otherwise(F.greatest("a", "b")),
        }
    ).select(F.col("_a").alias("a"), F.col("_b").alias("b"), "b_rooted", "rank")
    return (
        ordered.withColumn("_key", key)
        .groupBy("a", "b_rooted", "_key")
        .agg(F.min(F.struct("rank", "b")).alias("m"))
        .select("a", F.col("m.b").alias("b"), "b_rooted", F.col("m.rank").alias("rank"))
    )


def _picks(edges: DataFrame) -> DataFrame:
    """Smallest edge of every free label."""
    forth = edges.select(F.col("a").alias("node"), "rank", F.col("b").alias("parent"), F.col("b_rooted").alias("rooted"))
    back = edges.filter(~F.col("b_rooted")).select(
        F.col("b").alias("node"), "rank", F.col("a").alias("parent"), F.lit(False).alias("rooted")
    )
    return (
        forth.unionByName(back)
        .groupBy("node")
        .agg(F.min(F.struct("rank", "parent", "rooted")).alias("m"))
        .select("node", "m.parent", "m.rooted")
    )


def _roots(picks: DataFrame) -> DataFrame:
    """Follow the picked edges to their ends by pointer doubling: node, root, rooted."""
    other = picks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    # Two components picking each other form the only possible cycle: the smaller stays.
    links = cut_lineage(
        picks.join(other, "parent", "left")
        .filter(~(F.coalesce(F.col("grand") == F.col("node"), F.lit(False)) & (F.col("node") < F.col("parent"))))
        .select("node", "parent", "rooted")
    )
    while True:
        ahead = links.select(
            F.col("node").alias("parent"), F.col("parent").alias("grand"), F.col("rooted").alias("grand_rooted")
        )
        jumped = cut_lineage(
            links.join(ahead, "parent", "left").select(
                "node",
                F.coalesce("grand", "parent").alias("parent"),
                F.coalesce("grand_rooted", "rooted").alias("rooted"),
                F.col("grand").isNotNull().alias("moved"),
            )
        )
        links = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return links.select("node", F.col("parent").alias("root"), "rooted")


def join_free_labels(edges: DataFrame) -> DataFrame:
    """Final component of every free label that was joined: label, component."""
    edges = cut_lineage(lightest(edges))
    assigned = None
    while not edges.isEmpty():
        roots = cut_lineage(_roots(_picks(edges)))
        merged = roots.select(F.col("node").alias("component"), F.col("root").alias("_root"))
        fresh = roots.select(F.col("node").alias("label"), F.col("root").alias("component"))
        if assigned is None:
            assigned = fresh
        else:
            moved = assigned.join(merged, "component", "left").select(
                "label", F.coalesce("_root", "component").alias("component")
            )
            assigned = cut_lineage(
                moved.unionByName(fresh.join(assigned, "label", "left_anti"))
            )
        end_a = roots.select(F.col("node").alias("a"), F.col("root").alias("to_a"), F.col("rooted").alias("in_a"))
        end_b = roots.select(F.col("node").alias("b"), F.col("root").alias("to_b"), F.col("rooted").alias("in_b"))
        moved_edges = (
            edges.join(end_a, "a", "left")
            .join(end_b, "b", "left")
            .select(
                F.coalesce("to_a", "a").alias("a"),
                F.coalesce("to_b", "b").alias("b"),
                F.coalesce("in_a", F.lit(False)).alias("a_rooted"),
                (F.col("b_rooted") | F.coalesce("in_b", F.lit(False))).alias("b_rooted"),
                "rank",
            )
            .filter("a <> b AND NOT (a_rooted AND b_rooted)")
            .select(
                F.when(F.col("a_rooted"), F.col("b")).otherwise(F.col("a")).alias("a"),
                F.when(F.col("a_rooted"), F.col("a")).otherwise(F.col("b")).alias("b"),
                (F.col("a_rooted") | F.col("b_rooted")).alias("b_rooted"),
                "rank",
            )
        )
        edges = cut_lineage(lightest(moved_edges))
    if assigned is None:
        return edges.select(F.col("a").alias("label"), F.col("b").alias("component"))
    return assigned
