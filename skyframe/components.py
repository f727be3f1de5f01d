"""Connected components of a graph given as a table of edges, by contraction in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spool import discard, save


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v, of one ordered type): component is the smallest node reachable.

    Each round every node takes the smallest of itself and its neighbours as its parent, parents
    are followed to their roots, and the edges are rewritten between the roots; edges inside a
    root vanish. A node with a smaller neighbour always merges, so the number of live roots at
    least halves a round. A hot node costs one row a neighbour and is summed before the shuffle.
    Self-edges name isolated nodes; nulls are left out; no edges give no rows.
    """
    edges = edges.where("u is not null and v is not null")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node")))
    labels = save(nodes.distinct().withColumn("component", F.col("node")), "components-nodes")
    live = save(_apart(edges), "components-edges")
    while live.limit(1).count():
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent"))
        roots = _roots(save(parents, "components-parents"))
        past = (labels, live, roots)
        labels = save(_relabel(labels, "component", roots), "components-nodes")
        live = save(_apart(_relabel(_relabel(live, "u", roots), "v", roots)), "components-edges")
        discard(*past)
    return labels


def _apart(edges: DataFrame) -> DataFrame:
    return edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _relabel(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """The values of ``column`` replaced by their roots where they have one."""
    names = df.columns
    map_ = roots.select(F.col("node").alias(column), F.col("parent").alias("_root"))
    return df.join(map_, column, "left").withColumn(column, F.coalesce("_root", column)).select(*names)


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parents to their ends by doubling; parents are smaller than or equal to their nodes, so there are no cycles."""
    table = parents
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        jumped = save(
            parents.join(up, "parent", "left").select("node", F.coalesce("_up", "parent").alias("next"), "parent"), "components-jump"
        )
        moved = jumped.where("next != parent").limit(1).count()
        discard(table)
        table, parents = jumped, jumped.select("node", F.col("next").alias("parent"))
        if not moved:
            parents.saved_path = jumped.saved_path
            return parents
