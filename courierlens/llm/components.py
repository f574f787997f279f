"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierlens.llm.shared import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; a component is named by its smallest node.

    Each round maps every node to the smallest of its neighbours and itself, and replaces the
    links by those between the nodes mapped to. Smaller and smaller graphs remain until no link
    is left; the smallest node of a component is always mapped to itself, so it is the last one.
    Minima are taken with partial aggregates, and the joins by node can be split where a node has
    many links. Each round is written to the shared folder, which cuts the lineage. Links may be
    repeated, in either direction or of a node to itself; null nodes are left out.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    both = saved(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    names: DataFrame | None = None
    while True:
        step = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "link-step")
        if names is None:
            names = step.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            moved = step.select(F.col("a").alias("_from"), "to")
            names = saved(names.join(moved, F.col("component") == F.col("_from"), "left")
                          .select("node", F.coalesce("to", "component").alias("component")), "components")
        first = step.select(F.col("a").alias("_a"), F.col("to").alias("_to_a"))
        second = step.select(F.col("a").alias("_b"), F.col("to").alias("_to_b"))
        both = saved(both.join(first, F.col("a") == F.col("_a")).join(second, F.col("b") == F.col("_b"))
                     .filter("_to_a <> _to_b").select(F.col("_to_a").alias("a"), F.col("_to_b").alias("b")).distinct(), "links")
        if both.isEmpty():
            return names
