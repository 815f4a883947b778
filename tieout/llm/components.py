"""Connected components by contraction. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _pairs(e: DataFrame) -> DataFrame:
    """Edges (x, y) with x < y, each once."""
    return cut_lineage(e.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes``: node, value (orderable). ``edges``: a, b (nodes; either direction). Returns node, label: a struct
    (value, node) of the smallest node that can be reached.

    Each round every vertex points to its smallest neighbour (or itself), pointers are followed to their end by doubling, and
    edges are replaced by edges between the ends; those within one end vanish. A star is gone after one round, and a chain too,
    so edges shrink geometrically. Vertices without an edge take no part in the rounds."""
    own = nodes.select("node", F.struct("value", "node").alias("label"))
    end = lambda side, name: own.select(F.col("node").alias(side), F.col("label").alias(name))
    e = _pairs(edges.select("a", "b").join(end("a", "x"), "a").join(end("b", "y"), "b"))
    final = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        to = cut_lineage(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("y")).select("v", F.least("v", "y").alias("p")))
        while True:
            up = to.select(F.col("v").alias("p"), F.col("p").alias("further"))
            new = cut_lineage(to.join(up, "p").select("v", F.col("p").alias("was"), F.col("further").alias("p")))
            to = new.select("v", "p")
            if new.filter("was <> p").isEmpty():
                break
        e = _pairs(e.join(to.select(F.col("v").alias("x"), F.col("p").alias("px")), "x")
                   .join(to.select(F.col("v").alias("y"), F.col("p").alias("py")), "y").select(F.col("px").alias("x"), F.col("py").alias("y")))
        if final is None:
            final = to
        else:
            next_ = to.select(F.col("v").alias("p"), F.col("p").alias("further"))
            final = cut_lineage(final.join(next_, "p", "left").select("v", F.coalesce("further", "p").alias("p")))
    if final is None:
        return own
    return own.join(final.select(F.col("v").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
