"""Connected components of an edge table by contraction, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.common import cut_lineage


def _compressed(parent: DataFrame) -> DataFrame:
    """Pointer doubling until every node of ``(node, parent)`` points at its root."""
    parent = cut_lineage(parent)
    while True:
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
        jumped = cut_lineage(parent.join(above, "parent", "left").select("node", F.coalesce("_next", "parent").alias("parent"), (F.coalesce("_next", "parent") != F.col("parent")).alias("_moved")))
        parent = jumped.select("node", "parent")
        if not jumped.filter("_moved").take(1):
            return parent


def components(edges: DataFrame) -> DataFrame:
    """``(a long, b long)`` links to ``(node long, root long)`` for every node with a link.

    The root is some node of the component (a local minimum of the last round),
    the same for all of its nodes. Each round points every node at its smallest
    neighbour (a partial aggregate, so a hub does not meet in one task),
    compresses the pointers to their roots and contracts the links; at least
    half of the nodes of every component vanish in a round, so the rounds grow
    with the logarithm of the largest component. An empty table gives an empty
    table; self links and repeated links have no effect.
    """
    links = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots: DataFrame | None = None
    while links.take(1):
        both = links.union(links.select("b", "a"))
        parent = _compressed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low")).select("node", F.least("node", "_low").alias("parent")))
        to = parent.select(F.col("node").alias("a"), F.col("parent").alias("_pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("_pb"))
        if roots is None:
            roots = parent.select("node", F.col("parent").alias("root"))
        else:
            step = parent.select(F.col("node").alias("root"), F.col("parent").alias("_next"))
            roots = cut_lineage(roots.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
        links = cut_lineage(links.join(to[0], "a").join(to[1], "b").select(F.least("_pa", "_pb").alias("a"), F.greatest("_pa", "_pb").alias("b")).filter("a <> b").distinct())
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
