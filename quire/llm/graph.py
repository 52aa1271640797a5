"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a long, b long); root is the smallest node that edges reach.

    Each round points a node at its smallest neighbour, follows the pointers by doubling until they
    rest, and contracts the edges to the roots, so stars take one round and a path of n nodes about
    log n. Every step is a written table; nothing comes to the driver but counts.
    """
    left = kept(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    roots = None
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = kept(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "pointers")
        while True:
            up = to.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = kept(to.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("root")).alias("moved")), "pointers")
            to, moved = jumped.select("node", "root"), not jumped.filter("moved").isEmpty()
            if not moved:
                break
        if roots is None:
            roots = to
        else:
            lifted = roots.join(to.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
            roots = kept(lifted.select("node", F.coalesce("up", "root").alias("root")), "roots")
        by = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        again = left.join(by, "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = kept(again.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct(), "edges")
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
