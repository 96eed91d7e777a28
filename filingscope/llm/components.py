"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of an edge; edges has the columns a and b of type long.

    Every node points at the smallest node it knows of. Each round sends, over every edge, the smaller pointer to the
    node at the larger one (hooking of trees), then halves the pointer paths until all are flat. Rounds end when no edge joins
    two trees. Rows are only ever edges and nodes; the driver sees one count a round. Each round's tables are written to the
    shared folder.
    """
    both = edges.select("a", "b").where(F.col("a") != F.col("b"))
    left = saved(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pointer = None
    while True:
        # Roots hook onto the smallest root next to them.
        hooks = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        roots = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
        jump = saved(roots.join(hooks, "node", "left").select("node", F.coalesce("to", "node").alias("to")))
        while True:
            two = jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("further")), "to")
            jump = saved(two.select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
            moved = jump.where("moved").limit(1).count()
            jump = jump.select("node", "to")
            if not moved:
                break
        # Nodes follow their roots, edges shrink to edges between roots.
        if pointer is None:
            pointer = jump.withColumnRenamed("to", "component")
        else:
            step = jump.select(F.col("node").alias("component"), "to")
            pointer = saved(pointer.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        a = left.join(jump.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ab = a.join(jump.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x != y")
        left = saved(ab.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if left.limit(1).count() == 0:
            return pointer
