"""Connected components of a link table, in DataFrame steps.

Every node points to a node of its component with a smaller or equal id.  A
round lets each node, and the node it points to, move to the smallest
grandparent among the neighbours (hooking), and to its own grandparent
(shortcutting).  The number of rounds grows with the logarithm of the longest
path.  Every round is one written table; a node of any degree is only ever
aggregated, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b -> node, component (the smallest node reachable)."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).filter("a <> b"))
    parents = materialize(both.groupBy(F.col("a").alias("node"))
                          .agg(F.least(F.min("b"), F.first("a")).alias("parent")))
    while True:
        grand = (parents.alias("p").join(parents.alias("q"),
                                         F.col("p.parent") == F.col("q.node"))
                 .select("p.node", "p.parent", F.col("q.parent").alias("grand")))
        near = (both.join(grand.select(F.col("node").alias("b"), "grand"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("least")))
        moved = grand.join(near, "node").select(F.explode(F.array(
            F.struct("node", F.least("parent", "grand", "least").alias("parent"),
                     F.col("parent").alias("was")),
            F.struct(F.col("parent").alias("node"), F.col("least").alias("parent"),
                     F.lit(None).cast("bigint").alias("was")))).alias("m")).select("m.*")
        parents = materialize(moved.groupBy("node").agg(
            F.min("parent").alias("parent"), F.max("was").alias("was")))
        if parents.filter(F.col("parent") != F.col("was")).isEmpty():
            return parents.select("node", F.col("parent").alias("component"))
        parents = parents.drop("was")
