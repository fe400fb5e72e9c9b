"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import discard, staged


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (the smallest node it can be reached from), for every node of an edge (src, dst).

    Alternates two steps until no edge changes: every larger neighbour of a node is linked to the node's smallest
    neighbour, then every smaller one is. Edges only ever point to smaller nodes, and a star is a fixed point, so a group
    of any size costs a few rounds; per node only a minimum is aggregated, never a list of neighbours. Each round is a
    staged table. Self-loops give a component of one; null ends are dropped.
    """
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null")
    nodes = ends.where("a = b").select("a").distinct()
    now = staged(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        # Written tables on both sides of a join: the optimizer then splits the edges of a star's centre among tasks.
        least = now.select("a", "b").unionAll(now.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = staged(least, label)
        # Larger neighbours of x: the edges in which x is the smaller end.
        up = now.join(least.withColumnRenamed("a", "b").hint("merge"), "b").select("a", F.col("m").alias("b"))
        up = staged(up.where("a <> b").distinct(), label)
        low = staged(up.groupBy("a").agg(F.min("b").alias("m")), label)
        down = up.join(low.hint("merge"), "a").select(F.col("b").alias("x"), "m").where("x <> m").unionAll(low.select(F.col("a").alias("x"), "m")).distinct()
        after = staged(down.select(F.col("x").alias("a"), F.col("m").alias("b")), label)
        print_of = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        same = now.agg(*print_of).head() == after.agg(*print_of).head()
        discard(now, least, up, low)
        now = after
        if same:
            break
    linked = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = nodes.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return linked.unionAll(roots).unionAll(alone.join(linked.unionAll(roots).select("node"), "node", "left_anti"))
