"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; no neighbourhood is collected. Each step's
edges are written to the scratch folder, so lost executors cost one step at most. So are
the minima: then both sides of the join are dealt for it alone, and the edges of a node
with a large part of them can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge (a, b): root is the least id of its component.

    Loops and repeated edges do no harm; no edges give an empty result. The rounds end with the
    one that leaves stars: then no node has two smaller neighbours, or smaller and larger ones.
    """
    now = saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: the larger neighbours of a node go to the least of its neighbourhood
        smaller = F.col("b") < F.col("a")
        ends = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count_if(smaller).alias("smaller"), F.count_if(~smaller).alias("larger"))
        least = saved(ends.select("u", F.least("u", "m").alias("m"), ((F.col("smaller") > 1) | (F.col("smaller") > 0) & (F.col("larger") > 0)).alias("open")), "least")
        if least.where("open").isEmpty():
            break
        wide = now.join(least.hint("merge"), F.col("b") == F.col("u")).select("a", F.col("m").alias("b"))
        large = saved(wide.where(F.col("a") != F.col("b")), "large-star")
        # small star: the smaller neighbours and the node itself go to the least of them
        low = saved(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        near = large.join(low.hint("merge"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        now = saved(near.unionByName(own).where(F.col("a") != F.col("b")).distinct(), "small-star")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)

