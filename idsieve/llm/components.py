"""Connected components of a graph whose edges are a table.

Large-star and small-star steps (Kiveris and others, "Connected Components in MapReduce and Beyond")
in turn: each keeps the components, and none makes more edges than there were. Every round is written
to the shared folder, so a lost executor costs one round at most. A node that a third of all edges lead to is
read by many tasks: its edges are only aggregated in part first, or joined with a plain table, whose skew
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch


def _small_star(links: DataFrame) -> DataFrame:
    """Each node, and what it is linked down to, linked to the least of these.

    No node has more links down than it had edges at first, so none is hot here.
    """
    least = links.withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
    ends = F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return least.select(F.explode(ends).alias("x")).select("x.hi", "x.lo").where("hi != lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for all nodes of the edges (columns a and b). Loops are left out.

    The rounds end by themselves: a path of n nodes takes about the logarithm of n.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    links = scratch.saved(_small_star(links), "edges")
    while True:
        up, down = F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v"))
        ends = links.select(F.explode(F.array(up, down)).alias("end")).select("end.u", "end.v")
        open_ = ends.groupBy("u").agg(F.min("v").alias("m"), (F.max("v") > F.col("u")).alias("between"), F.count_if(F.col("v") < F.col("u")).alias("down"))
        open_ = scratch.saved(open_.where((F.col("m") < F.col("u")) & (F.col("between") | (F.col("down") > 1))), "open")
        if open_.isEmpty():  # each node has one link down, and none leads on from there
            break
        large = links.join(open_.where("between").select(F.col("u").alias("lo"), "m"), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        links = scratch.saved(_small_star(large), "edges")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
