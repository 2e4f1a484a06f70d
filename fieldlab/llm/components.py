"""Connected components of a table of links, with DataFrame functions only.

Union-find over tables: every round hooks each node's neighbours to the
smallest neighbour it knows of (large star, then small star), which halves the
depth of the trees; it ends when every link leads straight to a root. Rounds are
written to the shared folder, so the lineage stays short, and nothing but one
boolean a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import Scratch


def _star(links: DataFrame) -> DataFrame:
    """Large star and small star in turn."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("b")))).alias("x"), "m").select("x.a", F.col("m").alias("b"))
    return small.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has either one link, to a smaller node, or none but those of larger ones."""
    end = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    ends = links.select(end.alias("x")).select("x.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] is not True


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links of any orderable type to (node, component): the smallest node reachable. Nodes without links have no row.

    `links` is read by the first round as it is, so it had better be a table or close to one.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = scratch.keep(_star(ordered), "links")
    while not _settled(now):
        old, now = now, scratch.keep(_star(now), "links")
        scratch.drop(old)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
