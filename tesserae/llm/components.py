"""Connected components by alternating large-star and small-star, as joins and aggregations.

Both steps replace the links of a node by links to the least node it knows: large-star moves
the larger neighbours, small-star the smaller ones. They stop at a forest of stars, whose
centres are the least ids. A node of many links is never collected: its least neighbour is a
partially aggregated minimum, joined back to its links by a join that Spark can split.

Defined cases: links to oneself and links with a null end say nothing; repeated links count
once; without links there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import forget, saved


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.where("u > v")  # large-star leaves only links that point to a smaller node
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node has one link up at most, and none of those linked to has one."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("centre")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).where("up > 1 OR (up = 1 AND centre = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of a link `(u, v)` that isn't the least of its component."""
    now = saved(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _is_forest_of_stars(now):
        then = now
        now = saved(_small_star(_large_star(then)), "stars")
        forget(then)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
