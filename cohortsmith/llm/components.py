"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsmith.session import materialize


def _unsettled(links: DataFrame) -> int:
    """How many nodes have two smaller neighbours, or a smaller and a larger one."""
    down = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    up = links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    ends = down.unionByName(up).groupBy("node").agg(
        F.sum("down").alias("down"), F.max("up").alias("up")
    )
    return ends.where("down > 0 AND down + up > 1").agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """``node, root``: for every linked node the smallest node it can reach.

    ``links`` has two columns ``u, v`` of one type without NULL; order, repetition
    and loops do not matter.  Every round hangs the larger neighbours of a node, then
    the smaller ones, on the smallest neighbour, until every node hangs on one that hangs
    on none; the number of rounds grows with the logarithm of the longest path.  Minima
    are taken before the shuffle, the join that follows has one row per node on its right
    side, and each round is written to the shared folder.
    """
    stars = materialize(
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    while _unsettled(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("low"))
        larger = (
            both.where("v > u")
            .join(low, F.col("u") == F.col("of"))
            .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
            .distinct()
        )
        smallest = larger.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("low"))
        hung = larger.join(smallest, F.col("u") == F.col("of"))
        stars = materialize(
            hung.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(smallest.select(F.col("of").alias("u"), F.col("low").alias("v")))
            .distinct(),
            "links",
        )
    roots = stars.select("v").distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
