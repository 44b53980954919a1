"""Exact quantiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortsmith.session import materialize

# Rows of a group that are ranked whole, without a look at its sketch.
ROWS_PER_BUCKET = 1_000

# Values a sketch keeps, and how far around a probability its values are counted: three
# times the error of a rank that 99 of 100 sketches of this size stay below.
SKETCH = 4_000
MARGIN = 0.0022


def _limits(
    source: DataFrame, by: list[str], probs: Sequence[float], rows_per_bucket: int
) -> DataFrame:
    """Per group its size, total, and for every probability the limits around its value.

    Beyond ``rows_per_bucket`` rows the limits come from a quantile sketch, which Spark
    merges like any other sum; smaller groups are ranked whole.
    """
    sketched = source.groupBy(*by).agg(
        F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch"),
        F.count("*").alias("size"), F.sum("value").alias("total"),
        F.min("value").alias("least"), F.max("value").alias("most"),
    )
    whole = F.col("size") <= rows_per_bucket

    def limit(p, side, edge):
        rank = p + side * MARGIN
        if not 0 < rank < 1:
            return F.col(edge)
        found = F.kll_sketch_get_quantile_double("sketch", F.lit(float(rank)))
        return F.when(whole, F.col(edge)).otherwise(found)

    return sketched.select(
        *by, "size", "total",
        *[limit(p, -1, "least").alias(f"low_{i}") for i, p in enumerate(probs)],
        *[limit(p, 1, "most").alias(f"high_{i}") for i, p in enumerate(probs)],
    )


def _ranked(source: DataFrame, by: list[str], limits: DataFrame, n_probs: int) -> DataFrame:
    """Counted values between any limits, with ``upto``: rows of the group up to the value.

    All other values only count, ahead of the next limit above them.
    """
    own = limits.withColumnsRenamed({k: f"of_{k}" for k in by})
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in by]
    )
    low = [F.col(f"low_{i}") for i in range(n_probs)]
    high = [F.col(f"high_{i}") for i in range(n_probs)]
    value = F.col("value")
    inside = reduce(
        lambda a, b: a | b, [(value >= x) & (value <= y) for x, y in zip(low, high)]
    )
    passed = reduce(lambda a, b: a + b, [(value > y).cast("int") for y in high])
    ahead = F.coalesce(F.get(F.array(*low), passed), F.lit(math.inf))
    counts = (
        source.join(own, same)
        .withColumn("inside", inside)
        .withColumn("value", F.when(F.col("inside"), value).otherwise(ahead))
        .groupBy(*by, "value", "inside", "size", "total")
        .agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy(*by).orderBy("value", "inside")
    return counts.withColumn("upto", F.sum("n").over(order))


def quantile_summary(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    probs: Sequence[float] = (0.5, 0.25, 0.75),
    names: Sequence[str] = ("median", "q25", "q75"),
    mean: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Quantiles by linear interpolation between order statistics, per group.

    The results are exact.  The input is read twice when this is called: the first read
    sketches every group, the second counts the values near a wanted rank one by one and
    all others in between.  Should a sketch have missed a rank, its group is ranked whole
    in a third read.  One row per group is written in between.  NULL and NaN are left out.
    """
    by = list(by)
    source = df.select(
        *by, F.col(value).cast("double").alias("value")
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))
    if not by:
        by, source = ["all"], source.withColumn("all", F.lit(0))
    chosen = sorted(zip(probs, names))

    def positions(p):
        """Fractional position of the quantile and the two ranks around it."""
        position = (F.col("size") - 1) * F.lit(float(p))
        low = F.floor(position)
        return position, low, F.least(low + 1, F.col("size") - 1)

    def order_statistic(rank):
        """Value at a 0-based rank."""
        here = (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
        return F.max(F.when(here & F.col("inside"), F.col("value")))

    def picked(limits):
        stats = [F.max("total").alias("total"), F.max("size").alias("size")]
        for p, name in chosen:
            _, low, high = positions(p)
            stats.append(order_statistic(low).alias(f"{name}_low"))
            stats.append(order_statistic(high).alias(f"{name}_high"))
        return _ranked(source, by, limits, len(chosen)).groupBy(*by).agg(*stats)

    limits = materialize(
        _limits(source, by, [p for p, _ in chosen], rows_per_bucket), "limits"
    )
    found = materialize(picked(limits), "quantiles")
    missed = reduce(lambda a, b: a | b, [
        F.col(f"{name}_{side}").isNull() for name in names for side in ("low", "high")
    ])
    if found.where(missed).limit(1).count():
        again = found.where(missed).select(*[F.col(k).alias(f"of_{k}") for k in by])
        same = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in by]
        )
        wide = limits.join(again, same, "left_semi").withColumns({
            **{f"low_{i}": F.lit(-math.inf) for i in range(len(chosen))},
            **{f"high_{i}": F.lit(math.inf) for i in range(len(chosen))},
        })
        found = found.where(~missed).unionByName(picked(wide))

    def interpolated(name, p):
        position, rank, _ = positions(p)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return (low + (position - rank) * (high - low)).alias(name)

    columns = [interpolated(name, p) for name, p in zip(names, probs)]
    if mean:
        columns.insert(0, (F.col("total") / F.col("size")).alias("mean"))
    return found.select(*([] if by == ["all"] else by), *columns)
