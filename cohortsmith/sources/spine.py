"""Calendar spines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def date_spine(
    spark: SparkSession, start: str, end: str, step: str = "1 day", name: str = "date"
) -> DataFrame:
    """Every date from ``start`` to ``end``, both included."""
    dates = F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step}")
    )
    return spark.range(1).select(F.explode(dates).alias(name))


def group_spine(
    df: DataFrame,
    by: list[str],
    start,
    end,
    step: str = "1 day",
    name: str = "date",
) -> DataFrame:
    """One spine per group of ``by``; ``start`` and ``end`` are columns or dates."""
    dates = F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step}")
    )
    return df.select(*by).distinct().select(*by, F.explode(dates).alias(name))
