"""Counts over time, value and space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortsmith.functions.dates import week_start
from cohortsmith.functions.stats import safe_ratio
from cohortsmith.sources.spine import group_spine


def epicurve_weekly(df: DataFrame, date: str, category: str) -> DataFrame:
    """Rows per week (Monday) and category."""
    return df.groupBy(week_start(date).alias("week"), category).agg(
        F.count("*").alias("n")
    )


def daily_counts(df: DataFrame, date: str, series: str) -> DataFrame:
    return df.groupBy(series, F.col(date).alias("date")).agg(
        F.count("*").alias("ntotal")
    )


def spine_join(
    daily: DataFrame, series: str, start, end, date: str = "date", n: str = "ntotal"
) -> DataFrame:
    """Every date of the spine for every series; days without rows count zero.

    ``daily`` holds one row per series and date.  Dates outside the spine are
    dropped.
    """
    spine = group_spine(daily, [series], start, end, name=date)
    return (
        spine.join(daily, [series, date], "left")
        .withColumn(n, F.coalesce(F.col(n), F.lit(0)))
    )


def rolling_mean_centered(
    df: DataFrame,
    series: str,
    date: str = "date",
    n: str = "ntotal",
    width: int = 7,
    name: str = "ma",
) -> DataFrame:
    """Centred moving average; NULL where the window is not complete.

    Expects a spined series, that is one row per series and calendar date.
    """
    reach = width // 2
    frame = (
        Window.partitionBy(series)
        .orderBy(date)
        .rowsBetween(reach - width + 1, reach)
    )
    complete = F.count("*").over(frame) == width
    return df.withColumn(name, F.when(complete, F.avg(n).over(frame)))


def stacked_daily(
    df: DataFrame, date: str, series: str, value: str, name: str = "value"
) -> DataFrame:
    return df.groupBy(date, series).agg(F.sum(value).alias(name))


def histogram(df: DataFrame, value: str, facet: str, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins over the common range of all facets.

    The first bin starts at the minimum; the maximum falls in the last bin.  NULL and
    NaN are left out.  One aggregation finds the range, another counts the bins; rows
    are never shuffled one by one.
    """
    values = df.select(
        F.col(facet).alias("facet"), F.col(value).cast("double").alias("value")
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))
    low, high = values.agg(F.min("value"), F.max("value")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / bins
    position = F.floor(safe_ratio(F.col("value") - low, F.lit(width)))
    position = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1))
    return (
        values.groupBy(F.col("facet").alias(facet), position.alias("bin"))
        .agg(F.count("*").alias("n"))
        .withColumn("bin_start", F.lit(low) + F.col("bin") * F.lit(width))
    )


def _cell(col: str, step: float):
    return F.floor(F.col(col) / step)


def point_density(
    df: DataFrame,
    lon: str,
    lat: str,
    step: float,
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Points, or their weights, per grid cell."""
    amount = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(
        _cell(lon, step).alias("lon_cell"), _cell(lat, step).alias("lat_cell"), *by
    ).agg(amount.alias("n"))


def scatter_by_group(
    df: DataFrame,
    x: str,
    y: str,
    by: str,
    limits: tuple[float, float],
    x_step: float = 1.0,
    y_step: float = 1.0,
) -> DataFrame:
    """Binned scatter per group; rows outside the limits of ``x`` are left out."""
    return (
        df.where(F.col(x).between(*limits) & F.col(y).isNotNull())
        .groupBy(by, _cell(x, x_step).alias("x_cell"), _cell(y, y_step).alias("y_cell"))
        .agg(F.count("*").alias("n"))
    )
