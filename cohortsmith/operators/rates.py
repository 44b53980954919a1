"""Incidence and prevalence with Wald intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortsmith.functions.stats import safe_ratio, wald_bounds


def _rate_columns(
    events: Column, person_time: Column, units_per_year: float, per: float,
    confidence: float,
) -> list[Column]:
    years = person_time / units_per_year
    rate = safe_ratio(events, person_time) * units_per_year
    low, high = wald_bounds(rate, years, confidence)
    return [
        years.alias("person_years"),
        (rate * per).alias("rate"),
        (low * per).alias("ci_low"),
        (high * per).alias("ci_high"),
    ]


def incidence_rate(
    df: DataFrame,
    time: str,
    event: str,
    by: Sequence[str] = (),
    units_per_year: float = 12,
    per: float = 1,
    confidence: float = 0.95,
) -> DataFrame:
    """Events per person-year, overall or by stratum.

    The interval treats the yearly rate as a share of the person-years and is
    NULL for rates above one.
    """
    sums = df.groupBy(*by).agg(
        F.sum(event).alias("events"), F.sum(time).alias("person_time")
    )
    return sums.select(
        *by, "events",
        *_rate_columns(
            F.col("events"), F.col("person_time"), units_per_year, per, confidence
        ),
    )


def episode_incidence(
    cohort: DataFrame,
    episodes: DataFrame,
    time: str,
    units_per_year: float = 12,
    per: float = 1,
    confidence: float = 0.95,
) -> DataFrame:
    """All rows of an episode table over the person-time of a cohort."""
    sums = cohort.agg(F.sum(time).alias("person_time")).withColumn(
        "events", episodes.agg(F.count("*")).scalar()
    )
    return sums.select(
        "events",
        *_rate_columns(
            F.col("events"), F.col("person_time"), units_per_year, per, confidence
        ),
    )


def prevalence_ci(
    df: DataFrame, result: str, by: Sequence[str], confidence: float = 0.95
) -> DataFrame:
    """Share of every result within the groups of ``by``."""
    counts = df.groupBy(*by, result).agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy(*by))
    shares = counts.withColumns(
        {"size": size, "proportion": safe_ratio(F.col("n"), size)}
    )
    low, high = wald_bounds(F.col("proportion"), F.col("size"), confidence)
    return shares.select(
        *by, result, "n", "proportion", low.alias("ci_low"), high.alias("ci_high")
    )


def stack_ci_offset(
    prevalence: DataFrame,
    result: str,
    by: Sequence[str],
    infected: str,
    vaccinated: str,
    floor: float = 0.01,
) -> DataFrame:
    """Intervals as drawn on stacked bars.

    Only the infected share keeps its interval, moved up by the vaccinated
    share of the same group; bounds below zero are set to ``floor``.
    """
    is_vaccinated = F.col(result) == vaccinated
    below = F.max(F.when(is_vaccinated, F.col("proportion"))).over(
        Window.partitionBy(*by)
    )
    offset = F.coalesce(below, F.lit(0.0))
    keep = F.col(result) == infected
    low = F.when(keep, F.col("ci_low") + offset)
    high = F.when(keep, F.col("ci_high") + offset)
    return prevalence.withColumns(
        {"ci_low": F.when(low < 0, floor).otherwise(low), "ci_high": high}
    )
