"""Repeated visits of persons.

``dedupe_visits`` comes first: afterwards a person has at most one row per
calendar date, so the windows over a person hold no more rows than the study
has days, however many raw rows the person had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortsmith.functions.stats import safe_ratio


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """First row of every group under a total order.

    Spark keeps only the best row of each group before it shuffles.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def dedupe_visits(
    df: DataFrame, person: str, date: str, order: Sequence[str | Column]
) -> DataFrame:
    """One row per person and date: the first under ``order``."""
    return first_per_group(df, [person, date], order)


def _by_date(person: str, date: str):
    return Window.partitionBy(person).orderBy(date)


def lead_transition(
    df: DataFrame, person: str, date: str, result: str, first: str, then: str
) -> DataFrame:
    """Number of persons with ``first`` directly followed by ``then``."""
    following = F.lead(result).over(_by_date(person, date))
    return (
        df.select(person, result, following.alias("following"))
        .where((F.col(result) == first) & (F.col("following") == then))
        .agg(F.count_distinct(person).alias("n"))
    )


def followed_after_positive(
    df: DataFrame, person: str, date: str, result: str, positive: str
) -> DataFrame:
    """Persons ever positive with a later result that is not positive.

    As in the source analysis the positive result may come at any visit of the
    person.
    """
    following = F.lead(result).over(_by_date(person, date))
    per_person = (
        df.select(
            person,
            (F.col(result) == positive).alias("is_positive"),
            (following != positive).alias("next_differs"),
        )
        .groupBy(person)
        .agg(
            F.bool_or("is_positive").alias("ever"),
            F.bool_or("next_differs").alias("followed"),
        )
    )
    return per_person.where("ever AND followed").agg(F.count("*").alias("n"))


def reversion_share(
    df: DataFrame, person: str, date: str, result: str, positive: str, negative: str
) -> DataFrame:
    """Persons who reverted among those with a result after a positive one."""
    following = F.lead(result).over(_by_date(person, date))
    per_person = (
        df.select(
            person,
            (F.col(result) == positive).alias("is_positive"),
            ((F.col(result) == positive) & (following == negative)).alias("reverts"),
            (following != positive).alias("next_differs"),
        )
        .groupBy(person)
        .agg(
            F.bool_or("is_positive").alias("ever"),
            F.bool_or("next_differs").alias("followed"),
            F.bool_or("reverts").alias("reverted"),
        )
    )
    counts = per_person.agg(
        F.count_if("reverted").alias("reverted"),
        F.count_if(F.expr("ever AND followed")).alias("followed"),
    )
    return counts.withColumn(
        "pct", safe_ratio(F.col("reverted"), F.col("followed")) * 100
    )


def time_since_previous(
    df: DataFrame, person: str, date: str, first: int = 90, name: str = "days"
) -> DataFrame:
    """Days since the previous visit of the person; ``first`` for the first."""
    previous = F.lag(date).over(_by_date(person, date))
    return df.withColumn(
        name, F.coalesce(F.date_diff(F.col(date), previous), F.lit(first))
    )


def half_interval_on_event(
    df: DataFrame, result: str, positive: str, days: str = "days"
) -> DataFrame:
    """Event assumed halfway: positives get half their interval."""
    whole = F.col(days).cast("double")
    return df.withColumn(
        days, F.when(F.col(result) == positive, whole / 2).otherwise(whole)
    )


def censor_repeat_positive(
    df: DataFrame, person: str, date: str, result: str, positive: str
) -> DataFrame:
    """Drop positives that directly follow a positive of the same person."""
    previous = F.lag(result, 1, "").over(_by_date(person, date))
    return (
        df.withColumn("_previous", previous)
        .where(~((F.col("_previous") == positive) & (F.col(result) == positive)))
        .drop("_previous")
    )


def first_last_by_date(
    df: DataFrame,
    person: str,
    date: str,
    first: Sequence[str],
    last: Sequence[str] = (),
) -> DataFrame:
    """Values at the first and the last visit, NULL included."""
    picks = []
    if first:
        picks.append(F.min_by(F.struct(*first), F.col(date)).alias("_first"))
    if last:
        picks.append(F.max_by(F.struct(*last), F.col(date)).alias("_last"))
    return df.groupBy(person).agg(*picks).select(
        person,
        *[F.col(f"_first.{c}").alias(c) for c in first],
        *[F.col(f"_last.{c}").alias(c) for c in last],
    )


def survival_table(
    df: DataFrame,
    person: str,
    date: str,
    result: str,
    positive: str,
    first: Sequence[str] = (),
    last: Sequence[str] = (),
    first_interval: int = 90,
    days_per_unit: float = 30,
    stop_at_first_event: bool = False,
) -> DataFrame:
    """One row per person with follow-up time and event, from deduplicated visits.

    All windows and the final grouping are keyed by person and share one
    shuffle.  ``stop_at_first_event`` also ends the time at the first positive;
    by default only directly repeated positives are dropped.
    """
    timed = half_interval_on_event(
        time_since_previous(df, person, date, first_interval), result, positive
    )
    kept = censor_repeat_positive(timed, person, date, result, positive)
    if stop_at_first_event:
        earlier = _by_date(person, date).rowsBetween(Window.unboundedPreceding, -1)
        is_positive = F.coalesce(F.col(result) == positive, F.lit(False))
        seen = F.coalesce(F.bool_or(is_positive).over(earlier), F.lit(False))
        kept = kept.withColumn("_seen", seen).where(~F.col("_seen")).drop("_seen")
    is_event = F.coalesce((F.col(result) == positive).cast("int"), F.lit(0))
    picks = []
    if first:
        picks.append(F.min_by(F.struct(*first), F.col(date)).alias("_first"))
    if last:
        picks.append(F.max_by(F.struct(*last), F.col(date)).alias("_last"))
    return kept.groupBy(person).agg(
        F.max(is_event).alias("event"),
        (F.sum("days") / days_per_unit).alias("time"),
        F.min(date).alias("inclusiondate"),
        F.count("*").alias("nsurveys"),
        *picks,
    ).select(
        person, "event", "time", "inclusiondate", "nsurveys",
        *[F.col(f"_first.{c}").alias(c) for c in first],
        *[F.col(f"_last.{c}").alias(c) for c in last],
    )
