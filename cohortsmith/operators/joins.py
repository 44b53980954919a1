"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cohort_episode_join(
    cohort: DataFrame, cohort_key: str, episodes: DataFrame, episode_key: str
) -> DataFrame:
    """Full outer join; unknown keys match each other.

    ``episodes`` holds one row per key.  The join is written as a left join
    plus the unmatched episodes: unlike a full outer join, a left join lets
    Spark split a key that holds a large part of the cohort.
    """
    key = f"{cohort_key}"
    right = episodes.withColumnRenamed(episode_key, "episode_key")
    matched = cohort.join(
        right, F.col(key).eqNullSafe(F.col("episode_key")), "left"
    ).drop("episode_key")
    known = cohort.select(F.col(key).alias("cohort_key")).distinct()
    unmatched = right.join(
        known, F.col("episode_key").eqNullSafe(F.col("cohort_key")), "left_anti"
    ).withColumnRenamed("episode_key", key)
    return matched.unionByName(unmatched, allowMissingColumns=True)
