"""Row filters and column housekeeping."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType


def tested_only(
    df: DataFrame, result: str, values: Sequence[str] = ("positive", "negative")
) -> DataFrame:
    return df.where(F.col(result).isin(*values))


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def date_cutoff(df: DataFrame, col: str, before: date) -> DataFrame:
    """Rows strictly before the date."""
    return df.where(F.col(col) < F.lit(before))


def subgroup(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition is true; unknown counts as not true."""
    return df.where(condition)


def drop_category(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.where(F.col(col) != value)


def unvaccinated(df: DataFrame, col: str, marker: str) -> DataFrame:
    """Rows whose vaccination answer lacks ``marker``; unknown answers stay."""
    return df.where(~F.coalesce(F.col(col).contains(marker), F.lit(False)))


def bbox_filter(
    df: DataFrame,
    lon: str,
    lat: str,
    left: float,
    bottom: float,
    right: float,
    top: float,
) -> DataFrame:
    return df.where(F.col(lon).between(left, right) & F.col(lat).between(bottom, top))


def rename_first(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnRenamed(df.columns[0], name)


def round_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round the fractional columns, half to even, for display."""
    return df.select([
        F.bround(f.name, digits).alias(f.name)
        if isinstance(f.dataType, FractionalType)
        else F.col(f.name)
        for f in df.schema.fields
    ])
