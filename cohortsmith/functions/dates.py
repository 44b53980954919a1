"""Date expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortsmith.functions.recode import _col


def week_start(c: Column | str) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", _col(c)).cast("date")


def month_key(c: Column | str) -> Column:
    """Calendar month as ``YYYY-MM`` text."""
    return F.date_format(_col(c), "yyyy-MM")


def delay_days(end: Column | str, start: Column | str) -> Column:
    return F.date_diff(_col(end), _col(start))


def clamp_floor(c: Column | str, floor: int | float = 0) -> Column:
    """Raise values below ``floor`` to it; NULL stays NULL."""
    c = _col(c)
    return F.when(c < floor, F.lit(floor)).otherwise(c)


def era_from_month(
    c: Column | str, starts: Sequence[str], labels: Sequence[str]
) -> Column:
    """Era of a ``YYYY-MM`` month.

    ``starts`` holds the first month of every era after the first one.
    """
    c = _col(c)
    chain = F.when(c < starts[0], labels[0])
    for upper, label in zip(starts[1:], labels[1:]):
        chain = chain.when(c < upper, label)
    return chain.when(c >= starts[-1], labels[-1])
