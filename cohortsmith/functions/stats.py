"""Interval arithmetic."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def wald_z(confidence: float = 0.95) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def wald_bounds(
    proportion: Column, size: Column, confidence: float = 0.95
) -> tuple[Column, Column]:
    """Interval that treats ``proportion`` as a binomial share of ``size``.

    Undefined (NULL) for values above 1.
    """
    variance = safe_ratio(proportion * (1 - proportion), size)
    margin = F.lit(wald_z(confidence)) * F.sqrt(F.when(variance >= 0, variance))
    return proportion - margin, proportion + margin


def ci_label(low: Column, high: Column, digits: int = 2) -> Column:
    pattern = f"%.{digits}f-%.{digits}f"
    return F.when(
        low.isNotNull() & high.isNotNull(), F.format_string(pattern, low, high)
    )
