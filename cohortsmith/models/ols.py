"""Quadratic least squares with a confidence band."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _t_quantile(spark, probability: float, freedom: int) -> float:
    """Quantile of the t distribution, from the maths library Spark ships with."""
    distribution = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    return distribution(float(freedom)).inverseCumulativeProbability(probability)


def poly_ols(
    df: DataFrame,
    x: str,
    y: str,
    limits: tuple[float, float],
    points: int = 80,
    confidence: float = 0.95,
) -> DataFrame:
    """Fit ``y ~ x + x^2`` within the limits of ``x`` and predict on a grid.

    One aggregation gives means, variances and covariances of x, x^2 and y, which Spark
    merges about their means; so a large offset of ``y`` costs no digits.  The grid spans
    the observed range of ``x``.
    """
    middle = (limits[0] + limits[1]) / 2
    data = df.select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    ).where(F.col("x").between(*limits) & F.col("y").isNotNull())
    u = F.col("x") - F.lit(float(middle))
    got = data.agg(
        F.min("x"), F.max("x"), F.count("*"), F.avg(u), F.avg(u * u), F.avg("y"),
        F.var_pop(u), F.covar_pop(u, u * u), F.var_pop(u * u),
        F.covar_pop(u, F.col("y")), F.covar_pop(u * u, F.col("y")), F.var_pop("y"),
    ).first()
    fields = "x double, fit double, conf_low double, conf_high double"
    spark = df.sparkSession
    low, high, n = got[:3]
    if n <= 3:
        return spark.createDataFrame([], fields)
    centre, mean = np.array(got[3:5]), got[5]
    spread = np.array([[got[6], got[7]], [got[7], got[8]]])
    shared = np.array(got[9:11])
    inverse = np.linalg.pinv(spread)
    slopes = inverse @ shared
    variance = max(got[11] - slopes @ shared, 0.0) * n / (n - 3)
    t = _t_quantile(spark, 0.5 + confidence / 2, n - 3)
    rows = []
    for at in np.linspace(low, high, points):
        v = np.array([at - middle, (at - middle) ** 2]) - centre
        fit = mean + v @ slopes
        margin = t * math.sqrt(variance * (1 + v @ inverse @ v) / n)
        rows.append((float(at), float(fit), float(fit - margin), float(fit + margin)))
    return spark.createDataFrame(rows, fields)
