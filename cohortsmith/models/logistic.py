"""Logistic regression: odds ratios with profile-likelihood intervals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsmith.functions.stats import wald_z
from cohortsmith.models.batch import MAX_PATTERNS, Levels, collapse, run_fits
from cohortsmith.models.design import Term, labels_of, local_design, own_names
from cohortsmith.models.large import Large, added_up, arrow_design, upper
from cohortsmith.models.newton import (
    Fit,
    Likelihood,
    answered,
    answered_together,
    estimable,
    maximise,
    profile_bounds,
    together,
)

TOLERANCE = 1e-8
ITERATIONS = 25

SCHEMA = (
    "term string, estimate double, std_error double, statistic double, "
    "p_value double, conf_low double, conf_high double, n_obs long, "
    "converged boolean"
)


def _likelihood(x: np.ndarray, n: np.ndarray, k: np.ndarray, beta: np.ndarray) -> Likelihood:
    eta = x @ beta
    with np.errstate(over="ignore"):
        mu = 1 / (1 + np.exp(-eta))
    return Likelihood(
        float(k @ eta - n @ np.logaddexp(0, eta)),
        x.T @ (k - n * mu),
        (x * (n * mu * (1 - mu))[:, None]).T @ x,
    )


def _fit(labels: Sequence[str], n_obs: int, confidence: float, profile: bool) -> Fit:
    z = wald_z(confidence)
    zero = np.zeros(len(labels))
    (start,) = yield [zero]
    # At zero every row weighs a quarter: the information is that of the cross products.
    free = estimable(4 * start.information)
    ((beta, best, converged),) = yield from together([
        maximise(zero, free, TOLERANCE, ITERATIONS, start)
    ])
    errors = np.full(len(labels), np.nan)
    inverse = np.linalg.pinv(best.information[np.ix_(free, free)])
    errors[free] = np.sqrt(np.clip(np.diag(inverse), 0, None))
    if profile:
        bounds = yield from profile_bounds(beta, best, free, z, TOLERANCE, ITERATIONS)
    else:
        bounds = np.column_stack([beta - z * errors, beta + z * errors])
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        statistic = beta / errors
        return pd.DataFrame({
            "term": list(labels),
            "estimate": np.where(free, np.exp(beta), np.nan),
            "std_error": errors,
            "statistic": statistic,
            "p_value": [math.erfc(abs(s) / math.sqrt(2)) for s in statistic],
            "conf_low": np.exp(bounds[:, 0]),
            "conf_high": np.exp(bounds[:, 1]),
            "n_obs": n_obs,
            "converged": converged,
        })


def _with_intercept(columns: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(columns)), columns])


def _likelihoods(
    large: Large, asked: Sequence[tuple[int, np.ndarray]]
) -> list[Likelihood]:
    """The likelihoods of any vectors of any models, from one pass over the models' rows."""
    of_model: dict[int, list[tuple[int, np.ndarray]]] = {}
    for trial, (model, beta) in enumerate(asked):
        of_model.setdefault(model, []).append((trial, beta))
    terms = large.terms

    def sums(model: int, part: pa.RecordBatch):
        x = _with_intercept(arrow_design(part, terms[model]))
        n = part.column("n").to_numpy(zero_copy_only=False).astype(float)
        k = part.column("k").to_numpy(zero_copy_only=False).astype(float)
        above = np.triu_indices(x.shape[1])
        for trial, beta in of_model[model]:
            found = _likelihood(x, n, k, beta)
            yield (trial,), np.concatenate([
                [found.value], found.gradient, found.information[above]
            ])

    found = added_up(large.active(list(of_model)), sums, {"trial": "int"})
    out = []
    for trial, (_, beta) in enumerate(asked):
        p, got = len(beta), found[trial,]
        out.append(Likelihood(got[0], got[1 : p + 1], upper(got[p + 1 :], p)))
    return out


def _fitters(confidence: float, conf: str):
    profile = conf == "profile"

    def fit_local(patterns: pd.DataFrame, terms: list[Term]) -> pd.DataFrame:
        labels, columns = local_design(patterns, terms)
        x = _with_intercept(columns)
        n = patterns["n"].to_numpy(float)
        k = patterns["k"].to_numpy(float)
        return answered(
            _fit(["(Intercept)", *labels], int(n.sum()), confidence, profile),
            lambda beta: _likelihood(x, n, k, beta),
        )

    def fit_large(large: Large) -> list[pd.DataFrame]:
        n_obs = {
            r["at"]: r["n"]
            for r in large.rows.groupBy("at").agg(F.sum("n").alias("n")).collect()
        }
        fits = [
            _fit(["(Intercept)", *labels_of(terms)], n_obs[i], confidence, profile)
            for i, terms in enumerate(large.terms)
        ]
        return answered_together(fits, lambda asked: _likelihoods(large, asked))

    return fit_local, fit_large


def _null_for_nan(df: DataFrame) -> DataFrame:
    return df.select([
        F.when(~F.isnan(name), F.col(name)).alias(name) if kind == "double" else name
        for name, kind in df.dtypes
    ])


def logistic_batch(
    df: DataFrame,
    outcome: str,
    exposures: Mapping[str, Levels],
    adjust: Sequence[Term] = (),
    strata: Sequence[str] = (),
    confidence: float = 0.95,
    conf: str = "profile",
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """One model per exposure, each with the same adjusters, and per stratum.

    ``exposures`` maps a column to its levels, reference first, to just the
    reference, or to None for the sorted values present.  ``outcome`` is 0/1; rows with NULL in a variable
    of a model are left out of that model.
    """
    df, adjust = own_names(df, adjust)
    collapsed = collapse(
        df, adjust, {"outcome": F.col(outcome).cast("int")}, {"k": "outcome"},
        exposures, strata,
    )
    fit_local, fit_large = _fitters(confidence, conf)
    return _null_for_nan(
        run_fits(
            collapsed, adjust, exposures, strata, SCHEMA, fit_local, fit_large,
            max_patterns,
        )
    )


def logistic_or(
    df: DataFrame,
    outcome: str,
    terms: Sequence[Term],
    strata: Sequence[str] = (),
    confidence: float = 0.95,
    conf: str = "profile",
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """Odds ratios of one model, optionally refitted per stratum.

    ``std_error`` and ``statistic`` are on the log-odds scale.
    """
    df, terms = own_names(df, terms)
    collapsed = collapse(
        df, terms, {"outcome": F.col(outcome).cast("int")}, {"k": "outcome"},
        None, strata,
    )
    fit_local, fit_large = _fitters(confidence, conf)
    fits = run_fits(
        collapsed, terms, None, strata, SCHEMA, fit_local, fit_large, max_patterns
    )
    return _null_for_nan(fits.drop("model"))
