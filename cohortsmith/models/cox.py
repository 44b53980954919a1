"""Cox proportional hazards with Efron ties."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsmith.functions.stats import wald_z
from cohortsmith.models.batch import MAX_PATTERNS, Levels, collapse, run_fits
from cohortsmith.models.design import Term, labels_of, local_design, own_names
from cohortsmith.models.efron import tie_sums
from cohortsmith.models.large import (
    Large,
    added_up,
    arrow_design,
    as_batch,
    by_model,
    collected,
    sums_schema,
    upper,
)
from cohortsmith.models.logistic import _null_for_nan
from cohortsmith.models.newton import (
    Evaluate,
    Fit,
    Likelihood,
    answered,
    answered_together,
    estimable,
    maximise,
    together,
)

TOLERANCE = 1e-9
ITERATIONS = 20

# Rows of a range of times in the distributed fit: what one task sorts.
ROWS_PER_RANGE = 200_000

# Ways in which the rows of a single time are dealt out.
SHARES = 64

# Keys of the sums per range.
KINDS = {"trial": "int", "range": "int"}
KEYS = list(KINDS)

SCHEMA = (
    "term string, hazard_ratio double, ci_lower double, ci_upper double, "
    "coef double, std_error double, statistic double, p_value double, "
    "n_obs long, n_events long, converged boolean"
)


def _tie_parts(s0, s1, e0, e1, d):
    """Summed tie terms of one or more times: log-likelihood, gradient, outer."""
    logs, c, fc, cc, fcc, ffcc = tie_sums(s0, e0, d)
    gradient = c @ s1 - fc @ e1
    cross = (s1 * fcc[:, None]).T @ e1
    outer = (
        (s1 * cc[:, None]).T @ s1 - cross - cross.T + (e1 * ffcc[:, None]).T @ e1
    )
    return logs.sum(), gradient, outer, c, fc


def _local_evaluate(
    x: np.ndarray, time: np.ndarray, n: np.ndarray, d: np.ndarray
) -> Evaluate:
    """Likelihood over pattern rows; risk sets are running sums from the end."""
    risk = RiskSets(x, time, n, d)

    def evaluate(beta):
        eta = x @ beta
        eta = eta - eta.max()
        p = len(beta)
        logs, grad, second = risk.tie_terms(eta, np.zeros(1 + p), np.zeros((p, p)))
        return Likelihood(float(d @ eta - logs), d @ x - grad, second)

    return evaluate


class RiskSets:
    """Pattern rows of a range of times, sorted from its end."""

    def __init__(self, x: np.ndarray, time: np.ndarray, n: np.ndarray, d: np.ndarray):
        self.order = np.argsort(-time, kind="stable")
        self.x, self.n, self.d = x[self.order], n[self.order], d[self.order]
        time = time[self.order]
        self.starts = np.flatnonzero(np.r_[True, time[1:] != time[:-1]])
        self.ends = np.r_[self.starts[1:], len(time)] - 1
        self.which = np.repeat(
            np.arange(len(self.starts)), np.diff(np.r_[self.starts, len(time)])
        )
        deaths = np.add.reduceat(self.d, self.starts)
        self.with_event = deaths > 0
        self.deaths = deaths[self.with_event]

    def tie_terms(self, eta: np.ndarray, later: np.ndarray, later_second: np.ndarray):
        """Tie terms of all times: log-likelihood, gradient, information.

        ``later``: the sums of weights and of weighted columns over all rows beyond the
        range, ``later_second`` those of weighted products.
        """
        x, n, d = self.x, self.n, self.d
        w = np.exp(eta[self.order])
        nw, dw = n * w, d * w
        at, here = self.ends, self.with_event
        s0 = np.cumsum(nw)[at][here] + later[0]
        s1 = np.cumsum(nw[:, None] * x, axis=0)[at][here] + later[1:]
        e0 = np.add.reduceat(dw, self.starts)[here]
        e1 = np.add.reduceat(dw[:, None] * x, self.starts, axis=0)[here]
        logs, grad, outer, c, fc = _tie_parts(s0, s1, e0, e1, self.deaths)
        hazard, tied = np.zeros(len(self.starts)), np.zeros(len(self.starts))
        hazard[here], tied[here] = c, fc
        hazard = np.cumsum(hazard[::-1])[::-1]
        weight = nw * hazard[self.which] - dw * tied[self.which]
        second = (x * weight[:, None]).T @ x + c.sum() * later_second
        return logs, grad, second - outer


class TimeRanges:
    """Large models' rows, dealt out by ranges of time.

    A range is a run of times that one task sorts, or a single time with so many rows
    that any number of tasks share it.  One pass sums every range: weights, weighted
    columns and weighted products, as one matrix product per task.  What lies beyond a
    range is then known, and a second pass goes through the times inside each range of
    several times; a single time needs nothing but its sums.  Only sums per range and per
    model reach the driver.
    """

    def __init__(self, large: Large):
        self.terms = large.terms
        self.p = [len(labels_of(terms)) for terms in large.terms]
        self.large = large
        limits, self.single = self._limits()
        starts = {i: np.array(v) for i, v in limits.items()}

        def dealt(batches):
            count = 0
            for batch in batches:
                at = batch.column("at").to_numpy(zero_copy_only=False)
                time = batch.column("time").to_numpy(zero_copy_only=False)
                number = np.zeros(len(at), np.int32)
                for model in np.unique(at):
                    own = at == model
                    number[own] = np.searchsorted(starts[model], time[own], side="right")
                # Rows of a single time go anywhere.
                share = (count + np.arange(len(at))) % SHARES
                count += len(at)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(number), pa.array(share.astype(np.int32))],
                    names=[*batch.schema.names, "range", "share"],
                )

        fields = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in large.rows.schema.fields
        )
        ranged = large.rows.mapInArrow(dealt, f"{fields}, range int, share int")
        alone = [
            (F.col("at") == m) & (F.col("range") == r) for m, r in sorted(self.single)
        ]
        is_single = reduce(lambda a, b: a | b, alone, F.lit(False))
        n_ranges = sum(len(v) + 1 for v in limits.values())
        self.runs = ranged.where(~is_single).drop("share").repartition(
            n_ranges, "at", "range"
        ).persist()
        self.singles = (
            ranged.where(is_single).repartition("at", "range", "share").drop("share").persist()
            if alone else None
        )

    def close(self) -> None:
        self.runs.unpersist()
        if self.singles is not None:
            self.singles.unpersist()

    def _limits(self) -> tuple[dict[int, list[float]], set[tuple[int, int]]]:
        """Inner limits of every model's ranges, and the ranges of a single time."""
        wanted = [max(1, -(-n // ROWS_PER_RANGE)) for n in self.large.n_patterns]
        grid = max(wanted)
        limits: dict[int, list[float]] = {i: [] for i in range(len(wanted))}
        single: set[tuple[int, int]] = set()
        if grid == 1:
            return limits, single
        steps = F.array(*[F.lit(i / grid) for i in range(1, grid)])
        for row in self.large.rows.groupBy("at").agg(
            F.percentile_approx("time", steps, max(10_000, 20 * grid)).alias("times")
        ).collect():
            model, times = row["at"], row["times"]
            n = wanted[model]
            picked = [times[round(i * grid / n) - 1] for i in range(1, n)]
            inner: set[float] = set()
            for a, b in zip(picked, [*picked[1:], None]):
                inner.add(a)
                if a == b:  # more than a range's rows: a range of its own
                    inner.add(float(np.nextafter(a, np.inf)))
            ordered = sorted(inner)
            limits[model] = ordered
            for k, (a, b) in enumerate(zip(ordered, ordered[1:]), 1):
                if b == np.nextafter(a, np.inf):
                    single.add((model, k))
        return limits, single

    def moments(self) -> tuple[dict, dict, dict]:
        """Means of the design columns, their cross products about them, and counts."""
        terms = self.terms

        def first(model, part):
            x = arrow_design(part, terms[model])
            n = part.column("n").to_numpy(zero_copy_only=False).astype(float)
            d = part.column("d").to_numpy(zero_copy_only=False).astype(float)
            yield (model,), np.concatenate([[n.sum(), d.sum()], n @ x])

        models = list(range(len(terms)))
        found = added_up(self.large.active(models), first, {"model": "int"})
        counts = {m: (int(found[m,][0]), int(found[m,][1])) for m in models}
        means = {m: found[m,][2:] / found[m,][0] for m in models}

        def second(model, part):
            x = arrow_design(part, terms[model]) - means[model]
            n = part.column("n").to_numpy(zero_copy_only=False).astype(float)
            yield (model,), ((x * n[:, None]).T @ x)[np.triu_indices(x.shape[1])]

        found = added_up(self.large.active(models), second, {"model": "int"})
        spread = {m: upper(found[m,], self.p[m]) for m in models}
        return means, spread, counts

    def likelihoods(
        self, asked: Sequence[tuple[int, np.ndarray]], means: dict
    ) -> list[Likelihood]:
        """The likelihoods of any vectors of any models, from one or two passes.

        Columns are centred.  Where an exponential still leaves the range of numbers the
        likelihood is not finite, and the search takes a shorter step.
        """
        of_model: dict[int, list] = {}
        for trial, (model, beta) in enumerate(asked):
            of_model.setdefault(model, []).append((trial, beta))
        terms = self.terms

        def sums(batches):
            totals: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for model, part in by_model(batch):
                    number = part.column("range").to_numpy(zero_copy_only=False)
                    x = arrow_design(part, terms[model]) - means[model]
                    n = part.column("n").to_numpy(zero_copy_only=False).astype(float)
                    d = part.column("d").to_numpy(zero_copy_only=False).astype(float)
                    one = np.column_stack([np.ones(len(x)), x])
                    above = np.triu_indices(one.shape[1])
                    for r in np.unique(number):
                        own = number == r
                        rows, n_own, d_own = one[own], n[own], d[own]
                        for trial, beta in of_model[model]:
                            eta = rows[:, 1:] @ beta
                            with np.errstate(over="ignore"):
                                w = np.exp(eta)
                            key = (trial, int(r))
                            value = np.concatenate([
                                [d_own.sum(), d_own @ eta], d_own @ rows[:, 1:],
                                ((rows * (n_own * w)[:, None]).T @ rows)[above],
                                ((rows * (d_own * w)[:, None]).T @ rows)[above],
                            ])
                            totals[key] = totals[key] + value if key in totals else value
            yield as_batch(totals, KEYS)

        with np.errstate(invalid="ignore", over="ignore"):
            per_range = collected(
                self._rows(list(of_model)).mapInArrow(sums, sums_schema(KINDS)), KEYS
            )
            of_trial: dict[int, dict[int, np.ndarray]] = {}
            for (trial, r), row in per_range.items():
                of_trial.setdefault(trial, {})[r] = row
            parts = [
                self._beyond(model, of_trial[trial]) for trial, (model, _) in enumerate(asked)
            ]
        inside = self._inside(of_model, means, {
            (trial, r): later for trial, part in enumerate(parts)
            for r, later in part["later"].items()
        })
        out = []
        for trial, ((model, _), part) in enumerate(zip(asked, parts)):
            p = self.p[model]
            got = inside.get((trial,), np.zeros(1 + p + p * (p + 1) // 2))
            out.append(Likelihood(
                part["own"] - part["logs"] - got[0],
                part["events"] - part["grad"] - got[1 : p + 1],
                part["second"] + upper(got[p + 1 :], p),
            ))
        return out

    def _rows(self, models: Sequence[int]) -> DataFrame:
        wanted = F.col("at").isin([int(m) for m in models])
        rows = self.runs.where(wanted)
        return rows if self.singles is None else rows.unionByName(self.singles.where(wanted))

    def _beyond(self, model: int, per_range: Mapping[int, np.ndarray]) -> dict:
        """Sums of all ranges, those beyond each, and the terms of single times."""
        p, single = self.p[model], self.single
        size = (p + 1) * (p + 2) // 2
        numbers = sorted(per_range)
        rows = np.array([per_range[r] for r in numbers])
        d, own, events = rows[:, 0], rows[:, 1], rows[:, 2 : p + 2]
        risk, dead = rows[:, p + 2 : p + 2 + size], rows[:, p + 2 + size :]
        later = np.cumsum(risk[::-1], axis=0)[::-1] - risk
        whole = [upper(v, p + 1) for v in later]
        out = {
            "own": float(own.sum()), "events": events.sum(axis=0), "logs": 0.0,
            "grad": np.zeros(p), "second": np.zeros((p, p)),
            "later": {
                r: (matrix[0], matrix[1:, 1:])
                for r, matrix, deaths in zip(numbers, whole, d)
                if deaths > 0 and (model, r) not in single
            },
        }
        alone = [k for k, r in enumerate(numbers) if (model, r) in single and d[k] > 0]
        if alone:
            s = np.array([upper(later[k] + risk[k], p + 1) for k in alone])
            e = np.array([upper(dead[k], p + 1) for k in alone])
            logs, grad, outer, c, fc = _tie_parts(
                s[:, 0, 0], s[:, 0, 1:], e[:, 0, 0], e[:, 0, 1:], d[alone]
            )
            second = np.tensordot(c, s[:, 1:, 1:], 1) - np.tensordot(fc, e[:, 1:, 1:], 1)
            out |= {"logs": logs, "grad": grad, "second": second - outer}
        return out

    def _inside(self, of_model, means, later) -> dict[tuple, np.ndarray]:
        """Tie terms of the times inside ranges of several times."""
        if not later:
            return {}
        terms = self.terms
        trials = {trial for trial, _ in later}
        models = [m for m, own in of_model.items() if any(t in trials for t, _ in own)]

        def terms_of_range(key, table):
            model, r = key[0].as_py(), key[1].as_py()
            part = table.combine_chunks().to_batches()[0]
            x = arrow_design(part, terms[model]) - means[model]
            risk = RiskSets(
                x, *[
                    part.column(c).to_numpy(zero_copy_only=False).astype(float)
                    for c in ("time", "n", "d")
                ],
            )
            above = np.triu_indices(x.shape[1])
            totals = {}
            for trial, beta in of_model[model]:
                if (trial, r) not in later:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    logs, grad, second = risk.tie_terms(x @ beta, *later[trial, r])
                totals[trial,] = np.concatenate([[logs], grad, second[above]])
            return pa.Table.from_batches([as_batch(totals, ["trial"])])

        rows = self.runs.where(F.col("at").isin(models))
        return collected(
            rows.groupBy("at", "range").applyInArrow(
                terms_of_range, sums_schema({"trial": "int"})
            ),
            ["trial"],
        )


def _fit(
    labels: Sequence[str],
    spread: np.ndarray,
    n_obs: int,
    n_events: int,
    confidence: float,
) -> Fit:
    z = wald_z(confidence)
    free = estimable(spread)
    ((beta, best, converged),) = yield from together([
        maximise(np.zeros(len(labels)), free, TOLERANCE, ITERATIONS)
    ])
    errors = np.full(len(labels), np.nan)
    inverse = np.linalg.pinv(best.information[np.ix_(free, free)])
    errors[free] = np.sqrt(np.clip(np.diag(inverse), 0, None))
    coef = np.where(free, beta, np.nan)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        statistic = coef / errors
        return pd.DataFrame({
            "term": list(labels),
            "hazard_ratio": np.exp(coef),
            "ci_lower": np.exp(coef - z * errors),
            "ci_upper": np.exp(coef + z * errors),
            "coef": coef,
            "std_error": errors,
            "statistic": statistic,
            "p_value": [math.erfc(abs(v) / math.sqrt(2)) for v in statistic],
            "n_obs": n_obs,
            "n_events": n_events,
            "converged": converged,
        })


def _nothing_to_fit(n_obs: int, n_events: int) -> pd.DataFrame:
    """One row without an estimate, for a model without design columns."""
    numbers = [f.split()[0] for f in SCHEMA.split(", ")[1:8]]
    return pd.DataFrame({
        "term": [None], **{c: [np.nan] for c in numbers},
        "n_obs": n_obs, "n_events": n_events, "converged": False,
    })


def _fitters(confidence: float):
    def fit_local(patterns: pd.DataFrame, terms: list[Term]) -> pd.DataFrame:
        labels, x = local_design(patterns, terms)
        n = patterns["n"].to_numpy(float)
        d = patterns["d"].to_numpy(float)
        if not labels:
            return _nothing_to_fit(int(n.sum()), int(d.sum()))
        centred = x - (n @ x) / n.sum()
        return answered(
            _fit(
                labels, (centred * n[:, None]).T @ centred,
                int(n.sum()), int(d.sum()), confidence,
            ),
            _local_evaluate(centred, patterns["time"].to_numpy(float), n, d),
        )

    def fit_large(large: Large) -> list[pd.DataFrame]:
        ranges = TimeRanges(large)
        try:
            means, spread, counts = ranges.moments()

            def fit(model: int, labels: list[str]) -> Fit:
                if not labels:
                    return _nothing_to_fit(*counts[model])
                return (yield from _fit(labels, spread[model], *counts[model], confidence))

            return answered_together(
                [fit(i, labels_of(terms)) for i, terms in enumerate(large.terms)],
                lambda asked: ranges.likelihoods(asked, means),
            )
        finally:
            ranges.close()

    return fit_local, fit_large


def _response(time: str, event: str) -> dict:
    # Times that differ only by rounding noise are ties.
    return {
        "time": F.round(F.col(time).cast("double"), 9),
        "outcome": F.col(event).cast("int"),
    }


def cox_batch(
    df: DataFrame,
    time: str,
    event: str,
    exposures: Mapping[str, Levels],
    adjust: Sequence[Term] = (),
    strata: Sequence[str] = (),
    confidence: float = 0.95,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """One model per exposure, each with the same adjusters.

    An exposure with one level and no adjusters gives a row without an estimate.
    """
    df, adjust = own_names(df, adjust)
    collapsed = collapse(
        df, adjust, _response(time, event), {"d": "outcome"}, exposures, strata
    )
    fit_local, fit_large = _fitters(confidence)
    return _null_for_nan(
        run_fits(
            collapsed, adjust, exposures, strata, SCHEMA, fit_local, fit_large,
            max_patterns,
        )
    )


def cox_hr(
    df: DataFrame,
    time: str,
    event: str,
    terms: Sequence[Term],
    strata: Sequence[str] = (),
    confidence: float = 0.95,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """Hazard ratios of one model, optionally refitted per stratum."""
    df, terms = own_names(df, terms)
    collapsed = collapse(
        df, terms, _response(time, event), {"d": "outcome"}, None, strata
    )
    fit_local, fit_large = _fitters(confidence)
    fits = run_fits(
        collapsed, terms, None, strata, SCHEMA, fit_local, fit_large, max_patterns
    )
    return _null_for_nan(fits.drop("model"))
