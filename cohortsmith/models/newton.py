"""Newton searches that say which coefficients they want to try next.

A search is a generator: it yields a coefficient vector and is sent the likelihood
there.  A fit is a generator of lists: it yields all vectors its searches wait for.
So local fits answer at once, and fits of tables that are too large for one task
share their passes: everything that any model, or any bound of a profile, wants to
know next is answered by the same aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence
from typing import NamedTuple

import numpy as np


class Likelihood(NamedTuple):
    """Log-likelihood, gradient and information matrix at a coefficient vector."""

    value: float
    gradient: np.ndarray
    information: np.ndarray


Evaluate = Callable[[np.ndarray], Likelihood]
Search = Generator[np.ndarray, Likelihood, object]
Fit = Generator[list[np.ndarray], list[Likelihood], object]

# Steps after convergence, and the gain in log-likelihood that ends them.
POLISH = 3
NEGLIGIBLE_GAIN = 1e-20

# Steps of the direct search for a bound, and the step in standard errors that ends it:
# steps shrink quadratically, so what is left after such a step does not count.
DIRECT_STEPS = 15
SHORT_STEP = 1e-6
LONGEST_STEP = 20.0


def together(searches: Sequence[Search]) -> Fit:
    """All searches in step; returns their results in order."""
    results: list = [None] * len(searches)
    waiting: dict[int, np.ndarray] = {}

    def advance(i: int, answer: Likelihood | None) -> None:
        try:
            waiting[i] = searches[i].send(answer)
        except StopIteration as end:
            waiting.pop(i, None)
            results[i] = end.value

    for i in range(len(searches)):
        advance(i, None)
    while waiting:
        asked = list(waiting)
        answers = yield [waiting[i] for i in asked]
        for i, answer in zip(asked, answers):
            advance(i, answer)
    return results


def answered(fit: Fit, evaluate: Evaluate):
    """The result of a fit whose data are at hand."""
    answers = None
    while True:
        try:
            asked = fit.send(answers)
        except StopIteration as end:
            return end.value
        answers = [evaluate(beta) for beta in asked]


def answered_together(
    fits: Sequence[Fit],
    evaluate: Callable[[list[tuple[int, np.ndarray]]], list[Likelihood]],
) -> list:
    """The results of fits that share each evaluation, as pairs (fit, vector).

    A fit that has ended is not part of later evaluations.
    """
    results: list = [None] * len(fits)
    waiting: dict[int, list[np.ndarray]] = {}

    def advance(i: int, answers: list[Likelihood] | None) -> None:
        try:
            waiting[i] = fits[i].send(answers)
        except StopIteration as end:
            waiting.pop(i, None)
            results[i] = end.value

    for i in range(len(fits)):
        advance(i, None)
    while waiting:
        asked = [(i, beta) for i, vectors in waiting.items() for beta in vectors]
        answers = iter(evaluate(asked))
        for i, n in [(i, len(vectors)) for i, vectors in waiting.items()]:
            advance(i, [next(answers) for _ in range(n)])
    return results


def estimable(gram: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Columns that are no linear combination of the columns before them.

    Works on the matrix of cross products, which is small in any case.
    """
    reduced = gram.astype(float).copy()
    scale = np.diag(gram).copy()
    keep = np.zeros(len(gram), bool)
    for j in range(len(gram)):
        if reduced[j, j] > tolerance * max(scale[j], 1e-300):
            keep[j] = True
            reduced -= np.outer(reduced[:, j], reduced[j]) / reduced[j, j]
    return keep


def _solve(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(matrix, vector)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(matrix, vector, rcond=None)[0]


def maximise(
    start: np.ndarray,
    free: np.ndarray,
    tolerance: float,
    iterations: int,
    known: Likelihood | None = None,
) -> Search:
    """Newton steps over the ``free`` coefficients, halved while they overshoot.

    ``known`` is the likelihood at ``start``, if it was asked for before.  The fit has
    converged once the relative change of the log-likelihood is below the tolerance.
    With very many rows that change says little about the coefficients, so a few more
    steps follow until the expected gain of a step is negligible.  Returns
    coefficients, the likelihood there and whether the fit converged.
    """
    beta = start.copy()
    here = known if known is not None else (yield beta)
    if not free.any():
        return beta, here, True
    converged, polish = False, POLISH
    for _ in range(iterations):
        step = _solve(here.information[np.ix_(free, free)], here.gradient[free])
        if converged:
            if polish == 0 or here.gradient[free] @ step < NEGLIGIBLE_GAIN:
                break
            polish -= 1
        for _ in range(12):
            trial = beta.copy()
            trial[free] += step
            new = yield trial
            if np.isfinite(new.value) and new.value >= here.value - 1e-12 * abs(here.value):
                break
            step = step / 2
        else:
            break
        change = abs(new.value - here.value) / (abs(new.value) + 0.1)
        beta, here = trial, new
        converged = converged or change < tolerance
    return beta, here, converged


def profile_bound(
    j: int,
    sign: float,
    beta: np.ndarray,
    best: Likelihood,
    free: np.ndarray,
    critical: float,
    tolerance: float,
    iterations: int,
) -> Search:
    """One profile-likelihood bound of coefficient ``j``, NaN if there is none.

    The bound is where the signed root of twice the log-likelihood drop, with the
    other coefficients refitted, reaches ``critical``.  Newton steps solve for the
    drop and for the others' zero scores at once, from the Wald bound on the line of
    the others' best fits.  The log-likelihood is concave, so what they converge to on
    the right side is the bound.  Where they do not converge, the root is bracketed.
    """
    inside = np.flatnonzero(free)
    at = int(np.flatnonzero(inside == j)[0])
    inverse = np.linalg.pinv(best.information[np.ix_(free, free)])
    errors = np.sqrt(np.clip(np.diag(inverse), 0, None))
    target = best.value - critical**2 / 2
    theta = beta.copy()
    if errors[at] > 0:
        theta[inside] += sign * critical * inverse[:, at] / errors[at]
        for _ in range(DIRECT_STEPS):
            here = yield theta
            if not np.isfinite(here.value):
                break
            matrix = here.information[np.ix_(free, free)].copy()
            right = here.gradient[free].copy()
            matrix[at], right[at] = -here.gradient[free], here.value - target
            try:
                step = np.linalg.solve(matrix, right)
            except np.linalg.LinAlgError:
                break
            length = np.abs(step / np.where(errors > 0, errors, 1.0)).max()
            if not length < LONGEST_STEP:
                break
            theta = theta.copy()
            theta[inside] += step
            if (theta[j] - beta[j]) * sign <= 0:
                break
            if length < SHORT_STEP:
                return theta[j]
    others = free.copy()
    others[j] = False
    last = beta

    def excess(distance):
        nonlocal last
        start = last.copy()
        start[j] = beta[j] + sign * distance
        last, there, _ = yield from maximise(start, others, tolerance, iterations)
        return np.sqrt(max(2 * (best.value - there.value), 0.0)) - critical

    distance = yield from _crossing(excess, critical * errors[at], -critical)
    return np.nan if distance is None else beta[j] + sign * distance


def profile_bounds(
    beta: np.ndarray,
    best: Likelihood,
    free: np.ndarray,
    critical: float,
    tolerance: float,
    iterations: int,
) -> Fit:
    """Both profile-likelihood bounds of every free coefficient, searched together."""
    bounds = np.full((len(beta), 2), np.nan)
    sides = [(j, k) for j in np.flatnonzero(free) for k in (0, 1)]
    found = yield from together([
        profile_bound(
            j, (-1.0, 1.0)[k], beta, best, free, critical, tolerance, iterations
        )
        for j, k in sides
    ])
    for (j, k), bound in zip(sides, found):
        bounds[j, k] = bound
    return bounds


def _crossing(excess, guess: float, at_zero: float):
    """Positive root of an increasing function, by bracketed secant steps."""
    low, f_low = 0.0, at_zero
    high = guess
    f_high = yield from excess(high)
    for _ in range(8):
        if f_high >= 0:
            break
        low, f_low, high = high, f_high, high * 2
        f_high = yield from excess(high)
    if not f_high >= 0:
        return None
    side = 0
    for _ in range(80):
        middle = (low * f_high - high * f_low) / (f_high - f_low)
        f_middle = yield from excess(middle)
        if abs(f_middle) < 1e-11 or high - low < 1e-12 * max(1.0, high):
            return middle
        if f_middle > 0:
            high, f_high = middle, f_middle
            if side == 1:
                f_low /= 2
            side = 1
        else:
            low, f_low = middle, f_middle
            if side == -1:
                f_high /= 2
            side = -1
    return middle
