"""Sums over tied events.

For ``d`` events at one time with risk-set sum ``s`` and event sum ``e`` the
Efron likelihood runs over ``c_l = 1 / (s - (l / d) * e)`` for l = 0 .. d - 1.
With a day-wise calendar and many persons ``d`` is large, so long runs are
summed by the Euler-Maclaurin formula instead of term by term.
"""

from __future__ import annotations

import numpy as np

DIRECT = 48  # terms next to the end of a run that are always added one by one


def _head(first: np.ndarray, count: np.ndarray):
    """Sums of ln(y), 1/y and 1/y^2 over y = first, first - 1, ... (count terms)."""
    y0, m = first, count
    y1 = y0 - m
    shrink = np.log1p(-m / y0)
    logs = (
        m * np.log(y0) - y1 * shrink - m
        - shrink / 2
        + (1 / y0 - 1 / y1) / 12
        - (2 / y0**3 - 2 / y1**3) / 720
        + (24 / y0**5 - 24 / y1**5) / 30240
    )
    ones = (
        -shrink
        + (1 / y0 - 1 / y1) / 2
        + (1 / y1**2 - 1 / y0**2) / 12
        - (6 / y1**4 - 6 / y0**4) / 720
        + (120 / y1**6 - 120 / y0**6) / 30240
    )
    squares = (
        m / (y0 * y1)
        + (1 / y0**2 - 1 / y1**2) / 2
        + (2 / y1**3 - 2 / y0**3) / 12
        - (24 / y1**5 - 24 / y0**5) / 720
        + (720 / y1**7 - 720 / y0**7) / 30240
    )
    return logs, ones, squares


def tie_sums(s: np.ndarray, e: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums over l of ln(1/c), c, f*c, c^2, f*c^2 and f^2*c^2 with f = l / d."""
    s, e, d = (np.asarray(v, float) for v in (s, e, d))
    out = [np.zeros_like(s) for _ in range(6)]

    def add(l, mask):
        f = l / d[mask]
        rest = s[mask] - f * e[mask]
        c = 1 / rest
        for total, term in zip(out, (np.log(rest), c, f * c, c * c, f * c * c,
                                     f * f * c * c)):
            total[mask] += term

    head = np.maximum(d - DIRECT, 0)
    for step in range(DIRECT):
        l = head + step
        mask = l < d
        if not mask.any():
            break
        add(l[mask], mask)
    long = head > 0
    if long.any():
        m, unit = head[long], e[long] / d[long]
        a = s[long] / unit
        logs, ones, squares = _head(a, m)
        out[0][long] += m * np.log(unit) + logs
        out[1][long] += ones / unit
        out[2][long] += (a * ones - m) / unit / d[long]
        out[3][long] += squares / unit**2
        out[4][long] += (a * squares - ones) / unit**2 / d[long]
        out[5][long] += (m - 2 * a * ones + a * a * squares) / unit**2 / d[long] ** 2
    return tuple(out)
