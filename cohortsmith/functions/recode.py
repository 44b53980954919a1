"""Column expressions for categories and flags.

A rule whose condition is NULL does not fire, and of several rules that fire
the last one wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_match(rules: Sequence[tuple[Column, object]], default: Column) -> Column:
    if not rules:
        return default
    chain = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, value in rules[1:]:
        chain = chain.when(condition, F.lit(value))
    return chain.otherwise(default)


def overrides(
    rules: Iterable[tuple[Column, object]], base: Column | None = None
) -> Column:
    """Successive assignments: start from ``base``, the last matching rule wins."""
    default = F.lit(None) if base is None else base
    return _first_match(list(rules)[::-1], default)


def as_factor(c: Column | str, levels: Sequence[str]) -> Column:
    """Keep values listed in ``levels``; everything else becomes NULL."""
    c = _col(c)
    return F.when(c.isin(*levels), c)


def relevel(levels: Sequence[str], reference: str) -> list[str]:
    """Level list with ``reference`` moved to the front."""
    if reference not in levels:
        raise ValueError(f"reference {reference!r} is not one of {list(levels)}")
    return [reference, *(v for v in levels if v != reference)]


def level_code(c: Column | str, levels: Sequence[str]) -> Column:
    """Position of the value in ``levels``; 0 is the reference, NULL if unlisted."""
    c = _col(c)
    return _first_match(
        [(c == v, i) for i, v in enumerate(levels)], F.lit(None).cast("int")
    )


def recode_binary(
    c: Column | str, positive: Sequence[str], negative: Sequence[str]
) -> Column:
    """1 for the positive answers, 0 for the negative ones, NULL otherwise."""
    c = _col(c)
    return F.when(c.isin(*positive), 1).when(c.isin(*negative), 0)


def recode_map(
    c: Column | str, mapping: Mapping[str, object], base: Column | None = None
) -> Column:
    """Exact-value category map."""
    c = _col(c)
    return overrides([(c == k, v) for k, v in mapping.items()], base)


def recode_pattern(
    c: Column | str,
    rules: Sequence[tuple[str, object]],
    base: Column | None = None,
) -> Column:
    """Category by contained text; the last matching rule wins."""
    c = _col(c)
    return overrides([(c.contains(p), v) for p, v in rules], base)


def flag_present(c: Column | str, value: object) -> Column:
    """``value`` wherever the column is known, NULL elsewhere."""
    return F.when(_col(c).isNotNull(), F.lit(value))


def bin_numeric(
    c: Column | str,
    default: str,
    rules: Sequence[tuple[float, float, str]],
) -> Column:
    """Label open intervals ``low < x < high``; intervals may overlap, last wins."""
    c = _col(c)
    return overrides(
        [((c > low) & (c < high), label) for low, high, label in rules],
        flag_present(c, default),
    )


def threshold_flag(
    c: Column | str, cut: float, below: str = "yes", otherwise: str = "no"
) -> Column:
    """``below`` under the cut, ``otherwise`` at or above it, NULL kept."""
    c = _col(c)
    return F.when(c < cut, below).when(c >= cut, otherwise)


def any_of_flags(conditions: Sequence[Column]) -> Column:
    """1 if any condition is true; an unknown condition counts as not true."""
    known = [F.coalesce(c, F.lit(False)) for c in conditions]
    return reduce(lambda a, b: a | b, known).cast("int")


def fill_missing_category(
    c: Column | str, value: str, levels: Sequence[str] | None = None
) -> Column:
    filled = F.coalesce(_col(c), F.lit(value))
    return filled if levels is None else as_factor(filled, levels)


def event_flag(c: Column | str, value: str) -> Column:
    """1 where the column equals ``value``, 0 otherwise (also for NULL)."""
    return F.when(_col(c) == value, 1).otherwise(0)


def coalesce_cols(*cols: Column | str) -> Column:
    return F.coalesce(*map(_col, cols))


def to_number(c: Column | str) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return _col(c).try_cast("double")


def k_of_n_positive(
    cols: Sequence[Column | str],
    k: int,
    positive: str,
    negative: str,
    threshold: float = 1.0,
) -> Column:
    """``positive`` if at least ``k`` values reach the threshold.

    The result is NULL as soon as one of the values is NULL.
    """
    hits = [(_col(c) >= threshold).cast("int") for c in cols]
    total = reduce(lambda a, b: a + b, hits)
    return F.when(total >= k, positive).when(total < k, negative)


def override_vaccinated(
    result: Column,
    positive: str,
    vaccination: Column | str,
    marker: str,
    label: str,
) -> Column:
    """Relabel positives whose vaccination answer contains ``marker``."""
    return overrides(
        [((result == positive) & _col(vaccination).contains(marker), label)], result
    )


def outcome_tier(
    n_episodes: Column | str,
    n_confirmed: Column | str,
    labels: tuple[str, str, str],
) -> Column:
    """Nobody ill, ill but never confirmed, confirmed at least once."""
    none, ill, confirmed = labels
    return overrides(
        [(_col(n_episodes) > 0, ill), (_col(n_confirmed) > 0, confirmed)], F.lit(none)
    )
