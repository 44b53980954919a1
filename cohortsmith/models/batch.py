"""Collapsing rows to covariate patterns and running one fit per model."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsmith.models.design import (
    Cat,
    Term,
    absent_reference,
    as_categories,
    row_variables,
    variables,
)
from cohortsmith.models.large import Large, gather
from cohortsmith.session import materialize

# Covariate patterns one Python task may hold; larger models are fitted together, with
# one distributed aggregation per step of all of them.
MAX_PATTERNS = 500_000

# Tasks that share the small fits.
MAX_TASKS = 2_000


# Levels with the reference first, only the reference, or None for sorted levels.
Levels = Sequence[str] | str | None


def exposure_term(name: str, exposures: Mapping[str, Levels]) -> Cat:
    levels = exposures[name]
    if levels is None or isinstance(levels, str):
        return Cat(name, ref=levels)
    return Cat(name, tuple(levels))


def collapse(
    df: DataFrame,
    terms: Sequence[Term],
    response: Mapping[str, Column],
    sums: Mapping[str, str],
    exposures: Mapping[str, Levels] | None = None,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Count rows per model and covariate pattern, complete cases only.

    With ``exposures`` every exposure makes a model of its own; the rows are
    unpivoted so that all models come out of one aggregation.  ``response``
    names the response columns; those in ``sums`` (new name to response column)
    are summed, the others join the pattern.
    """
    keys = [*strata, *[v.name for v in variables(terms)]]
    shared = [
        *[F.col(s) for s in strata],
        *row_variables(df, terms),
        *[c.alias(n) for n, c in response.items()],
    ]

    def count(rows: DataFrame, *more: str) -> DataFrame:
        grouping = [*keys, *more, *[r for r in response if r not in sums.values()]]
        return (
            rows.dropna(subset=[*keys, *more, *response])
            .groupBy(*grouping)
            .agg(
                F.count("*").alias("n"),
                *[F.sum(source).alias(name) for name, source in sums.items()],
            )
        )

    if exposures is None:
        counts = count(df.select(*shared)).withColumn("model", F.lit("model"))
        return as_categories(counts, terms)

    def per_exposure(answers: Mapping[str, Column], text) -> DataFrame:
        short = {f"_{i}": e for i, e in enumerate(answers)}
        rows = df.select(
            *shared, *[answers[e].alias(s) for s, e in short.items()]
        ).unpivot([*keys, *response], list(short), "model", "exposure")
        full_name = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
        counts = count(rows, "model", "exposure")
        counts = counts.withColumn("model", full_name[F.col("model")])
        return counts.withColumn("exposure", text(F.col("model"), F.col("exposure")))

    # Listed levels travel as their position, which is cheap to group by.
    own = {e: exposure_term(e, exposures) for e in exposures}
    listed = {e: t.levels for e, t in own.items() if t.levels is not None}
    kinds = dict(df.dtypes)

    def level_of(model: Column, position: Column) -> Column:
        levels = F.create_map(*[
            x for e, found in listed.items()
            for x in (F.lit(e), F.array(*[F.lit(v) for v in found]))
        ])
        return F.get(levels[model], position)

    parts = []
    if listed:
        positions = {
            e: _position(F.col(e), levels, kinds[e]) for e, levels in listed.items()
        }
        parts.append(per_exposure(positions, level_of))
    if len(listed) < len(own):
        texts = {e: F.col(e).cast("string") for e in own if e not in listed}
        parts.append(per_exposure(texts, lambda model, value: value))
    return as_categories(reduce(DataFrame.unionByName, parts), terms)


def _position(answer: Column, levels: Sequence[str], kind: str) -> Column:
    """Position of a value among the levels, NULL for unlisted values."""
    chain = F
    for i, level in enumerate(levels):
        chain = chain.when(answer == F.lit(level).try_cast(kind), i)
    return chain


def _references(
    terms: Sequence[Term], exposures: Mapping[str, Levels] | None
) -> list[tuple[str, str, str | None, str]]:
    """Categories that only name their reference: variable, name shown, model, reference."""
    found = [
        (v.name, v.label or v.name, None, v.ref) for v in variables(terms)
        if isinstance(v, Cat) and v.levels is None and v.ref is not None
    ]
    for name in exposures or {}:
        own = exposure_term(name, exposures)
        if own.levels is None and own.ref is not None:
            found.append(("exposure", name, name, own.ref))
    return found


def run_fits(
    collapsed: DataFrame,
    terms: Sequence[Term],
    exposures: Mapping[str, Levels] | None,
    strata: Sequence[str],
    schema: str,
    fit_local: Callable[[pd.DataFrame, list[Term]], pd.DataFrame],
    fit_large: Callable[[Large], list[pd.DataFrame]],
    max_patterns: int,
) -> DataFrame:
    """Fit every model of a collapsed table.

    The patterns are written and counted when this is called.  Models of up to
    ``max_patterns`` patterns are fitted inside one grouped task each, once the result is
    used.  Larger ones are fitted at once and together: ``fit_large`` reads the
    distributed table as often as the slowest of them needs, whatever their number.
    """
    table = materialize(collapsed, "patterns")
    model_keys = ["model", *strata]
    refs = _references(terms, exposures)
    sizes = table.groupBy(*model_keys).agg(F.count("*").alias("patterns"), *[
        F.bool_or(F.col(variable) == ref).alias(f"ref_{i}")
        for i, (variable, _, _, ref) in enumerate(refs)
    ])
    too_large = F.col("patterns") > max_patterns

    def mine(model):
        return F.lit(True) if model is None else F.col("model") == model

    counted = sizes.agg(
        F.count("*"), F.count_if(too_large),
        *[F.bool_or(F.when(mine(model), F.col(f"ref_{i}")))
          for i, (_, _, model, _) in enumerate(refs)],
    ).first()
    n_models, n_large = counted[0], counted[1]
    for (_, shown, _, ref), there in zip(refs, counted[2:]):
        if there is False:  # NULL: there are no rows
            raise absent_reference(shown, ref)
    # At most the table's size divided by max_patterns.
    large = sizes.where(too_large).select(*model_keys, "patterns").orderBy(
        *model_keys
    ).collect() if n_large else []

    def model_terms(model: str) -> list[Term]:
        if exposures is None:
            return list(terms)
        own = exposure_term(model, exposures)
        return [replace(own, name="exposure", label=model), *terms]

    spark = table.sparkSession
    fields = f"model string, {''.join(f'{s} string, ' for s in strata)}{schema}"
    n_small = n_models - n_large

    def with_keys(out: pd.DataFrame, key: Sequence) -> pd.DataFrame:
        for position, name in enumerate(model_keys):
            value = key[position]
            out.insert(position, name, None if value is None else str(value))
        return out

    parts = []
    if n_small or not large:
        of_small = table
        if large:
            names = spark.createDataFrame(
                [tuple(row)[:-1] for row in large],
                ", ".join(f"large_{k} {dict(table.dtypes)[k]}" for k in model_keys),
            )
            same = reduce(lambda a, b: a & b, [
                F.col(k).eqNullSafe(F.col(f"large_{k}")) for k in model_keys
            ])
            of_small = table.join(F.broadcast(names), same, "left_anti")

        def fit(key, patterns):
            return with_keys(fit_local(patterns, model_terms(key[0])), key)

        parts.append(
            of_small.repartition(min(max(n_small, 1), MAX_TASKS), *model_keys)
            .groupBy(*model_keys)
            .applyInPandas(fit, fields)
        )
    if large:
        gathered = gather(
            table, model_keys, [(tuple(row)[:-1], row["patterns"]) for row in large],
            model_terms,
        )
        found = [
            with_keys(out, key) for key, out in zip(gathered.keys, fit_large(gathered))
        ]
        parts.append(spark.createDataFrame(pd.concat(found, ignore_index=True), fields))
    return reduce(DataFrame.unionByName, parts)
