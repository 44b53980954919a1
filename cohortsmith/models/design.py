"""Model terms and treatment-contrast design columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortsmith.session import materialize

# Levels that become columns of a design matrix, over all its categories.
MAX_LEVELS = 1_000


@dataclass(frozen=True)
class Cat:
    """Categorical variable; the first level is the reference.

    Without ``levels`` the sorted values present in the data are used, with
    ``ref``, if given, moved to the front.  A fit whose rows lack ``ref`` starts with
    the first level it has; a ``ref`` that no row of any fit has is an error, and so is
    one that is not among ``levels``.
    """

    name: str
    levels: tuple[str, ...] | None = None
    ref: str | None = None
    label: str | None = None

    def with_levels(self, present: Sequence[str]) -> Cat:
        levels = sorted(present) if self.levels is None else list(self.levels)
        if self.ref in levels:
            levels = [self.ref, *(v for v in levels if v != self.ref)]
        elif self.ref is not None and self.levels is not None:
            raise absent_reference(self.label or self.name, self.ref)
        return replace(self, levels=tuple(levels))


@dataclass(frozen=True)
class Num:
    """Numeric variable, used as it is."""

    name: str
    label: str | None = None


@dataclass(frozen=True)
class Inter:
    """Products of the design columns of two terms."""

    left: Cat | Num
    right: Cat | Num


Term = Cat | Num | Inter


def absent_reference(name: str, ref: str) -> ValueError:
    return ValueError(f"the reference {ref!r} is no value of {name!r}")


def variables(terms: Sequence[Term]) -> list[Cat | Num]:
    """The distinct variables the terms use."""
    found: dict[str, Cat | Num] = {}
    for term in terms:
        for part in (term.left, term.right) if isinstance(term, Inter) else (term,):
            found.setdefault(part.name, part)
    return list(found.values())


def own_names(df: DataFrame, terms: Sequence[Term]) -> tuple[DataFrame, list[Term]]:
    """The variables as new columns whose names no count or key of a fit can clash with.

    Labels keep the names the caller knows.
    """
    new = {v.name: f"variable_{v.name}" for v in variables(terms)}

    def renamed(part):
        return replace(part, name=new[part.name], label=part.label or part.name)

    return df.withColumns({new[n]: F.col(n) for n in new}) if new else df, [
        Inter(renamed(t.left), renamed(t.right)) if isinstance(t, Inter) else renamed(t)
        for t in terms
    ]


def resolve(terms: Sequence[Term], present: dict[str, Sequence[str]]) -> list[Term]:
    """Fix the levels of all categorical terms."""

    def fixed(part):
        if isinstance(part, Cat):
            return part.with_levels(present.get(part.name, ()))
        return part

    return [
        Inter(fixed(t.left), fixed(t.right)) if isinstance(t, Inter) else fixed(t)
        for t in terms
    ]


def expand(terms: Sequence[Term], indicator, number) -> list[tuple[str, object]]:
    """Labels and design columns of resolved terms, built by the two callbacks."""

    def columns(part):
        shown = part.label or part.name
        if isinstance(part, Num):
            return [(shown, number(part))]
        return [(f"{shown}={v}", indicator(part, v)) for v in part.levels[1:]]

    out = []
    for term in terms:
        if isinstance(term, Inter):
            out += [
                (f"{a}:{b}", x * y)
                for a, x in columns(term.left)
                for b, y in columns(term.right)
            ]
        else:
            out += columns(term)
    return out


def labels_of(terms: Sequence[Term]) -> list[str]:
    """Labels of the design columns of resolved terms."""
    return [label for label, _ in expand(terms, lambda part, level: 1, lambda part: 1)]


def local_design(
    patterns: pd.DataFrame, terms: Sequence[Term]
) -> tuple[list[str], np.ndarray]:
    """Design columns of a small table of covariate patterns."""
    present = {
        v.name: patterns[v.name].unique()
        for v in variables(terms)
        if isinstance(v, Cat)
    }
    pairs = expand(
        resolve(terms, present),
        lambda part, level: (patterns[part.name] == level).to_numpy(float),
        lambda part: patterns[part.name].to_numpy(float),
    )
    if not pairs:
        return [], np.empty((len(patterns), 0))
    return [p[0] for p in pairs], np.column_stack([p[1] for p in pairs])


def spark_design(terms: Sequence[Term]) -> list[tuple[str, Column]]:
    """Design columns of resolved terms as Spark expressions."""
    return expand(
        terms,
        lambda part, level: (F.col(part.name) == level).cast("double"),
        lambda part: F.col(part.name).cast("double"),
    )


def _listed(text: Column, levels: Sequence[str] | None) -> Column:
    return text if levels is None else F.when(text.isin(*levels), text)


def row_variables(df: DataFrame, terms: Sequence[Term]) -> list[Column]:
    """The variables as grouping keys; unlisted text becomes NULL.

    Numbers and flags used as categories keep their type: they are cheaper to
    group by and ``as_categories`` turns the few counted rows into text.
    """
    kinds = dict(df.dtypes)
    out = []
    for v in variables(terms):
        key = F.col(v.name)
        if isinstance(v, Num):
            key = key.cast("double")
        elif kinds[v.name] == "string":
            key = _listed(key, v.levels)
        out.append(key.alias(v.name))
    return out


def as_categories(counts: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """Categorical variables of counted rows as text, listed levels only."""
    categories = [v for v in variables(terms) if isinstance(v, Cat)]
    return counts.withColumns({
        v.name: _listed(F.col(v.name).cast("string"), v.levels) for v in categories
    }).dropna(subset=[v.name for v in categories])


def _complete(df: DataFrame, terms: Sequence[Term], keep: Sequence[str]) -> DataFrame:
    """Complete cases with the variables under names no kept column can have."""
    kept = [F.col(k).alias(f"kept_{i}") for i, k in enumerate(keep)]
    own, renamed = own_names(df, terms)
    names = [v.name for v in variables(renamed)]
    rows = own.select(*kept, *row_variables(own, renamed)).dropna(subset=names)
    return as_categories(rows, renamed)


def _open_categories(terms: Sequence[Term]) -> list[Cat]:
    return [v for v in variables(terms) if isinstance(v, Cat) and v.levels is None]


def level_dictionary(df: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """``variable, level``: the values complete cases have in categories without levels.

    The dictionary is a table like any other; no category's values have to fit one task.
    """
    rows = _complete(df, terms, ())
    names = {f"variable_{c.name}": c.name for c in _open_categories(terms)}
    if not names:
        return df.sparkSession.createDataFrame([], "variable string, level string")
    shown = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return (
        rows.select(*names).unpivot([], list(names), "variable", "level").distinct()
        .select(shown[F.col("variable")].alias("variable"), "level")
    )


def design_matrix(
    df: DataFrame, terms: Sequence[Term], *keep: str, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Complete cases with one column per design column.

    Levels that terms leave open are read from the data first.  More than ``max_levels``
    of them are an error: ``sparse_design`` has rows instead of columns.
    """
    open_terms = _open_categories(terms)
    present: dict[str, list[str]] = {}
    if open_terms:
        found = level_dictionary(df, terms).limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise ValueError(f"more than {max_levels} levels: use sparse_design")
        for row in found:
            present.setdefault(row["variable"], []).append(row["level"])
        for part in open_terms:
            if found and part.ref is not None and part.ref not in present.get(part.name, ()):
                raise absent_reference(part.name, part.ref)
    _, renamed = own_names(df, resolve(terms, present))
    complete = _complete(df, terms, keep)
    return complete.select(
        *[F.col(f"kept_{i}").alias(k) for i, k in enumerate(keep)],
        *[c.alias(label) for label, c in spark_design(renamed)],
    )


def _numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``place`` of every row from 0 on inside its group, without a group in one task.

    The rows are written in order; a row's place is its place in its part of the table
    plus the rows of the group in earlier parts.
    """
    written = materialize(
        rows.orderBy(by, order).withColumn("row", F.monotonically_increasing_id()), "levels"
    ).withColumn("part", F.shiftright("row", 33))
    parts = written.groupBy(by, "part").agg(
        F.count("*").alias("n"), F.min("row").alias("first")
    )
    before = Window.partitionBy(by).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = parts.select(
        F.col(by).alias("of"), F.col("part").alias("of_part"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    return written.join(
        shifts, (F.col(by) == F.col("of")) & (F.col("part") == F.col("of_part"))
    ).select(*rows.columns, (F.col("row") + F.col("shift")).alias("place"))


def sparse_design(
    df: DataFrame, terms: Sequence[Term], *keep: str
) -> tuple[DataFrame, DataFrame]:
    """The design in rows: entries ``(keep..., column, value)`` and ``(column, label)``.

    Only values other than zero are listed, at most one per row and term, so that a
    category may have any number of levels.  Columns are numbered as the terms stand,
    levels sorted behind the reference.  Of products only the columns that occur have
    a label.  Rows without an entry are those at zero throughout.
    """
    given = [
        (c, v, i) for c in {x.name: x for x in variables(terms) if isinstance(x, Cat)}.values()
        if c.levels is not None for i, v in enumerate(c.with_levels(()).levels)
    ]
    spark = df.sparkSession
    counted = spark.createDataFrame(
        [(c.name, v, i) for c, v, i in given], "variable string, level string, place long"
    )
    refs = {c.name: c.ref for c in _open_categories(terms) if c.ref is not None}
    present = _numbered(level_dictionary(df, terms), "variable", "level")
    if refs:
        chosen = spark.createDataFrame(list(refs.items()), "name string, ref string")
        at = present.join(
            F.broadcast(chosen), (F.col("variable") == F.col("name")) & (F.col("level") == F.col("ref"))
        ).select("variable", "place").collect()
        found = {r["variable"]: r["place"] for r in at}
        for name, ref in refs.items():
            if name not in found:
                raise absent_reference(name, ref)
        # The reference comes first, the levels before it move up by one.
        where = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])[F.col("variable")]
        present = present.withColumn("place", (
            F.when(F.col("place") == where, 0)
            .when(F.col("place") < where, F.col("place") + 1)
            .otherwise(F.col("place"))
        ).cast("long"))
    levels = materialize(counted.unionByName(present), "levels")
    sizes = {
        r["variable"]: r["count"] for r in levels.groupBy("variable").count().collect()
    }
    rows = _complete(df, terms, keep)
    kept = [f"kept_{i}" for i in range(len(keep))]
    for i, part in enumerate(variables(terms)):
        name = f"variable_{part.name}"
        if isinstance(part, Num):
            rows = rows.withColumn(f"value_{i}", F.col(name)).withColumn(
                f"code_{i}", F.lit(0).cast("long")
            ).withColumn(f"label_{i}", F.lit(part.label or part.name))
            continue
        own = levels.where(F.col("variable") == part.name).select(
            F.col("level").alias("own_level"), (F.col("place") - 1).alias(f"code_{i}")
        )
        rows = rows.join(own, F.col(name) == F.col("own_level"), "left").drop("own_level")
        rows = rows.withColumn(
            f"value_{i}", F.when(F.col(f"code_{i}") >= 0, 1.0)
        ).withColumn(f"label_{i}", F.concat(F.lit(f"{part.label or part.name}="), F.col(name)))
    number = {v.name: i for i, v in enumerate(variables(terms))}

    def width(part):
        return 1 if isinstance(part, Num) else max(sizes.get(part.name, 0) - 1, 0)

    entries, first = [], 0
    for term in terms:
        parts = (term.left, term.right) if isinstance(term, Inter) else (term,)
        code, value, label = F.lit(0).cast("long"), F.lit(1.0), []
        for part in parts:
            i = number[part.name]
            code = code * width(part) + F.col(f"code_{i}")
            value = value * F.col(f"value_{i}")
            label.append(F.col(f"label_{i}"))
        entries.append(F.struct(
            (code + first).alias("column"), value.alias("value"),
            F.concat_ws(":", *label).alias("label"),
        ))
        first += int(np.prod([width(part) for part in parts]))
    listed = rows.select(*kept, F.explode(F.array(*entries)).alias("entry")).where(
        "entry.value <> 0"
    )
    matrix = listed.select(
        *[F.col(f"kept_{i}").alias(k) for i, k in enumerate(keep)],
        "entry.column", "entry.value",
    )
    return matrix, listed.select("entry.column", "entry.label").distinct()
