"""Counts, shares and cross tables in long form.

Every table is one partial aggregation over the input; shares are then taken
over the few aggregated rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortsmith.functions.stats import safe_ratio


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def _with_empty_cells(
    counts: DataFrame, cells: list[tuple], columns: list[str]
) -> DataFrame:
    """Add the listed cells with a count of zero where they are missing."""
    schema = counts.select(*columns).schema
    empty = counts.sparkSession.createDataFrame(cells, schema)
    return (
        counts.unionByName(empty.withColumn("n", F.lit(0).cast("bigint")))
        .groupBy(*columns)
        .agg(F.sum("n").alias("n"))
    )


def freq_table(
    df: DataFrame,
    col: str,
    levels: Sequence | None = None,
    use_na: bool = False,
) -> DataFrame:
    """Rows per value.

    ``levels`` adds levels nobody has with a zero.  ``use_na`` adds a row for
    NULL, also when its count is zero; without it NULL is left out.
    """
    source = df if use_na else df.where(F.col(col).isNotNull())
    counts = source.groupBy(col).agg(F.count("*").alias("n"))
    cells = [(v,) for v in levels or ()] + ([(None,)] if use_na else [])
    return _with_empty_cells(counts, cells, [col]) if cells else counts


def freq_share(
    df: DataFrame, col: str, levels: Sequence | None = None, use_na: bool = False
) -> DataFrame:
    """Rows per value with the percentage of all counted rows."""
    counts = freq_table(df, col, levels, use_na)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", safe_ratio(F.col("n"), total) * 100)


def stat_denominator(df: DataFrame, group: str, event: str) -> DataFrame:
    """Rows and cases per known group, as shares of totals over different rows.

    Rows are shared over the rows with a known group, cases over all cases.  The totals
    are added up from the grouped counts.  The unknown group is dropped by its missing
    share: a filter on ``group`` itself would be pushed below the aggregation, which the
    totals could then not reuse, and the input would be read again for them.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(event).alias("cases"))
    known = F.col(group).isNotNull()
    totals = counts.agg(
        F.struct(
            F.sum(F.when(known, F.col("n"))).alias("n"), F.sum("cases").alias("cases")
        )
    ).scalar()
    share = safe_ratio(F.col("n"), totals["n"]) * 100
    return counts.select(
        group,
        "n",
        F.when(known, share).alias("pct"),
        "cases",
        (safe_ratio(F.col("cases"), totals["cases"]) * 100).alias("pctcases"),
    ).where(F.col("pct").isNotNull())


def crosstab(
    df: DataFrame,
    row: str,
    col: str,
    row_levels: Sequence | None = None,
    col_levels: Sequence | None = None,
    use_na: bool = False,
) -> DataFrame:
    """Rows per pair of values.  Given level lists, empty cells are listed too."""
    source = df if use_na else df.dropna(subset=[row, col])
    counts = source.groupBy(row, col).agg(F.count("*").alias("n"))
    if row_levels is None or col_levels is None:
        return counts
    na = [None] if use_na else []
    cells = [(r, c) for r in [*row_levels, *na] for c in [*col_levels, *na]]
    return _with_empty_cells(counts, cells, [row, col])


def share_within(
    counts: DataFrame, by: Sequence[str], n: str = "n", name: str = "pct", split: bool = True
) -> DataFrame:
    """Percentage of ``n`` within the groups of an already counted table.

    Totals are added up per task first and joined back, so that no group's rows have to
    meet in one task, however many there are; the exchange of the counts is reused.
    Without ``split`` the groups are known to be small and a window serves.
    """
    if not split:
        total = F.sum(n).over(Window.partitionBy(*by))
        return counts.withColumn(name, safe_ratio(F.col(n), total) * 100)
    totals = counts.groupBy(*[F.col(k).alias(f"of_{i}") for i, k in enumerate(by)]).agg(
        F.sum(n).alias("total_of_group")
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"of_{i}")) for i, k in enumerate(by)],
    )
    share = (safe_ratio(F.col(n), F.col("total_of_group")) * 100).alias(name)
    return counts.join(totals, same).select(*counts.columns, share)


def crosstab_row_share(df: DataFrame, row: str, col: str, **options) -> DataFrame:
    """Shares within each row value; a row has one cell per value of the few columns."""
    return share_within(crosstab(df, row, col, **options), [row], split=False)


def crosstab_col_share(df: DataFrame, row: str, col: str, **options) -> DataFrame:
    return share_within(crosstab(df, row, col, **options), [col])


def symptom_profile(df: DataFrame, variables: Sequence[str], by: str) -> DataFrame:
    """All variables against ``by`` in one pass over the input.

    NULL answers are counted (``value`` is NULL) but have no percentage and do
    not enter the denominator of the others.
    """
    long = df.select(by, *[F.col(v).cast("string") for v in variables]).unpivot(
        [by], list(variables), "variable", "value"
    )
    counts = long.groupBy("variable", "value", by).agg(F.count("*").alias("n"))
    both = F.col("value").isNotNull() & F.col(by).isNotNull()
    known = F.when(both, F.col("n"))
    total = F.sum(known).over(Window.partitionBy("variable", by))
    return counts.withColumn("pct", safe_ratio(known, total) * 100)


@dataclass(frozen=True)
class Exposure:
    """A variable of a univariable table.

    ``denominator`` is one of

    ``known_only``  rows with a known category, the NULL row is left out;
    ``keep_null``   as before for the rows, but the NULL row is listed and the
                    share of cases is taken over all cases;
    ``all_rows``    all rows and all cases, the NULL row is listed.

    ``scoped`` limits the variable to the rows in the table's scope.
    """

    name: str
    denominator: str = "known_only"
    scoped: bool = False


def univariable_table(
    df: DataFrame,
    variables: Sequence[Exposure | str],
    event: str,
    scope: Column | None = None,
) -> DataFrame:
    """Rows and cases per category of every variable, with both shares.

    One scan and one partial aggregation serve all variables, whatever their
    denominators.
    """
    specs = [v if isinstance(v, Exposure) else Exposure(v) for v in variables]
    in_scope = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    counts = (
        df.select(
            F.col(event).alias("event"),
            in_scope.alias("in_scope"),
            *[F.col(s.name).cast("string").alias(s.name) for s in specs],
        )
        .unpivot(["event", "in_scope"], [s.name for s in specs], "variable", "category")
        .groupBy("variable", "category", "in_scope")
        .agg(F.count("*").alias("total"), F.sum("event").alias("cases"))
    )

    def named(condition) -> Column:
        names = [s.name for s in specs if condition(s)]
        return F.col("variable").isin(*names) if names else F.lit(False)

    tallies = (
        counts.where(F.col("in_scope") | ~named(lambda s: s.scoped))
        .groupBy("variable", "category")
        .agg(F.sum("total").alias("total"), F.sum("cases").alias("cases"))
    )
    known = F.col("category").isNotNull()
    all_rows = named(lambda s: s.denominator == "all_rows")
    known_only = named(lambda s: s.denominator == "known_only")
    variable = Window.partitionBy("variable")
    rows = F.sum(F.when(known | all_rows, F.col("total"))).over(variable)
    cases = F.sum(F.when(known | ~known_only, F.col("cases"))).over(variable)
    return (
        tallies.select(
            "variable",
            "category",
            "total",
            (safe_ratio(F.col("total"), rows) * 100).alias("pcttotal"),
            "cases",
            (safe_ratio(F.col("cases"), cases) * 100).alias("pctcases"),
        )
        .where(known | ~known_only)
    )


def stack_tables(tables: Mapping[str, DataFrame], name: str = "variable") -> DataFrame:
    """Tables of equal columns below each other, labelled by their key."""
    parts = [t.withColumn(name, F.lit(k)) for k, t in tables.items()]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def group_size_mean(df: DataFrame, group: str) -> DataFrame:
    """Number of groups and their mean size; NULL is a group of its own."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("n_groups"), F.avg("size").alias("mean_size"))


def episodes_per_person(df: DataFrame, person: str, confirmed: Column) -> DataFrame:
    """Episodes and confirmed episodes of every known person."""
    return (
        df.where(F.col(person).isNotNull())
        .groupBy(person)
        .agg(
            F.count("*").alias("n_episodes"),
            F.sum(confirmed.cast("int")).alias("n_confirmed"),
        )
    )


def monthly_positivity(
    df: DataFrame, month: str, result: str, positive: str, untested: str
) -> DataFrame:
    """Tests and percentage positive per month."""
    return (
        df.where(F.col(result) != untested)
        .groupBy(month)
        .agg(
            F.count("*").alias("ntested"),
            (F.avg((F.col(result) == positive).cast("double")) * 100).alias(
                "pct_positive"
            ),
        )
    )


def monthly_counts(
    df: DataFrame, month: str, result: str, exclude: Sequence[str] = ()
) -> DataFrame:
    kept = df.where(~F.col(result).isin(*exclude)) if exclude else df
    return kept.groupBy(month, result).agg(F.count("*").alias("n"))


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    """Number of distinct values; NULL counts as one."""
    return df.select(col).distinct().agg(F.count("*").alias("n"))


def ever_positive_pct(
    df: DataFrame, person: str, conditions: Mapping[str, Column]
) -> DataFrame:
    """Persons who ever met each condition, as number and percentage.

    Collapsing to one row per person first needs a single shuffle and no
    distinct aggregates.
    """
    flags = [
        F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(k)
        for k, c in conditions.items()
    ]
    sums = [F.sum(k).alias(f"n_{k}") for k in conditions]
    totals = (
        df.groupBy(person).agg(*flags).agg(F.count("*").alias("participants"), *sums)
    )
    return totals.select(
        "*",
        *[
            (safe_ratio(F.col(f"n_{k}"), F.col("participants")) * 100).alias(f"pct_{k}")
            for k in conditions
        ],
    )


def mean_by_event(df: DataFrame, value: str, event: str) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(event)
        .agg(F.avg(value).alias("mean"))
    )
