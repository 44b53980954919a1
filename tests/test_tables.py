"""Counts, shares and joins on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cohortsmith.operators import filters
from cohortsmith.operators import frequencies as freq
from cohortsmith.operators.frequencies import Exposure
from cohortsmith.operators.joins import cohort_episode_join


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [
            ("a", "M", "adult", 1), ("a", "F", "adult", 0), ("b", "M", "child", 1),
            (None, "F", "adult", 1), ("b", "F", "adult", 0), ("b", None, "child", 0),
        ],
        "g string, sex string, age string, event int",
    )


def test_freq_table(people, rows):
    assert rows(freq.freq_table(people, "g")) == [("a", 2), ("b", 3)]
    full = freq.freq_table(people, "g", levels=["a", "b", "c"], use_na=True)
    assert rows(full) == [(None, 1), ("a", 2), ("b", 3), ("c", 0)]


def test_na_cell_is_listed_even_when_empty(people, rows):
    assert rows(freq.freq_table(people, "age", use_na=True)) == [
        (None, 0), ("adult", 4), ("child", 2)
    ]


def test_freq_share(people, rows):
    assert rows(freq.freq_share(people, "g")) == [("a", 2, 40.0), ("b", 3, 60.0)]


def test_crosstab_shares_add_up(people):
    for share, by in (
        (freq.crosstab_row_share, "g"), (freq.crosstab_col_share, "sex")
    ):
        table = share(people, "g", "sex")
        for r in table.groupBy(by).agg(F.sum("pct").alias("s")).collect():
            assert r["s"] == pytest.approx(100)


def test_crosstab_lists_empty_cells(people, rows):
    table = freq.crosstab(people, "g", "sex", ["a", "b"], ["F", "M"], use_na=True)
    assert rows(table) == [
        (None, None, 0), (None, "F", 1), (None, "M", 0), ("a", None, 0),
        ("a", "F", 1), ("a", "M", 1), ("b", None, 1), ("b", "F", 1), ("b", "M", 1),
    ]


def test_symptom_profile(spark, rows):
    df = spark.createDataFrame(
        [("Sim", "Sim", "p"), ("Não", None, "p"), ("Sim", "Não", "n"), (None, "Sim", "n")],
        "fever string, cough string, result string",
    )
    got = rows(freq.symptom_profile(df, ["fever", "cough"], "result"))
    assert ("cough", None, "p", 1, None) in got
    assert ("fever", "Sim", "p", 1, 50.0) in got
    assert ("fever", "Sim", "n", 1, 100.0) in got
    assert sum(r[3] for r in got) == 8


def test_univariable_denominators(people, rows):
    def table(mode, **options):
        return rows(
            freq.univariable_table(
                people, [Exposure("g", mode, **options)], "event",
                scope=F.col("age") == "adult",
            ).drop("variable")
        )

    third, two_thirds = pytest.approx(100 / 3), pytest.approx(200 / 3)
    assert table("keep_null") == [
        (None, 1, 20.0, 1, third), ("a", 2, 40.0, 1, third), ("b", 3, 60.0, 1, third)
    ]
    assert table("all_rows") == [
        (None, 1, pytest.approx(100 / 6), 1, third), ("a", 2, third, 1, third),
        ("b", 3, 50.0, 1, third),
    ]
    assert table("known_only") == [("a", 2, 40.0, 1, 50.0), ("b", 3, 60.0, 1, 50.0)]
    assert table("known_only", scoped=True) == [
        ("a", 2, two_thirds, 1, 100.0), ("b", 1, third, 0, 0.0)
    ]


def test_univariable_totals_equal_row_count(people):
    table = freq.univariable_table(
        people, [Exposure(v, "all_rows") for v in ("g", "sex", "age")], "event"
    )
    sums = table.groupBy("variable").agg(F.sum("total").alias("n")).collect()
    assert {r["n"] for r in sums} == {6} and len(sums) == 3


def test_group_size_and_distinct(people, rows):
    assert rows(freq.group_size_mean(people, "g")) == [(3, 2.0)]
    assert rows(freq.distinct_count(people, "g")) == [(3,)]


def test_ever_positive(spark, rows):
    df = spark.createDataFrame(
        [(1, "pos"), (1, "neg"), (2, "neg"), (3, None), (4, "pos vacc")],
        "id int, result string",
    )
    got = freq.ever_positive_pct(
        df, "id",
        {"any": F.col("result").contains("pos"), "infected": F.col("result") == "pos"},
    )
    assert rows(got) == [(4, 2, 1, 50.0, 25.0)]


def test_filters(spark, rows):
    df = spark.createDataFrame(
        [(1, "Sim"), (2, "Não"), (3, None)], "id int, vacinated string"
    )
    assert rows(filters.unvaccinated(df, "vacinated", "Sim"), "id") == [(2,), (3,)]
    assert rows(filters.drop_category(df, "vacinated", "Sim"), "id") == [(2,)]


def test_display_rounding_is_half_even(spark, rows):
    df = spark.createDataFrame([("a", 0.125, 3), ("b", 0.375, 4)], "k string, x double, n int")
    assert rows(filters.round_numeric(df, 2)) == [("a", 0.12, 3), ("b", 0.38, 4)]


def test_full_outer_join_with_unknown_keys(spark, rows):
    cohort = spark.createDataFrame([(1, 30), (1, 31), (2, 40), (None, 50)], "id int, age int")
    episodes = spark.createDataFrame(
        [(1, 3), (7, 2), (None, 9)], "person int, n_episodes int"
    )
    got = cohort_episode_join(cohort, "id", episodes, "person")
    expected = [
        (None, 50, 9), (1, 30, 3), (1, 31, 3), (2, 40, None), (7, None, 2)
    ]
    assert rows(got, "id", "age", "n_episodes") == expected
    no_unknown = cohort_episode_join(
        cohort, "id", episodes.where("person IS NOT NULL"), "person"
    )
    assert (None, 50, None) in rows(no_unknown, "id", "age", "n_episodes")


def test_results_do_not_depend_on_partitioning(people, rows):
    one = rows(freq.symptom_profile(people.coalesce(1), ["g", "sex"], "age"))
    many = rows(freq.symptom_profile(people.repartition(5), ["g", "sex"], "age"))
    assert one == many


def test_shares_of_many_values_use_no_window(spark):
    from cohortsmith.operators.frequencies import crosstab_col_share

    df = spark.range(1_000_000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("col"))
    got = crosstab_col_share(df, "row", "col", use_na=True)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    sums = {r["col"]: (r["n"], r["s"]) for r in got.groupBy("col").agg(
        F.count("*").alias("n"), F.sum("pct").alias("s")).collect()}
    assert {k: v[0] for k, v in sums.items()} == {None: 333_334, 0: 333_333, 1: 333_333}
    assert all(abs(v[1] - 100) < 1e-6 for v in sums.values())


def test_shares_of_totals_over_different_rows(spark, rows):
    df = spark.createDataFrame(
        [("a", 1), ("a", 0), ("a", None), ("b", 1), (None, 1), (None, 1)], "g string, e int"
    )
    assert rows(freq.stat_denominator(df, "g", "e")) == [
        ("a", 3, 75.0, 1, 25.0), ("b", 1, 25.0, 1, 25.0)
    ]
    assert rows(freq.stat_denominator(df.where("g = 'a' AND e IS NULL"), "g", "e")) == [
        ("a", 1, 100.0, None, None)
    ]
    assert rows(freq.stat_denominator(df.where("g IS NULL"), "g", "e")) == []
    assert rows(freq.stat_denominator(df.where("false"), "g", "e")) == []
