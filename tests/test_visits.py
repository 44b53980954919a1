"""Repeated visits, with the expected survival rows worked out by hand."""

from datetime import date

import pytest

from cohortsmith.operators import visits

POS, NEG = "positive after infection", "negative"


def day(n):
    return date.fromordinal(date(2021, 1, 1).toordinal() + n)


@pytest.fixture
def sero(spark):
    data = [
        ("single", 0, 1, NEG, "x", None),
        ("first", 0, 2, POS, "x", "h1"),
        ("twice", 0, 3, NEG, None, "h1"), ("twice", 60, 4, POS, "y", "h2"),
        ("twice", 120, 5, POS, "z", None),
        ("back", 0, 6, POS, "x", "h1"), ("back", 90, 7, NEG, "x", "h2"),
        ("back", 150, 8, POS, "x", "h3"),
        ("same", 0, 9, NEG, "keep", "h1"), ("same", 0, 10, POS, "drop", "h2"),
        ("unknown", 0, 11, POS, "x", "h"), ("unknown", 30, 12, None, "x", "h"),
        ("unknown", 50, 13, NEG, "x", "h"),
    ]
    return spark.createDataFrame(
        [(p, day(d), i, r, x, h) for p, d, i, r, x, h in data],
        "id string, date date, ord int, result string, x string, hiv string",
    ).repartition(4)


@pytest.fixture
def unique(sero):
    return visits.dedupe_visits(sero, "id", "date", ["ord"])


def test_dedupe_keeps_the_first(unique, rows):
    assert unique.count() == 12
    assert rows(unique.where("id = 'same'"), "x") == [("keep",)]


def test_survival_table(unique, rows):
    table = visits.survival_table(
        unique, "id", "date", "result", POS, first=["x"], last=["hiv"]
    )
    got = {r["id"]: r for r in table.collect()}
    expected = {
        # id: event, days, surveys, first x, last hiv
        "single": (0, 90, 1, "x", None),
        "first": (1, 45, 1, "x", "h1"),
        "twice": (1, 90 + 30, 2, None, "h2"),
        "back": (1, 45 + 90 + 30, 3, "x", "h3"),
        "same": (0, 90, 1, "keep", "h1"),
        "unknown": (1, 45 + 20, 2, "x", "h"),
    }
    assert got.keys() == expected.keys()
    for person, (event, days, n, x, hiv) in expected.items():
        r = got[person]
        assert (r["event"], r["nsurveys"], r["x"], r["hiv"]) == (event, n, x, hiv), person
        assert r["time"] == pytest.approx(days / 30), person
        assert r["inclusiondate"] == day(0)


def test_stopping_at_the_first_event(unique):
    table = visits.survival_table(
        unique, "id", "date", "result", POS, stop_at_first_event=True
    )
    got = {r["id"]: (r["event"], r["time"]) for r in table.collect()}
    assert got["back"] == (1, 45 / 30)
    assert got["twice"] == (1, pytest.approx(120 / 30))
    assert got["single"] == (0, 3.0)


def test_transitions(unique, rows):
    assert rows(visits.lead_transition(unique, "id", "date", "result", POS, NEG)) == [(1,)]
    assert rows(
        visits.followed_after_positive(unique, "id", "date", "result", POS)
    ) == [(2,)]
    assert rows(
        visits.reversion_share(unique, "id", "date", "result", POS, NEG)
    ) == [(1, 2, 50.0)]


def test_intervals(unique, rows):
    timed = visits.time_since_previous(unique, "id", "date")
    assert rows(timed.where("id = 'back'"), "days") == [(60,), (90,), (90,)]
    halved = visits.half_interval_on_event(timed, "result", POS)
    assert rows(halved.where("id = 'back'"), "days") == [(30.0,), (45.0,), (90.0,)]


def test_first_and_last_keep_null(unique, rows):
    got = visits.first_last_by_date(unique, "id", "date", ["x"], ["hiv"])
    assert rows(got.where("id = 'twice'")) == [("twice", None, None)]


def test_first_per_group_takes_one_row_each(sero, rows):
    first = visits.first_per_group(sero, ["id"], ["ord"])
    assert rows(first, "ord") == [(1,), (2,), (3,), (6,), (9,), (11,)]


def test_a_person_with_most_of_the_rows(spark, rows):
    """Many raw rows of one person collapse to one row per date before windows."""
    hot = spark.range(30_000).selectExpr(
        "'hot' AS id", "date_add(DATE '2021-01-01', CAST(id % 20 AS INT)) AS date",
        "CAST(id AS INT) AS ord", f"IF(id % 20 = 7, '{POS}', '{NEG}') AS result",
    )
    others = spark.range(500).selectExpr(
        "CAST(id AS STRING) AS id", "DATE '2021-01-01' AS date", "CAST(id AS INT) AS ord",
        f"'{NEG}' AS result",
    )
    unique = visits.dedupe_visits(hot.unionByName(others), "id", "date", ["ord"])
    assert unique.count() == 520
    table = visits.survival_table(unique, "id", "date", "result", POS)
    assert rows(table.where("id = 'hot'"), "event", "time", "nsurveys") == [
        (1, pytest.approx((90 + 18 + 0.5) / 30), 20)
    ]
