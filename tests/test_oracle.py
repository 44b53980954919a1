"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

# Some category has nobody in the smallest tables, so that its effect does not exist.
LARGER = {"sero_cox_health": "/root/testdata/sf0.01"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    folder = LARGER.get(name, FOLDER)
    df = entry.queries()[name](spark, folder)
    tables = con if folder == FOLDER else connect(folder)
    assert differences(df, tables, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, adjusted", [
    ("model_batch_adjusted", True), ("profile_ci", False), ("logistic_stratified", True),
])
def test_every_term_of_the_fits_is_there(spark, name, adjusted):
    fits = entry.queries()[f"{name}_terms"](spark, FOLDER)
    assert {"estimate", "std_error", "p_value", "n_obs", "converged"} <= set(fits.columns)
    terms = [(r["model"], r["term"]) for r in fits.select("model", "term").collect()]
    own = {r["model"] for r in entry.queries()[name](spark, FOLDER).select("model").collect()}
    for model in own:
        found = {term for m, term in terms if m == model}
        assert {"(Intercept)", f"{model}=1"} <= found
        assert any(term.startswith("agegr10=") for term in found) == adjusted


def test_date_spine_covers_every_result(spark):
    got = entry.queries()["date_spine"](spark, FOLDER)
    assert got.columns == ["testresult", "date"]
    days = {r["date"] for r in entry.queries()["calendar_days"](spark, FOLDER).collect()}
    by_result = {}
    for row in got.collect():
        by_result.setdefault(row["testresult"], []).append(row["date"])
    assert set(by_result) == {"negative", "positive"}
    for dates in by_result.values():
        assert len(dates) == len(days) and set(dates) == days
