"""Properties of the physical plans."""

import os
import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plan(df):
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture
def plan_of(spark):
    return lambda name: plan(entry.queries()[name](spark, FOLDER))


@pytest.mark.parametrize("name", [
    "symptom_profile", "prevalence_ci", "prevalence_ci_by_group", "stack_ci_offset",
    "crosstab_row_share",
])
def test_one_scan_and_partial_aggregation(plan_of, name):
    text = plan_of(name)
    assert text.count("FileScan") == 1
    assert "partial_count" in text


def test_univariable_tables_share_one_scan(plan_of):
    text = plan_of("stack_tables")
    assert text.count("FileScan parquet [c_custkey") == 1
    assert text.count("Expand") == 1


def test_totals_come_from_the_grouped_counts(spark, plan_of):
    """Without adaptive execution reuse shows before the run: each table is read once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_of("stat_denominator")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert text.count("FileScan") == 2  # customers and orders
    assert "ReusedExchange" in text


@pytest.mark.parametrize("name", ["survival_table", "lead_transition"])
def test_rows_are_reduced_before_the_person_shuffle(plan_of, name):
    text = plan_of(name)
    by_person = [
        m for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
        if m.startswith("pseudoID")
    ]
    # One shuffle by person and date, behind a map-side limit, and one by person.
    assert len(by_person) == 2
    first_exchange = text.rindex("Exchange hashpartitioning(pseudoID")
    assert "Partial" in text[first_exchange:]


@pytest.mark.parametrize("name", [
    "survival_table", "symptom_profile", "rolling_mean_centered", "quantile_summary",
    "univariable_table", "prevalence_ci", "episodes_per_person",
])
def test_no_cartesian_product_and_no_single_partition_window(plan_of, name):
    text = plan_of(name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    for window in re.findall(r"Window \[.*", text):
        assert not window.rstrip().endswith("], [], []")


@pytest.mark.parametrize(("name", "columns"), [
    ("monthly_positivity", {"o_orderdate", "o_orderstatus"}),
    ("freq_table", {"o_orderstatus"}),
    ("group_share", {"l_returnflag", "l_shipdate"}),
])
def test_only_needed_columns_are_read(plan_of, name, columns):
    text = plan_of(name)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == columns


def test_filter_reaches_the_scan(plan_of):
    text = plan_of("cohort_episode_join")
    assert "PushedFilters" in text


@pytest.mark.parametrize("name", [
    "recode_binary", "symptom_profile", "survival_table", "quantile_summary",
])
def test_no_python_in_the_plan(plan_of, name):
    text = plan_of(name)
    assert "Python" not in text and "InPandas" not in text
