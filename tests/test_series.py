"""Quantiles, series and rates."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortsmith.operators import rates, series
from cohortsmith.operators.quantiles import quantile_summary
from cohortsmith.sources import date_spine

PROBS = (0.5, 0.25, 0.75)


@pytest.fixture(scope="module")
def measures():
    rng = np.random.default_rng(11)
    hot = rng.normal(0, 5, 2000)
    return {
        "hot": hot.tolist(), "tied": [1.0, 1.0, 2.0, 2.0, 2.0, 9.0],
        "one": [4.0], "skewed": rng.lognormal(0, 3, 301).tolist(),
        None: rng.integers(0, 5, 97).astype(float).tolist(),
    }


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 50])
def test_quantiles(spark, measures, rows_per_bucket):
    data = [(g, v) for g, vs in measures.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    got = quantile_summary(
        df, "v", ["g"], mean=True, rows_per_bucket=rows_per_bucket
    ).collect()
    assert {r["g"] for r in got} == set(measures)
    for r in got:
        expected = np.quantile(measures[r["g"]], PROBS)
        assert (r["median"], r["q25"], r["q75"]) == pytest.approx(tuple(expected), rel=1e-12)
        assert r["mean"] == pytest.approx(np.mean(measures[r["g"]]), rel=1e-9)


def test_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert tuple(quantile_summary(df, "v").first()) == (4.5, 2.25, 6.75)


def test_date_spine(spark):
    days = [r["date"] for r in date_spine(spark, "2021-02-27", "2021-03-01").collect()]
    assert days == [date(2021, 2, 27), date(2021, 2, 28), date(2021, 3, 1)]


def test_spine_and_moving_average(spark):
    start = date(2021, 1, 1)
    counts = {0: 7, 1: 1, 3: 4, 4: 2, 8: 14, 40: 99}
    daily = spark.createDataFrame(
        [("p", start + timedelta(d), n) for d, n in counts.items()]
        + [("n", start, 1)],
        "result string, date date, ntotal int",
    )
    spined = series.spine_join(daily, "result", start, start + timedelta(8))
    got = (
        series.rolling_mean_centered(spined, "result")
        .where("result = 'p'").orderBy("date").collect()
    )
    assert [r["ntotal"] for r in got] == [7, 1, 0, 4, 2, 0, 0, 0, 14]
    assert [r["ma"] for r in got] == [
        None, None, None, 2.0, 1.0, pytest.approx(20 / 7), None, None, None
    ]
    assert spined.where("result = 'n'").count() == 9


@pytest.mark.parametrize("width", [3, 4])
def test_moving_average_width(spark, width):
    start = date(2021, 1, 1)
    df = spark.createDataFrame(
        [("p", start + timedelta(d), d) for d in range(6)],
        "result string, date date, ntotal int",
    )
    got = series.rolling_mean_centered(df, "result", width=width).orderBy("date")
    assert [r["ma"] for r in got.collect() if r["ma"] is not None] == [
        float(np.mean(range(i, i + width))) for i in range(6 - width + 1)
    ]


def test_histogram(spark, rows):
    df = spark.createDataFrame(
        [("a", 0.0), ("a", 10.0), ("b", 9.9), ("b", 5.0), ("b", None)], "f string, v double"
    )
    assert rows(series.histogram(df, "v", "f", bins=2)) == [
        ("a", 0, 1, 0.0), ("a", 1, 1, 5.0), ("b", 1, 2, 5.0)
    ]
    same = df.select("f", F.lit(3.0).alias("v"))
    assert rows(series.histogram(same, "v", "f", bins=2), "f", "bin", "n") == [
        ("a", 0, 2), ("b", 0, 3)
    ]


def test_weekly_curve(spark, rows):
    df = spark.createDataFrame(
        [("2021-03-01", "p"), ("2021-03-07", "p"), ("2021-03-08", None)],
        "d string, r string",
    ).withColumn("d", F.col("d").cast("date"))
    assert rows(series.epicurve_weekly(df, "d", "r")) == [
        (date(2021, 3, 1), "p", 2), (date(2021, 3, 8), None, 1)
    ]


def test_incidence_rate(spark):
    df = spark.createDataFrame([(6.0, 1), (18.0, 0), (24.0, 1)], "time double, event int")
    r = rates.incidence_rate(df, "time", "event").first()
    assert (r["events"], r["person_years"], r["rate"]) == (2, 4.0, 0.5)
    assert r["ci_high"] == pytest.approx(0.5 + 1.959963984540054 * (0.25 / 4) ** 0.5)
    per = rates.incidence_rate(df, "time", "event", per=1000).first()
    assert per["rate"] == 500.0
    high = rates.incidence_rate(df.where("event = 1"), "time", "event", units_per_year=30)
    assert high.first()["ci_low"] is None


def test_rate_without_time(spark):
    df = spark.createDataFrame([(0.0, 1)], "time double, event int")
    assert rates.incidence_rate(df, "time", "event").first()["rate"] is None


def test_stacked_intervals(spark):
    counts = {"positive after vaccination": 2, "positive after infection": 30, "negative": 137}
    data = [("2021-03", "18-49 years", r) for r, n in counts.items() for _ in range(n)]
    data += [("2021-07", "18-49 years", "positive after infection")]
    data += [("2021-07", "18-49 years", "negative")] * 40
    df = spark.createDataFrame(data, "month string, agegr string, result string")
    by = ["agegr", "month"]
    plain = rates.prevalence_ci(df, "result", by)
    got = rates.stack_ci_offset(
        plain, "result", by, "positive after infection", "positive after vaccination"
    )
    before = {(r["month"], r["result"]): r for r in plain.collect()}
    after = {(r["month"], r["result"]): r for r in got.collect()}
    key = ("2021-03", "positive after infection")
    assert after[key]["ci_low"] - before[key]["ci_low"] == pytest.approx(0.01183432, abs=1e-8)
    assert after[key]["ci_high"] - before[key]["ci_high"] == pytest.approx(0.01183432, abs=1e-8)
    assert after["2021-03", "negative"]["ci_low"] is None
    alone = ("2021-07", "positive after infection")
    assert after[alone]["ci_low"] == 0.01
    assert after[alone]["ci_high"] == before[alone]["ci_high"]


def test_shares_of_a_month_add_up(spark):
    df = spark.createDataFrame(
        [("m1", "a"), ("m1", "b"), ("m1", "b"), ("m2", "a")], "month string, result string"
    )
    got = rates.prevalence_ci(df, "result", ["month"])
    for r in got.groupBy("month").agg(F.sum("proportion").alias("p")).collect():
        assert r["p"] == pytest.approx(1)


def test_nan_is_left_out_of_quantiles_and_histogram(spark):
    from cohortsmith.operators.quantiles import quantile_summary
    from cohortsmith.operators.series import histogram

    values = [float(i) for i in range(10)] + [float("nan"), None]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    for rows_per_bucket in (1_000_000, 3):
        got = quantile_summary(df, "v", ["g"], rows_per_bucket=rows_per_bucket).first()
        assert got["median"] == 4.5
    assert histogram(df, "v", "g", 5).toPandas()["n"].tolist() == [2] * 5


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    import pytest

    from cohortsmith.sources import read_points

    (tmp_path / "a.csv").write_text("longitude,latitude,n\n1,2,3\n")
    (tmp_path / "b.csv").write_text("latitude,longitude,n\n2,1,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_points(spark, str(tmp_path)).collect()


def test_band_of_a_large_offset(spark):
    from pyspark.sql import functions as F

    from cohortsmith.models import ols

    df = spark.range(2000).select(
        (F.col("id") % 50).cast("double").alias("x"),
        (F.hash("id") % 1000 / 500.0).alias("y"),
    )
    near = ols.poly_ols(df, "x", "y", (0, 49), 5).collect()
    far = ols.poly_ols(df.withColumn("y", F.col("y") + 1e8), "x", "y", (0, 49), 5).collect()
    for a, b in zip(near, far):
        assert abs((b["conf_high"] - b["conf_low"]) - (a["conf_high"] - a["conf_low"])) < 1e-4


@pytest.mark.parametrize("margin", [0.0022, -0.2])
def test_a_sketch_that_misses_a_rank_is_made_good(spark, monkeypatch, margin):
    """With limits that hold no rank every group is ranked whole."""
    from cohortsmith.operators import quantiles

    monkeypatch.setattr(quantiles, "MARGIN", margin)
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=3000), "b": np.round(rng.normal(size=2500), 1), None: np.ones(9)}
    df = spark.createDataFrame(
        [(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double"
    ).repartition(3)
    probs, names = (0.9, 0.0, 0.5, 1.0, 0.001), ("p90", "low", "median", "high", "p01")
    got = quantiles.quantile_summary(
        df, "v", ["g"], probs, names, mean=True, rows_per_bucket=100).collect()
    assert len(got) == 3
    for r in got:
        assert [r[n] for n in names] == pytest.approx(np.quantile(values[r["g"]], probs), abs=1e-12)
        assert r["mean"] == pytest.approx(values[r["g"]].mean())


def test_quantiles_read_the_input_twice(spark, tmp_path):
    from cohortsmith.operators import quantiles

    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    df = spark.range(20_000, numPartitions=1).selectExpr("id % 3 AS g", "rand(1) AS v").mapInArrow(
        counted, "g long, v double")
    assert quantiles.quantile_summary(df, "v", ["g"]).count() == 3
    assert reads.value == 2
