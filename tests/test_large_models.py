"""Models that do not fit one task: shared passes, vector sums, sparse designs."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortsmith.models import (
    Cat,
    Inter,
    Num,
    cox_batch,
    cox_hr,
    design_matrix,
    level_dictionary,
    logistic_batch,
    logistic_or,
    sparse_design,
)
from cohortsmith.models import cox as cox_module

EXPOSURES = [f"e{i}" for i in range(6)]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 500
    marks = rng.integers(0, 2, (n, len(EXPOSURES)))
    years = rng.integers(20, 50, n)
    wave = rng.choice(["a", "b", "c"], n)
    eta = -1 + 0.6 * marks[:, 0] - 0.4 * marks[:, 1] + 0.03 * (years - 35) + 0.5 * (wave == "b")
    sick = rng.random(n) < 1 / (1 + np.exp(-eta))
    time = np.ceil(rng.exponential(5 / np.exp(0.4 * marks[:, 0])) * 4) / 4
    time[: n // 3] = 3.0  # a third of the rows at one time
    data = [
        (*map(int, m), int(y), str(w), int(s), float(t), int(e)) for m, y, w, s, t, e in
        zip(marks, years, wave, sick, time, rng.random(n) < 0.6)
    ]
    fields = ", ".join(f"{e} int" for e in EXPOSURES)
    return spark.createDataFrame(
        data, f"{fields}, years int, wave string, sick int, time double, event int"
    ).repartition(4)


def jobs(spark, action):
    """What ``action`` returns, and how many jobs it took."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    try:
        found = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def by_term(rows, *columns):
    return {(r["model"], r["term"]): [r[c] for c in columns] for r in rows}


def same(a, b, rel):
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], rel=rel, abs=1e-10), key


def test_jobs_do_not_grow_with_the_number_of_large_models(spark, frame):
    columns = ("estimate", "std_error", "conf_low", "conf_high")

    def fits(names, **options):
        return logistic_batch(
            frame, "sick", {e: ["0", "1"] for e in names}, [Num("years"), Cat("wave")],
            **options,
        ).collect()

    _, one = jobs(spark, lambda: fits(EXPOSURES[:1], max_patterns=0))
    found, six = jobs(spark, lambda: fits(EXPOSURES, max_patterns=0))
    # The slowest of the models decides: a step more or less is two jobs.
    assert six <= one + 4
    same(by_term(found, *columns), by_term(fits(EXPOSURES), *columns), 1e-6)


def test_large_cox_models_share_their_passes(spark, frame, monkeypatch):
    monkeypatch.setattr(cox_module, "ROWS_PER_RANGE", 60)
    columns = ("coef", "std_error", "n_obs", "n_events")

    def fits(names, **options):
        return cox_batch(
            frame, "time", "event", {e: ["0", "1"] for e in names}, [Cat("wave")], **options
        ).collect()

    _, one = jobs(spark, lambda: fits(EXPOSURES[:1], max_patterns=0))
    found, six = jobs(spark, lambda: fits(EXPOSURES, max_patterns=0))
    assert six <= one + 8
    same(by_term(found, *columns), by_term(fits(EXPOSURES), *columns), 1e-8)


def test_profile_bounds_come_out_of_shared_passes(spark, frame):
    terms = [Num("e0"), Num("e1"), Num("years")]
    columns = ("conf_low", "conf_high")

    def rows(**options):
        fit = logistic_or(frame, "sick", terms, **options)
        return {r["term"]: [r[c] for c in columns] for r in fit.collect()}

    spread, n = jobs(spark, lambda: rows(max_patterns=0))
    assert n < 40
    same(spread, rows(), 1e-6)


def test_bounds_that_do_not_exist_stay_empty_on_the_large_path(spark):
    data = [(0, 0)] * 10 + [(0, 1)] * 10 + [(1, 1)] * 10
    df = spark.createDataFrame(data, "x int, y int")
    fit = {r["term"]: r for r in logistic_or(df, "y", [Num("x")], max_patterns=0).collect()}
    assert fit["x"]["conf_low"] is not None and fit["x"]["conf_high"] is None
    local = {r["term"]: r for r in logistic_or(df, "y", [Num("x")]).collect()}
    assert fit["x"]["conf_low"] == pytest.approx(local["x"]["conf_low"], rel=1e-5)


def test_twenty_columns_on_the_large_path(spark, monkeypatch):
    monkeypatch.setattr(cox_module, "ROWS_PER_RANGE", 100)
    rng = np.random.default_rng(3)
    names = [f"v{i}" for i in range(20)]
    x = rng.normal(size=(400, 20)).round(3)
    time = np.ceil(rng.exponential(5 / np.exp(x[:, 0] * 0.5)) * 8) / 8
    event = rng.random(400) < 0.7
    df = spark.createDataFrame(
        [(*map(float, r), float(t), int(e)) for r, t, e in zip(x, time, event)],
        ", ".join(f"{n} double" for n in names) + ", time double, event int",
    )
    terms = [Num(n) for n in names]
    columns = ("coef", "std_error")
    local = {r["term"]: [r[c] for c in columns] for r in cox_hr(df, "time", "event", terms).collect()}
    large = {r["term"]: [r[c] for c in columns]
             for r in cox_hr(df, "time", "event", terms, max_patterns=0).collect()}
    same(large, local, 1e-8)


def test_a_step_too_far_is_halved_on_the_large_path(spark, monkeypatch):
    """Likelihoods that leave the range of numbers on the way do not end the search."""
    monkeypatch.setattr(cox_module, "ROWS_PER_RANGE", 9)
    data = [(float(v), float(t), 1) for t, v in enumerate([900, 5, 1, 0, 7, 3, 2, 8, 6, 4] * 4)]
    df = spark.createDataFrame(data, "v double, t double, e int")
    large, local = [
        cox_hr(df, "t", "e", [Num("v")], max_patterns=most).first() for most in (0, 500_000)
    ]
    assert large["coef"] == pytest.approx(local["coef"], rel=1e-6)


def test_a_single_time_is_shared_by_tasks(spark, frame, monkeypatch):
    monkeypatch.setattr(cox_module, "ROWS_PER_RANGE", 40)
    seen = []
    real = cox_module.TimeRanges.__init__

    def watched(self, large):
        real(self, large)
        seen.append((len(self.single), self.runs.groupBy("at", "range").agg(
            F.count_distinct("time").alias("t"), F.count("*").alias("n")).collect()))

    monkeypatch.setattr(cox_module.TimeRanges, "__init__", watched)
    cox_hr(frame, "time", "event", [Num("years"), Cat("wave")], max_patterns=0).collect()
    singles, runs = seen[0]
    assert singles >= 1
    assert max(r["n"] for r in runs) < 150


def test_ranges_are_grouped_without_moving_rows(spark, frame):
    ranged = frame.withColumn("at", F.col("e0")).withColumn("range", F.col("years") % 5)
    kept = ranged.repartition(5, "at", "range").persist()
    try:
        kept.count()
        grouped = kept.groupBy("at", "range").applyInArrow(lambda t: t, kept.schema)
        plan = grouped._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("InMemoryTableScan")[0]
    finally:
        kept.unpersist()


def test_levels_come_from_the_data(spark, rows):
    df = spark.createDataFrame(
        [("x", 1.0), ("y", 2.0), ("z", 3.0), (None, 4.0), ("x", None)], "g string, t double"
    )
    got = design_matrix(df, [Cat("g"), Num("t")], "t")
    assert got.columns == ["t", "g=y", "g=z", "t"]
    assert sorted(map(tuple, got.collect())) == [
        (1.0, 0.0, 0.0, 1.0), (2.0, 1.0, 0.0, 2.0), (3.0, 0.0, 1.0, 3.0)]
    assert design_matrix(df, [Cat("g", ref="y")], "t").columns == ["t", "g=x", "g=z"]
    assert design_matrix(df.limit(0), [Cat("g", ref="y")], "t").columns == ["t"]
    with pytest.raises(ValueError, match="zzz"):
        design_matrix(df, [Cat("g", ref="zzz")], "t")
    with pytest.raises(ValueError, match="zzz"):
        design_matrix(df, [Cat("g", ("x", "y"), ref="zzz")], "t")
    with pytest.raises(ValueError, match="sparse_design"):
        design_matrix(df, [Cat("g")], "t", max_levels=2)


@pytest.mark.parametrize("most", [0, 500_000])
def test_an_absent_reference_is_an_error(frame, most):
    with pytest.raises(ValueError, match="zzz"):
        logistic_or(frame, "sick", [Cat("wave", ref="zzz")], max_patterns=most)
    with pytest.raises(ValueError, match="zzz"):
        cox_batch(frame, "time", "event", {"wave": "zzz", "e0": None}, max_patterns=most)
    empty = frame.limit(0)
    assert cox_batch(empty, "time", "event", {"wave": "zzz"}, max_patterns=most).collect() == []


def dense(matrix, labels, key):
    names = {r["column"]: r["label"] for r in labels.collect()}
    out = {}
    for r in matrix.collect():
        out.setdefault(r[key], {})[names[r["column"]]] = r["value"]
    return out


def test_sparse_design_equals_the_dense_one(spark, frame):
    rows = frame.withColumn("id", F.monotonically_increasing_id()).select(
        "id", "e0", "wave", F.col("years").alias("value")
    ).withColumn("column", F.col("wave"))
    terms = [Num("value"), Cat("wave", ref="b"), Cat("e0", ("0", "1")), Cat("column"),
             Inter(Num("value"), Cat("wave", ref="b")), Inter(Cat("wave", ref="b"), Cat("column"))]
    found = dense(*sparse_design(rows, terms, "id"), "id")
    wanted = {}
    for r in design_matrix(rows, terms, "id").collect():
        filled = {n: v for n, v in r.asDict().items() if n != "id" and v}
        if filled:
            wanted[r["id"]] = filled
    assert found == wanted
    numbers = sorted(r["column"] for r in sparse_design(rows, terms[:4], "id")[1].collect())
    assert numbers == list(range(6))
    with pytest.raises(ValueError, match="zzz"):
        sparse_design(rows, [Cat("wave", ref="zzz")], "id")


def test_ten_thousand_levels_are_rows(spark):
    df = spark.range(30_000).select(
        F.col("id"), F.concat(F.lit("g"), F.col("id") % 10_000).alias("g"),
        (F.col("id") % 7).cast("double").alias("v"),
    )
    terms = [Cat("g"), Num("v"), Inter(Num("v"), Cat("g"))]
    assert level_dictionary(df, terms).count() == 10_000
    matrix, labels = sparse_design(df, terms, "id")
    assert matrix.columns == ["id", "column", "value"]
    assert matrix.where("column < 9999").groupBy("column").count().where(
        "count = 3").count() == 9_999
    assert labels.where("column < 9999").agg(F.count_distinct("label")).first()[0] == 9_999
    assert labels.where("label = 'v'").first()["column"] == 9_999
