"""Estimators against closed forms and row-level fits."""

import math

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
    logistic_batch,
    logistic_or,
    poly_ols,
)
from cohortsmith.models import cox as cox_module
from cohortsmith.models.efron import DIRECT, tie_sums

AGES = ["0-9", "10-19", "20-29"]


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(7)
    n = 600
    age = rng.choice(AGES, n)
    sex = rng.choice(["M", "F"], n)
    fever = rng.integers(0, 2, n)
    wave = rng.choice(["a", "b"], n)
    eta = -0.5 + 0.7 * fever + 0.3 * (age == "10-19") - 0.4 * (wave == "b") * fever
    sick = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    time = np.ceil(rng.exponential(6 / np.exp(0.4 * fever)) * 2) / 2 + 0.5
    event = (rng.random(n) < 0.6).astype(int)
    years = rng.integers(0, 60, n).astype(float)
    return dict(
        age=age, sex=sex, fever=fever, wave=wave, sick=sick, time=time,
        event=event, years=years,
    )


@pytest.fixture(scope="module")
def frame(spark, people):
    names = list(people)
    data = [tuple(x.item() for x in r) for r in zip(*people.values())]
    missing = tuple(None if k in ("age", "fever") else people[k][0].item() for k in names)
    types = dict(
        age="string", sex="string", fever="int", wave="string", sick="int",
        time="double", event="int", years="double",
    )
    schema = ", ".join(f"{k} {types[k]}" for k in names)
    return spark.createDataFrame([*data, missing], schema).repartition(5)


def row_level_logistic(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        mu = 1 / (1 + np.exp(-x @ beta))
        info = (x * (mu * (1 - mu))[:, None]).T @ x
        beta = beta + np.linalg.solve(info, x.T @ (y - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


def log_likelihood(x, y, beta):
    eta = x @ beta
    return y @ eta - np.logaddexp(0, eta).sum()


def row_level_cox(x, time, event):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        w = np.exp(x @ beta)
        grad, info = np.zeros_like(beta), np.zeros((len(beta), len(beta)))
        for t in np.unique(time[event == 1]):
            risk, dead = time >= t, (time == t) & (event == 1)
            d = dead.sum()
            grad += x[dead].sum(0)
            for l in range(d):
                v = w * risk - (l / d) * w * dead
                mean = v @ x / v.sum()
                grad -= mean
                info += (x * v[:, None]).T @ x / v.sum() - np.outer(mean, mean)
        beta = beta + np.linalg.solve(info, grad)
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


def design(p, *names):
    one = {
        "fever": p["fever"].astype(float),
        "age=10-19": (p["age"] == "10-19").astype(float),
        "age=20-29": (p["age"] == "20-29").astype(float),
        "wave=b": (p["wave"] == "b").astype(float),
        "sex=F": (p["sex"] == "F").astype(float),
        "years": p["years"],
    }
    return np.column_stack([one[n] for n in names])


def by_term(df, *cols):
    return {r["term"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_two_by_two_closed_form(spark):
    a, b, c, d = 12, 5, 8, 15
    cells = [(1, 1, a), (1, 0, b), (0, 1, c), (0, 0, d)]
    data = [(x, y) for x, y, n in cells for _ in range(n)]
    fit = by_term(
        logistic_or(spark.createDataFrame(data, "x int, y int"), "y", [Num("x")]),
        "estimate", "std_error",
    )
    assert fit["x"][0] == pytest.approx(a * d / (b * c), rel=1e-10)
    assert fit["x"][1] == pytest.approx(math.sqrt(1/a + 1/b + 1/c + 1/d), rel=1e-8)
    assert fit["(Intercept)"][0] == pytest.approx(c / d, rel=1e-10)


def test_logistic_matches_row_level_fit(frame, people):
    p = people
    x = np.column_stack([np.ones(len(p["sick"])), design(p, "fever", "age=10-19", "age=20-29")])
    beta, se = row_level_logistic(x, p["sick"])
    got = by_term(
        logistic_or(frame, "sick", [Num("fever"), Cat("age", tuple(AGES))]),
        "estimate", "std_error", "conf_low", "conf_high", "n_obs",
    )
    terms = ["(Intercept)", "fever", "age=10-19", "age=20-29"]
    best = log_likelihood(x, p["sick"], beta)
    for j, term in enumerate(terms):
        estimate, error, low, high, n = got[term]
        assert math.log(estimate) == pytest.approx(beta[j], abs=1e-8)
        assert error == pytest.approx(se[j], rel=1e-7)
        assert n == 600
        for bound in (low, high):
            # The profile drops by half the chi-square quantile at the bound.
            rest = np.delete(x, j, 1)
            offset = x[:, j] * math.log(bound)
            b = np.zeros(rest.shape[1])
            for _ in range(40):
                mu = 1 / (1 + np.exp(-(rest @ b + offset)))
                info = (rest * (mu * (1 - mu))[:, None]).T @ rest
                b = b + np.linalg.solve(info, rest.T @ (p["sick"] - mu))
            eta = rest @ b + offset
            value = p["sick"] @ eta - np.logaddexp(0, eta).sum()
            assert 2 * (best - value) == pytest.approx(3.841458820694124, abs=1e-6)


def test_interaction_and_wald(frame, people):
    p = people
    x = design(p, "fever", "age=10-19", "age=20-29", "wave=b")
    x = np.column_stack([np.ones(len(x)), x, x[:, 0] * x[:, 3]])
    beta, se = row_level_logistic(x, p["sick"])
    fever, wave = Num("fever"), Cat("wave", ("a", "b"))
    got = by_term(
        logistic_or(
            frame, "sick", [fever, Cat("age", ref="0-9"), wave, Inter(fever, wave)],
            conf="wald",
        ),
        "estimate", "conf_low",
    )
    assert math.log(got["fever:wave=b"][0]) == pytest.approx(beta[-1], abs=1e-8)
    assert math.log(got["fever:wave=b"][1]) == pytest.approx(
        beta[-1] - 1.959963984540054 * se[-1], abs=1e-7
    )


def test_distributed_logistic_equals_local(frame):
    terms = [Num("fever"), Cat("age"), Num("years")]
    cols = ("estimate", "std_error", "conf_low", "conf_high")
    local = by_term(logistic_or(frame, "sick", terms, conf="wald"), *cols)
    spread = by_term(
        logistic_or(frame, "sick", terms, conf="wald", max_patterns=0), *cols
    )
    assert local.keys() == spread.keys()
    for term in local:
        assert spread[term] == pytest.approx(local[term], rel=1e-8)


def test_batch_equals_single_models(frame):
    batch = logistic_batch(
        frame, "sick", {"fever": ["0", "1"], "wave": None},
        adjust=[Cat("age", tuple(AGES))],
    )
    got = {(r["model"], r["term"]): r["estimate"] for r in batch.collect()}
    fever = by_term(
        logistic_or(frame, "sick", [Num("fever"), Cat("age", tuple(AGES))]), "estimate"
    )
    wave = by_term(logistic_or(frame, "sick", [Cat("wave"), Cat("age")]), "estimate")
    assert got["fever", "fever=1"] == pytest.approx(fever["fever"][0], rel=1e-9)
    assert got["wave", "wave=b"] == pytest.approx(wave["wave=b"][0], rel=1e-9)


def test_small_and_large_models_of_one_batch(frame):
    """One model fits the limit, the other one takes the distributed path."""

    def fits(**options):
        batch = logistic_batch(
            frame, "sick", {"fever": ["0", "1"], "age": None}, adjust=[Num("years")],
            strata=["wave"], conf="wald", **options,
        )
        return {
            (r["model"], r["wave"], r["term"]): (r["estimate"], r["std_error"])
            for r in batch.collect()
        }

    local, mixed = fits(), fits(max_patterns=130)
    assert local.keys() == mixed.keys()
    for key in local:
        assert mixed[key] == pytest.approx(local[key], rel=1e-8)


def test_strata_equal_subsets(frame):
    terms = [Num("fever"), Cat("age", tuple(AGES))]
    stratified = logistic_or(frame, "sick", terms, strata=["wave"], conf="wald")
    got = {(r["wave"], r["term"]): r["estimate"] for r in stratified.collect()}
    for wave in "ab":
        one = by_term(
            logistic_or(frame.where(F.col("wave") == wave), "sick", terms, conf="wald"),
            "estimate",
        )
        assert got[wave, "fever"] == pytest.approx(one["fever"][0], rel=1e-9)


def test_reference_only_reparameterises(frame):
    first = by_term(logistic_or(frame, "sick", [Cat("age", ref="0-9")]), "estimate")
    other = by_term(logistic_or(frame, "sick", [Cat("age", ref="10-19")]), "estimate")
    assert other["age=0-9"][0] == pytest.approx(1 / first["age=10-19"][0], rel=1e-9)


def test_separation_is_reported_not_raised(spark):
    data = [(0, 0)] * 10 + [(0, 1)] * 10 + [(1, 1)] * 10
    got = by_term(
        logistic_or(spark.createDataFrame(data, "x int, y int"), "y", [Num("x")]),
        "std_error", "conf_low", "conf_high",
    )
    assert got["x"][0] > 100
    assert got["x"][1] is not None and got["x"][2] is None


def test_collinear_column_has_no_estimate(spark):
    data = [(i % 2, i % 2, int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(data, "x int, z int, y int")
    got = by_term(logistic_or(df, "y", [Num("x"), Num("z")]), "estimate")
    assert got["x"][0] is not None and got["z"][0] is None


def test_cox_matches_row_level_fit(frame, people):
    p = people
    x = design(p, "fever", "age=10-19", "age=20-29", "sex=F")
    beta, se = row_level_cox(x, p["time"], p["event"])
    got = by_term(
        cox_hr(
            frame, "time", "event",
            [Num("fever"), Cat("age", tuple(AGES)), Cat("sex", ref="M")],
        ),
        "coef", "std_error", "hazard_ratio", "ci_lower", "n_events",
    )
    for j, term in enumerate(["fever", "age=10-19", "age=20-29", "sex=F"]):
        assert got[term][0] == pytest.approx(beta[j], abs=1e-8)
        assert got[term][1] == pytest.approx(se[j], rel=1e-7)
        assert got[term][2] == pytest.approx(math.exp(beta[j]), rel=1e-8)
        assert got[term][3] == pytest.approx(
            math.exp(beta[j] - 1.959963984540054 * se[j]), rel=1e-7
        )
        assert got[term][4] == int(p["event"].sum())


@pytest.mark.parametrize("per_range", [7, 90, cox_module.ROWS_PER_RANGE])
def test_distributed_cox_equals_local(frame, monkeypatch, per_range):
    monkeypatch.setattr(cox_module, "ROWS_PER_RANGE", per_range)
    terms = [Num("fever"), Cat("age"), Num("years")]
    cols = ("coef", "std_error", "ci_lower", "ci_upper")
    local = by_term(cox_hr(frame, "time", "event", terms), *cols)
    spread = by_term(cox_hr(frame, "time", "event", terms, max_patterns=0), *cols)
    for term in local:
        assert spread[term] == pytest.approx(local[term], rel=1e-8, abs=1e-10)


@pytest.mark.parametrize("most", [0, 500_000])
def test_covariates_may_have_any_name(frame, most):
    plain = by_term(cox_hr(frame, "time", "event", [Num("fever"), Cat("age")]), "coef")
    for a, b in [("model", "n"), ("d", "exposure"), ("k", "outcome"), ("bucket", "s")]:
        named = frame.withColumnsRenamed({"fever": a, "age": b})
        got = by_term(
            cox_hr(named, "time", "event", [Num(a), Cat(b)], max_patterns=most), "coef"
        )
        assert got[a][0] == pytest.approx(plain["fever"][0], abs=1e-8)
        assert got[f"{b}=10-19"][0] == pytest.approx(plain["age=10-19"][0], abs=1e-8)


def test_cox_without_design_columns_gives_an_empty_estimate(frame):
    from pyspark.sql import functions as F

    batch = cox_batch(
        frame.withColumn("one", F.lit("x")), "time", "event", {"one": None, "fever": None}
    ).collect()
    one = [r for r in batch if r["model"] == "one"]
    assert len(one) == 1 and one[0]["term"] is None and one[0]["coef"] is None
    assert [r["term"] for r in batch if r["model"] == "fever"] == ["fever=1"]


def test_many_levels_are_fitted(spark):
    data = [(f"g{i % 250:03d}", float(1 + i % 9), int(i % 3 == 0)) for i in range(3000)]
    frame = spark.createDataFrame(data, "g string, t double, e int")
    assert cox_hr(frame, "t", "e", [Cat("g")]).count() == 249


def test_cox_batch_equals_single_models(frame):
    batch = cox_batch(
        frame, "time", "event", {"fever": ["0", "1"], "wave": None},
        adjust=[Cat("sex", ref="M")],
    )
    got = {(r["model"], r["term"]): r["coef"] for r in batch.collect()}
    one = by_term(
        cox_hr(frame, "time", "event", [Num("fever"), Cat("sex", ref="M")]), "coef"
    )
    assert got["fever", "fever=1"] == pytest.approx(one["fever"][0], abs=1e-10)


def test_cox_category_without_events(spark):
    rng = np.random.default_rng(3)
    data = [("a", float(rng.integers(1, 9)), 1) for _ in range(30)]
    data += [("b", float(rng.integers(1, 9)), 0) for _ in range(10)]
    got = by_term(
        cox_hr(spark.createDataFrame(data, "g string, t double, e int"), "t", "e",
               [Cat("g")]),
        "hazard_ratio",
    )
    assert got["g=b"][0] < 1e-3


@pytest.mark.parametrize("d", [1, 2, DIRECT, DIRECT + 1, 300, 20_000])
@pytest.mark.parametrize("extra", [0.0, 0.5, 1e3, 1e7])
def test_tie_sums_match_direct_sums(d, extra):
    e = 0.7 * d
    s = e + extra
    f = np.arange(d) / d
    c = 1 / (s - f * e)
    direct = [np.log(1 / c).sum(), c.sum(), (f * c).sum(), (c * c).sum(),
              (f * c * c).sum(), (f * f * c * c).sum()]
    got = [v[0] for v in tie_sums([s], [e], [d])]
    # In the likelihood the sums meet risk-set sums (size s) and event sums
    # (size e); they are compared on the scale of those products.
    size = [1, s, e, s * s, s * e, e * e]
    whole = [abs(direct[0]), *[s * direct[1]] * 2, *[s * s * direct[3]] * 3]
    for a, b, factor, total in zip(got, direct, size, whole):
        assert abs(a - b) * factor <= 1e-11 * total


def test_poly_ols_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 25, 300)
    y = 20 + 0.8 * x - 0.02 * x * x + rng.normal(0, 2, 300)
    df = spark.createDataFrame(
        [(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"
    )
    inside = x <= 18
    m = np.column_stack([np.ones(inside.sum()), x[inside], x[inside] ** 2])
    beta, *_ = np.linalg.lstsq(m, y[inside], rcond=None)
    fitted = poly_ols(df, "x", "y", (0, 18), points=7).collect()
    assert fitted[0]["x"] == 0 and fitted[-1]["x"] == 18
    for r in fitted:
        expected = beta @ [1, r["x"], r["x"] ** 2]
        assert r["fit"] == pytest.approx(expected, rel=1e-9)
        assert r["conf_low"] < r["fit"] < r["conf_high"]


def test_design_matrix(spark, rows):
    df = spark.createDataFrame(
        [(1, "0-9", 1.0), (2, "10-19", 2.0), (3, None, 3.0), (4, "other", 4.0)],
        "id int, age string, v double",
    )
    age, v = Cat("age", ("0-9", "10-19")), Num("v")
    got = design_matrix(df, [age, v, Inter(v, age)], "id")
    assert got.columns == ["id", "age=10-19", "v", "v:age=10-19"]
    assert rows(got) == [(1, 0.0, 1.0, 0.0), (2, 1.0, 2.0, 2.0)]


def test_poly_ols_keeps_its_digits_at_a_large_offset(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 19, 400).astype(float)
    y = 20 + 0.8 * x - 0.02 * x * x + rng.normal(0, 2, 400)

    def band(offset):
        df = spark.createDataFrame(
            [(a, float(b) + offset) for a, b in zip(x.tolist(), y)], "x double, y double")
        return [
            (r["fit"] - offset, r["conf_high"] - r["conf_low"])
            for r in poly_ols(df.repartition(3), "x", "y", (0, 18), points=9).collect()
        ]

    for plain, moved in zip(band(0.0), band(1e8)):
        assert moved == pytest.approx(plain, abs=1e-6)
