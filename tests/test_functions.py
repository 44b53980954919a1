"""Column expressions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from cohortsmith import functions as fn
from cohortsmith.plans import covariates as study


def values(spark, expr, data, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"i int, {schema}")
    got = df.select("i", expr.alias("v")).orderBy("i").collect()
    return [r["v"] for r in got]


def single(spark, expr, cells, kind="string"):
    return values(spark, expr, [(c,) for c in cells], f"x {kind}")


def test_recode_binary(spark):
    got = single(
        spark, fn.recode_binary("x", study.YES, study.NO),
        ["Sim", "Não", "Não sabe", "yes", "maybe", None],
    )
    assert got == [1, 0, 0, 1, None, None]


def test_last_override_wins_and_null_does_not_fire(spark):
    rules = [(F.col("x") > 1, "a"), (F.col("x") > 2, "b")]
    assert single(spark, fn.overrides(rules, F.lit("base")), [0, 2, 3, None], "int") == [
        "base", "a", "b", "base"
    ]


def test_bin_numeric_overlapping_open_intervals(spark):
    got = single(
        spark, fn.bin_numeric("x", "normal", study.BMI_CLASSES),
        [24.99, 25.0, 29.995, 30.0, 50.0, 19.0, 18.9, 8.0, None], "double",
    )
    assert got == [
        "normal", "overweight", "obesity", "obesity", "normal", "normal",
        "underweight", "normal", None,
    ]


def test_threshold_flag(spark):
    got = single(
        spark, fn.threshold_flag("x", 95), [91.9, 94.9, 95.0, None], "double"
    )
    assert got == ["yes", "yes", "no", None]


def test_factor_relevel_and_codes(spark):
    levels = fn.relevel(["a", "b", "c"], "b")
    assert levels == ["b", "a", "c"]
    assert single(spark, fn.as_factor("x", levels), ["a", "z", None]) == ["a", None, None]
    assert single(spark, fn.level_code("x", levels), ["a", "b", "z", None]) == [
        1, 0, None, None
    ]
    with pytest.raises(ValueError):
        fn.relevel(["a"], "z")


@pytest.mark.parametrize(
    ("rbd", "np", "expected"),
    [
        (1.5, 1.0, "positive after infection"), (1.5, 0.5, "negative"),
        (0.5, None, None), (1.5, None, None), (0.5, 0.5, "negative"),
    ],
)
def test_any_unknown_antigen_makes_the_result_unknown(spark, rbd, np, expected):
    expr = fn.k_of_n_positive(["a", "b"], 2, study.INFECTED, study.NEGATIVE)
    assert values(spark, expr, [(rbd, np)], "a double, b double") == [expected]


def test_vaccination_override(spark):
    expr = study.sero_result("seroresultRBD")
    got = values(
        spark, expr,
        [(2.0, "Sim, 1 dose"), (2.0, None), (2.0, "Não"), (0.1, "Sim")],
        "analyte25_RBD double, vacinated string",
    )
    assert got == [study.AFTER_VACCINE, study.INFECTED, study.INFECTED, study.NEGATIVE]


def test_any_of_flags_treats_unknown_as_false(spark):
    expr = fn.any_of_flags([F.col("a") == "Sim", F.col("b") == "Sim"])
    got = values(
        spark, expr, [("Sim", None), (None, None), ("Não", "Sim")], "a string, b string"
    )
    assert got == [1, 0, 1]


def test_outcome_tier(spark):
    expr = fn.outcome_tier("a", "b", study.OUTCOMES)
    got = values(spark, expr, [(None, None), (2, 0), (2, 1)], "a int, b int")
    assert got == list(study.OUTCOMES)


def test_eras(spark):
    expr = fn.era_from_month("x", study.ERA_STARTS, study.ERAS)
    got = single(spark, expr, ["2021-05", "2021-06", "2021-10", "2021-11", None])
    assert got == ["alpha/beta", "delta", "delta", "omikron", None]


def test_dates(spark):
    assert single(spark, fn.week_start(F.col("x").cast("date")), [
        "2021-03-01", "2021-03-07", "2021-03-08"
    ]) == [__import__("datetime").date(2021, 3, d) for d in (1, 1, 8)]
    assert single(spark, fn.month_key(F.col("x").cast("date")), ["2021-03-07"]) == [
        "2021-03"
    ]
    assert single(spark, fn.clamp_floor("x"), [-3, 0, 5, None], "int") == [0, 0, 5, None]


def test_numbers_and_labels(spark):
    assert single(spark, fn.to_number("x"), ["1.5", "indet", None]) == [1.5, None, None]
    expr = fn.ci_label(F.col("a"), F.col("b"))
    got = values(spark, expr, [(0.5, 1.25), (None, 1.0)], "a double, b double")
    assert got == ["0.50-1.25", None]


def test_wald_bounds_are_undefined_above_one(spark):
    low, high = fn.wald_bounds(F.col("x"), F.lit(10))
    assert single(spark, low, [1.5], "double") == [None]
    half = single(spark, high, [0.5], "double")[0]
    assert half == pytest.approx(0.5 + 1.959963984540054 * (0.25 / 10) ** 0.5)


def test_baseline_covariates(spark):
    rules = study.baseline_covariates()
    cases = {
        "smokingbin": [
            ("Nao fumador", "non smoker"), ("Ex-fumador", "(ex-)smoker"),
            ("Nunca fumou", "non smoker"), (None, None),
        ],
        "hypertensionbin": [
            ("Não", 0), ("Diagnosticado, sem tratamento", 1), ("Diagnostico incerto", 1),
        ],
        "hivbin": [
            ("Crianca exposta", 1), ("Seropositivo em TARV", 1),
            ("estado desconhecido", 0), ("outro", None),
        ],
        "leukemia": [
            ("Nao", "not"), ("malignidade hematologica", "leukemia"), (None, None)
        ],
        "education": [
            ("3. Secundario incompleto", "primary"), ("8. Nenhum", "none completed"),
            ("4. Secundario completo", "secondary"),
        ],
        "bedroom_sharing": [("6 ou mais", "3 a 5"), ("1 a 2", "1 a 2"), (None, None)],
    }
    sources = {
        "smokingbin": "smoking", "hypertensionbin": "hypertension", "hivbin": "hiv",
        "leukemia": "cancer", "education": "ednivel_educacao",
        "bedroom_sharing": "bedroom_sharing",
    }
    for name, pairs in cases.items():
        got = values(
            spark, rules[name], [(a,) for a, _ in pairs], f"{sources[name]} string"
        )
        assert got == [b for _, b in pairs], name


def test_transport_code_beats_no_bus(spark):
    expr = study.baseline_covariates()["publictransport_pastweek"]
    got = values(
        spark, expr, [("Não", None), ("Não", "moto taxi"), ("Sim", None)],
        "mass_bus string, main_bus string",
    )
    assert got == ["none", "moto taxi/shared taxi", None]
