"""Regression models."""

from pyspark.sql import functions as F

from cohortsmith import functions as fn
from cohortsmith.models import (
    Cat,
    Inter,
    Num,
    cox_batch,
    cox_hr,
    logistic_batch,
    logistic_or,
    poly_ols,
)
from cohortsmith.plans import bindings as data
from cohortsmith.plans import covariates as study
from cohortsmith.plans import model_sql
from cohortsmith.plans.bindings import sql, unpivoted
from cohortsmith.plans.recode_queries import (
    ERA_STARTS,
    O2_SQL,
    RECODED,
    _binary_sql,
    clamped_delay,
)
from cohortsmith.plans.registry import register
from cohortsmith.plans.table_queries import rounded, tested_cases

AGES = ("BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SES = ("5. highest", "1. very low", "2. low", "3. med.", "4. high")
PRIORITY = ("3-MEDIUM", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW")
EXPOSURES = [*[s for s in RECODED if s != "conjunctivitis"], "O2under95"]
BINARY = ["0", "1"]
EFFECT = ["estimate", "std_error", "statistic", "conf_low", "conf_high"]
HAZARD = ["hazard_ratio", "std_error", "statistic", "ci_lower", "ci_upper"]
ALL_EFFECT, ALL_HAZARD = [*EFFECT, "p_value"], [*HAZARD, "coef", "p_value"]


def coded_cases(spark, folder, person=True):
    """Tested cases with 0/1 symptoms and outcome."""
    return tested_cases(spark, folder, person).withColumns({
        **{s: fn.recode_binary(s, study.YES, study.NO) for s in EXPOSURES},
        "testresult": fn.recode_binary("testresult", study.YES, study.NO),
        "variant": fn.era_from_month("monthonset", ERA_STARTS, study.ERAS),
    })


_CODED = ", ".join(
    f"{_binary_sql('(' + O2_SQL.format(95) + ')') if s == 'O2under95' else _binary_sql(s)}"
    f" AS {s}"
    for s in EXPOSURES
)
_ERA = (
    "CASE WHEN monthonset < '1997-03' THEN 'alpha/beta' "
    "WHEN monthonset < '1999-06' THEN 'delta' ELSE 'omikron' END"
)


def _coded(view: str, extra: str) -> str:
    return (
        f"SELECT CAST(testresult = 'positive' AS INT) AS y, {_ERA} AS variant, {extra} "
        f"{_CODED} FROM {view} WHERE testresult IS NOT NULL"
    )


def _long(view: str, extra: str = "", keep: str = "y") -> str:
    names = ", ".join(EXPOSURES)
    source = f"SELECT {keep}, {names} FROM ({_coded(view, extra)})"
    return f"SELECT {keep}, model, x FROM {unpivoted(source, EXPOSURES, 'model', 'x')}"


def _one_factor_sql(columns: dict[str, str], view: str) -> str:
    """Rows for the closed form; ``columns`` maps a factor to its reference."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS model, {c} AS level, '{ref}' AS reference, "
        f"CAST(testresult = 'positive' AS INT) AS y FROM {view} "
        "WHERE testresult IS NOT NULL"
        for c, ref in columns.items()
    )


@register(
    "logistic_or",
    sql(
        "SELECT * EXCLUDE (model) FROM ("
        + model_sql.one_factor(_one_factor_sql({"agegr10": "BUILDING"},
                                               "cases_with_person"))
        + ")",
        "cases_with_person",
    ),
)
def logistic_age(spark, folder):
    fit = logistic_or(
        coded_cases(spark, folder), "testresult", [Cat("agegr10", AGES)], conf="wald"
    )
    return rounded(fit, *EFFECT).select("term", *EFFECT)


@register(
    "model_batch",
    sql(
        model_sql.one_factor(
            f"SELECT model, CAST(x AS STRING) AS level, '0' AS reference, y "
            f"FROM ({_long('cases')}) UNION ALL "
            + _one_factor_sql(
                {"nosebleed": "Não", "GENDER": "M", "SesScoreQnt": "3-MEDIUM"}, "cases"
            )
        ),
        "cases",
    ),
)
def logistic_univariable(spark, folder):
    """Every exposure by itself; all fits come out of one scan."""
    exposures = {
        **{s: BINARY for s in EXPOSURES},
        "nosebleed": None, "GENDER": ["M", "F"], "SesScoreQnt": PRIORITY,
    }
    fits = logistic_batch(
        coded_cases(spark, folder, person=False), "testresult", exposures, conf="wald"
    )
    return rounded(fits, *EFFECT).select("model", "term", *EFFECT)


@register(
    "model_batch_adjusted",
    sql(
        model_sql.exposure_with_strata(
            _long("cases_with_person", "agegr10 AS grp,", "y, grp")
        ),
        "cases_with_person",
    ),
)
def logistic_adjusted(spark, folder):
    """Every symptom adjusted for age group; the exposure's own effect."""
    fits = _adjusted_fits(spark, folder)
    own = fits.where(F.col("term") == F.concat("model", F.lit("=1")))
    return rounded(own, *EFFECT).select("model", *EFFECT)


def _symptom_models(names, view, *adjust, strata=("",)):
    """Rows and design columns of one model per symptom (and stratum)."""
    columns = {k: v for part in adjust for k, v in part.items()}
    return {
        s + (f"|{stratum}" if stratum else ""): (
            f"SELECT * FROM ({_coded(view, 'agegr10,' if adjust else '')})"
            + (f" WHERE variant = '{stratum}'" if stratum else ""),
            {f"{s}=1": s, **columns},
        )
        for stratum in strata for s in names
    }


_AGE_COLUMNS = model_sql.indicators("agegr10", AGES)


@register(
    "model_batch_adjusted_terms",
    sql(
        model_sql.logistic_fits(
            _symptom_models(EXPOSURES, "cases_with_person", _AGE_COLUMNS)
        ),
        "cases_with_person",
    ),
)
def logistic_adjusted_terms(spark, folder):
    """The same fits with every term and column."""
    return rounded(_adjusted_fits(spark, folder), *ALL_EFFECT)


def _adjusted_fits(spark, folder, conf="wald"):
    return logistic_batch(
        coded_cases(spark, folder), "testresult", {s: BINARY for s in EXPOSURES},
        adjust=[Cat("agegr10", AGES)], conf=conf,
    )


@register("profile_ci", sql(model_sql.profile_two_by_two(_long("cases")), "cases"))
def profile_ci(spark, folder):
    """Profile bounds of the exposure's own effect."""
    fits = _profile_fits(spark, folder)
    own = fits.where(F.col("term") == F.concat("model", F.lit("=1")))
    return rounded(own, "conf_low", "conf_high").select("model", "conf_low", "conf_high")


@register(
    "profile_ci_terms",
    sql(
        model_sql.logistic_fits(_symptom_models(EXPOSURES, "cases"), profile=True), "cases"
    ),
)
def profile_ci_terms(spark, folder):
    """The same fits with every term and column."""
    return rounded(_profile_fits(spark, folder), *ALL_EFFECT)


def _profile_fits(spark, folder):
    return logistic_batch(
        coded_cases(spark, folder, person=False), "testresult",
        {s: BINARY for s in EXPOSURES},
    )


@register(
    "profile_ci_adjusted",
    sql(
        model_sql.logistic_fits(
            _symptom_models(EXPOSURES, "cases_with_person", _AGE_COLUMNS), profile=True
        ),
        "cases_with_person",
    ),
)
def profile_ci_adjusted(spark, folder):
    """Profile bounds of all terms of every symptom's fit adjusted for age group."""
    return rounded(_adjusted_fits(spark, folder, "profile"), *ALL_EFFECT)


@register(
    "logistic_or_profile",
    sql(
        model_sql.logistic_fits(
            {"age": (_coded("cases_with_person", "agegr10,"), _AGE_COLUMNS)},
            profile=True, key="",
        ),
        "cases_with_person",
    ),
)
def logistic_age_profile(spark, folder):
    """Odds ratios of the age groups with profile bounds."""
    fit = logistic_or(coded_cases(spark, folder), "testresult", [Cat("agegr10", AGES)])
    return rounded(fit, *ALL_EFFECT)


_PER_ERA = f"""
cells AS (SELECT variant, anosmia AS x, (count(*) FILTER (WHERE y = 1))::DOUBLE AS a,
    (count(*) FILTER (WHERE y = 0))::DOUBLE AS b
  FROM ({_coded("cases", "")}) WHERE anosmia IS NOT NULL GROUP BY ALL),
wide AS (SELECT p.variant, p.a AS a1, p.b AS b1, q.a AS a0, q.b AS b0
  FROM cells p JOIN cells q ON p.variant = q.variant AND p.x = 1 AND q.x = 0),
alpha AS (SELECT a1 AS ra1, b1 AS rb1, a0 AS ra0, b0 AS rb0 FROM wide
  WHERE variant = 'alpha/beta'),
effects AS (
  SELECT '(Intercept)' AS term, ln(ra0 / rb0) AS beta, sqrt(1 / ra0 + 1 / rb0) AS se
  FROM alpha
  UNION ALL SELECT 'anosmia', ln(ra1 * rb0 / (rb1 * ra0)),
    sqrt(1 / ra1 + 1 / rb1 + 1 / ra0 + 1 / rb0) FROM alpha
  UNION ALL SELECT 'variant=' || variant, ln(a0 * rb0 / (b0 * ra0)),
    sqrt(1 / a0 + 1 / b0 + 1 / ra0 + 1 / rb0)
  FROM wide, alpha WHERE variant <> 'alpha/beta'
  UNION ALL SELECT 'anosmia:variant=' || variant,
    ln(a1 * b0 / (b1 * a0)) - ln(ra1 * rb0 / (rb1 * ra0)),
    sqrt(1 / a1 + 1 / b1 + 1 / a0 + 1 / b0 + 1 / ra1 + 1 / rb1 + 1 / ra0 + 1 / rb0)
  FROM wide, alpha WHERE variant <> 'alpha/beta')
"""


@register(
    "logistic_interaction",
    sql(
        f"WITH {_PER_ERA} SELECT term, "
        + model_sql.effect_columns("beta", "se", "estimate", "conf_low", "conf_high")
        + " FROM effects",
        "cases",
    ),
)
def logistic_interaction(spark, folder):
    """Symptom, era and their product without adjusters."""
    symptom, era = Num("anosmia"), Cat("variant", study.ERAS)
    fit = logistic_or(
        coded_cases(spark, folder, person=False), "testresult",
        [symptom, era, Inter(symptom, era)], conf="wald",
    )
    return rounded(fit, *EFFECT).select("term", *EFFECT)


_ERA_COLUMNS = model_sql.indicators("variant", study.ERAS)


@register(
    "logistic_interaction_adjusted",
    sql(
        model_sql.logistic_fits(
            {"ageusia": (
                _coded("cases_with_person", "agegr10,"),
                {"ageusia": "ageusia", **_AGE_COLUMNS, **_ERA_COLUMNS, **{
                    f"ageusia:{label}": f"ageusia * ({e})" for label, e in _ERA_COLUMNS.items()
                }},
            )},
            profile=True, key="",
        ),
        "cases_with_person",
    ),
)
def logistic_interaction_adjusted(spark, folder):
    """The study's interaction model, adjusted for age group."""
    symptom, era = Num("ageusia"), Cat("variant", study.ERAS)
    fit = logistic_or(
        coded_cases(spark, folder), "testresult",
        [symptom, Cat("agegr10", AGES), era, Inter(symptom, era)],
    )
    return rounded(fit, *ALL_EFFECT)


@register(
    "logistic_stratified",
    sql(
        model_sql.exposure_with_strata(
            "SELECT * FROM ("
            + _long("cases_with_person", "agegr10 AS grp,", "y, grp, variant")
            + ") WHERE model IN ('anosmia', 'ageusia', 'appitite_loss', 'chills')",
            keys="model, variant",
        ),
        "cases_with_person",
    ),
)
def logistic_stratified(spark, folder):
    """Adjusted symptom effects within every era; the exposure's own effect."""
    fits = _stratified_fits(spark, folder)
    own = fits.where(F.col("term") == F.concat("model", F.lit("=1")))
    return rounded(own, *EFFECT).select("model", "variant", *EFFECT)


_STRATIFIED = ["anosmia", "ageusia", "appitite_loss", "chills"]


@register(
    "logistic_stratified_terms",
    sql(
        model_sql.logistic_fits(
            _symptom_models(
                _STRATIFIED, "cases_with_person", _AGE_COLUMNS, strata=study.ERAS
            ),
            key="split_part(model, '|', 1) AS model, split_part(model, '|', 2) AS variant,",
        ),
        "cases_with_person",
    ),
)
def logistic_stratified_terms(spark, folder):
    """The same fits with every term and column."""
    return rounded(_stratified_fits(spark, folder), *ALL_EFFECT)


def _stratified_fits(spark, folder):
    return logistic_batch(
        coded_cases(spark, folder), "testresult", {s: BINARY for s in _STRATIFIED},
        adjust=[Cat("agegr10", AGES)], strata=["variant"], conf="wald",
    )


@register(
    "cox_hr",
    sql(
        "SELECT 'sex=F' AS term, "
        + model_sql.effect_columns(
            "b", "(1 / sqrt(info))", "hazard_ratio", "ci_lower", "ci_upper"
        )
        + " FROM ("
        + model_sql.cox_one(
            "SELECT ceil(time) AS t, CASE sex WHEN 'F' THEN 1 WHEN 'M' THEN 0 END AS x, "
            "event FROM cohort"
        )
        + ")",
        "cohort",
    ),
)
def cox_sex(spark, folder):
    """Whole months of follow-up, so that events are heavily tied."""
    people = data.cohort(spark, folder).withColumn("time", F.ceil("time"))
    fit = cox_hr(people, "time", "event", [Cat("sex", ("M", "F"))])
    return rounded(fit, *HAZARD).select("term", *HAZARD)


_COX_EXPOSURES = list(data.COHORT_BINARY)
_COX_LONG = (
    "SELECT model, time AS t, CASE x WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS x1, "
    "CASE sex WHEN 'F' THEN 1 WHEN 'M' THEN 0 END AS x2, event FROM "
    + unpivoted(
        f"SELECT time, event, sex, {', '.join(_COX_EXPOSURES)} FROM cohort",
        _COX_EXPOSURES, "model", "x",
    )
)


@register(
    "cox_batch",
    sql(
        f"WITH fits AS MATERIALIZED ({model_sql.cox_two(_COX_LONG)}), "
        "effects AS (SELECT model, model || '=yes' AS term, b1 AS beta, sqrt(v1) AS se "
        "FROM fits UNION ALL SELECT model, 'sex=F', b2, sqrt(v2) FROM fits) "
        "SELECT model, term, "
        + model_sql.effect_columns(
            "beta", "se", "hazard_ratio", "ci_lower", "ci_upper"
        )
        + " FROM effects",
        "cohort",
    ),
)
def cox_exposures(spark, folder):
    """Every exposure adjusted for sex."""
    fits = cox_batch(
        data.cohort(spark, folder), "time", "event",
        {e: ["no", "yes"] for e in _COX_EXPOSURES}, adjust=[Cat("sex", ("M", "F"))],
    )
    return rounded(fits, *HAZARD).select("model", "term", *HAZARD)


TRANSPORT = ("none", "bus/train", "moto taxi/shared taxi")
ROOMS = ("1 a 2", "3 a 5", "6 ou mais")
_COX_EXPOSED = {
    **{e: ("no", "yes") for e in _COX_EXPOSURES},
    "publictransport_pastweek": TRANSPORT, "bedroom_sharing": ROOMS,
}
_SEX_COLUMNS = model_sql.indicators("sex", ("M", "F"))
_FOLLOWED = "SELECT *, time AS t FROM cohort"


@register(
    "cox_batch_adjusted",
    sql(
        model_sql.cox_fits({
            e: (_FOLLOWED, {
                **model_sql.indicators(e, levels), **_AGE_COLUMNS, **_SEX_COLUMNS,
            })
            for e, levels in _COX_EXPOSED.items()
        }),
        "cohort",
    ),
)
def cox_exposures_adjusted(spark, folder):
    """The study's loop: every exposure adjusted for age group and sex."""
    exposures = {**_COX_EXPOSED, "bedroom_sharing": None}
    fits = cox_batch(
        data.cohort(spark, folder), "time", "event", exposures,
        adjust=[Cat("agegr10", AGES), Cat("sex", ("M", "F"))],
    )
    return rounded(fits, *ALL_HAZARD)


@register(
    "cox_adjusted",
    sql(
        model_sql.cox_fits({"all": (_FOLLOWED, {
            **_AGE_COLUMNS, **_SEX_COLUMNS, **model_sql.indicators("SesScoreQnt", SES),
        })}, key=""),
        "cohort",
    ),
)
def cox_adjusted(spark, folder):
    """Age group, sex and socio-economic status together."""
    fit = cox_hr(
        data.cohort(spark, folder), "time", "event",
        [Cat("agegr10", AGES), Cat("sex", ("M", "F")), Cat("SesScoreQnt", SES)],
    )
    return rounded(fit, *ALL_HAZARD)


@register(
    "cox_numeric_age",
    sql(
        model_sql.cox_fits({"all": (_FOLLOWED + " WHERE age > 15.99", {
            "age": "age", **_SEX_COLUMNS,
            **model_sql.indicators("publictransport_pastweek", TRANSPORT),
        })}, key=""),
        "cohort",
    ),
)
def cox_numeric_age(spark, folder):
    """Age in years as a number, adults only."""
    adults = data.cohort(spark, folder).where(F.col("age") > 15.99)
    fit = cox_hr(
        adults, "time", "event",
        [Num("age"), Cat("sex", ("M", "F")), Cat("publictransport_pastweek", ref="none")],
    )
    return rounded(fit, *ALL_HAZARD)


_POLY = """
WITH d AS (SELECT x - 9 AS u, x, y FROM (SELECT TRY_CAST(valorct AS DOUBLE) AS y,
    CASE WHEN coalesce(datacolheita_x, datacolheita_y) IS NOT NULL THEN
      greatest(0, datediff('day', data_inicio_sintomas,
        coalesce(datacolheita_x, datacolheita_y)))::DOUBLE END AS x
    FROM swabs WHERE testresult = 'positive')
  WHERE x BETWEEN 0 AND 18 AND y IS NOT NULL),
m AS (SELECT min(x) AS low, max(x) AS high, count(*)::DOUBLE AS m0, sum(u) AS m1,
    sum(u ** 2) AS m2, sum(u ** 3) AS m3, sum(u ** 4) AS m4, sum(y) AS q0,
    sum(u * y) AS q1, sum(u * u * y) AS q2 FROM d),
s AS (SELECT *, m0 * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3)
    + m2 * (m1 * m3 - m2 * m2) AS det FROM m),
c AS (SELECT low, high,
    (q0 * (m2 * m4 - m3 * m3) - m1 * (q1 * m4 - q2 * m3)
      + m2 * (q1 * m3 - q2 * m2)) / det AS c0,
    (m0 * (q1 * m4 - q2 * m3) - q0 * (m1 * m4 - m2 * m3)
      + m2 * (m1 * q2 - m2 * q1)) / det AS c1,
    (m0 * (m2 * q2 - m3 * q1) - m1 * (m1 * q2 - m2 * q1)
      + q0 * (m1 * m3 - m2 * m2)) / det AS c2
  FROM s)
SELECT round(x, 6) AS x, round(c0 + c1 * (x - 9) + c2 * (x - 9) ** 2, 6) AS fit
FROM (SELECT *, low + (high - low) * i / 79 AS x FROM c, range(80) AS r(i))
"""


@register("poly_ols", sql(_POLY, "swabs"))
def quadratic_trend(spark, folder):
    confirmed = data.swabs(spark, folder).where(F.col("testresult") == "positive")
    measured = confirmed.withColumns(
        {"delay": clamped_delay(), "ct": fn.to_number("valorct")}
    )
    return rounded(poly_ols(measured, "delay", "ct", (0, 18)), "x", "fit").select(
        "x", "fit"
    )


# The inverse of the normal equations by cofactors, the t quantile by its expansion
# about the normal one.
_BAND = _POLY.split("SELECT round(x, 6)")[0].rstrip() + f""",
r AS (SELECT sum((y - c0 - c1 * u - c2 * u * u) ** 2) AS rss FROM d, c),
t AS (SELECT m0 - 3 AS f, z + (z ** 3 + z) / (4 * f)
    + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * f ** 2)
    + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * f ** 3) AS q
  FROM m, (SELECT {model_sql.Z} AS z)),
g AS (SELECT x, x - 9 AS v, c0 + c1 * (x - 9) + c2 * (x - 9) ** 2 AS fit
  FROM (SELECT *, low + (high - low) * i / 79 AS x FROM c, range(80) AS r(i))),
b AS (SELECT x, fit, q * sqrt(rss / f / det * ((m2 * m4 - m3 * m3)
    + 2 * v * (m2 * m3 - m1 * m4) + v ** 2 * (m0 * m4 - m2 * m2)
    + 2 * v ** 2 * (m1 * m3 - m2 * m2) + 2 * v ** 3 * (m1 * m2 - m0 * m3)
    + v ** 4 * (m0 * m2 - m1 * m1))) AS margin FROM g, s, t, r)
SELECT round(x, 6) AS x, round(fit, 6) AS fit, round(fit - margin, 6) AS conf_low,
  round(fit + margin, 6) AS conf_high FROM b
"""


@register("poly_ols_band", sql(_BAND, "swabs"))
def quadratic_band(spark, folder):
    """The same fit with its confidence band."""
    confirmed = data.swabs(spark, folder).where(F.col("testresult") == "positive")
    measured = confirmed.withColumns(
        {"delay": clamped_delay(), "ct": fn.to_number("valorct")}
    )
    return rounded(
        poly_ols(measured, "delay", "ct", (0, 18)), "x", "fit", "conf_low", "conf_high"
    )
