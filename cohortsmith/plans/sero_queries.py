"""The sero-survey from samples to risk factors: survival rows, tables and Cox models.

Every query starts from the samples: complete ones before a date, one per person and day,
classified, unvaccinated, reduced to one row per person with all baseline answers of the
first sample, recoded.
"""

from datetime import date

from pyspark.sql import functions as F

from cohortsmith.models import Cat, cox_batch, cox_hr
from cohortsmith.operators import frequencies as freq
from cohortsmith.operators.frequencies import Exposure
from cohortsmith.plans import bindings as data
from cohortsmith.plans import covariates as study
from cohortsmith.plans import model_sql, serosurvey_study
from cohortsmith.plans.bindings import sql
from cohortsmith.plans.model_queries import ALL_HAZARD
from cohortsmith.plans.registry import register
from cohortsmith.plans.serosurvey_study import REFERENCES
from cohortsmith.plans.table_queries import rounded, univariable_sql
from cohortsmith.session import materialize, tune
from cohortsmith.sources.schemas import SERO_BASELINE

CUTOFF = date(1998, 1, 1)
BASELINE = [*SERO_BASELINE, "BMI", "mean_n_contactos", "age"]


def people(spark, folder):
    """One row per unvaccinated participant, with raw answers and analysis variables."""
    tune(spark)
    samples = serosurvey_study.classified_samples(
        data.sero_panel(spark, folder), ("sampleid",), CUTOFF
    )
    return serosurvey_study.survival_rows(samples)


_SAMPLES = """
samples AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pseudoID, datacolheita
      ORDER BY sampleid) AS rn,
      CASE WHEN analyte26_NP IS NULL THEN NULL
        WHEN analyte25_RBD >= 1 AND analyte26_NP >= 1 AND vacinated LIKE '%Sim%'
          THEN 'positive after vaccination'
        WHEN analyte25_RBD >= 1 AND analyte26_NP >= 1 THEN 'positive after infection'
        ELSE 'negative' END AS result
    FROM sero_panel WHERE agegr10 IS NOT NULL AND datacolheita < DATE '1998-01-01'
      AND analyte25_RBD IS NOT NULL)
  WHERE rn = 1 AND (vacinated IS NULL OR vacinated NOT LIKE '%Sim%')),
timed AS (
  SELECT *, lag(result, 1, '') OVER w AS previous,
    coalesce(datediff('day', lag(datacolheita) OVER w, datacolheita), 90)
      / CASE WHEN result = 'positive after infection' THEN 2.0::DOUBLE ELSE 1 END AS days
  FROM samples WINDOW w AS (PARTITION BY pseudoID ORDER BY datacolheita)),
kept AS (SELECT * FROM timed WHERE NOT coalesce(
  previous = 'positive after infection' AND result = 'positive after infection',
  previous IS NULL OR result IS NULL)),
"""

_FIRST = ", ".join(f"arg_min_null({c}, datacolheita) AS {c}" for c in BASELINE)

_RAW = _SAMPLES + f"""raw AS (
  SELECT pseudoID, CAST(coalesce(bool_or(result = 'positive after infection'), FALSE) AS INT)
      AS event, sum(days) / 30 AS time, min(datacolheita) AS inclusiondate,
    count(*) AS nsurveys, {_FIRST}, arg_max_null(hiv, datacolheita) AS hiv
  FROM kept GROUP BY pseudoID)
"""


def _last_match(column: str, *rules: tuple[str, str], base: str = "NULL") -> str:
    whens = " ".join(
        f"WHEN contains({column}, '{text}') THEN {value}" for text, value in rules[::-1]
    )
    return f"CASE {whens} ELSE {base} END"


def _listed(column: str, codes: dict, base: str = "NULL") -> str:
    def shown(value):
        return f"'{value}'" if isinstance(value, str) else str(value)

    whens = " ".join(f"WHEN {column} = '{k}' THEN {shown(v)}" for k, v in codes.items())
    return f"CASE {whens} ELSE {base} END"


_PEOPLE = _RAW + f""", people AS (
  SELECT * REPLACE ({_last_match("bedroom_sharing", ("6", "'3 a 5'"), base="bedroom_sharing")}
      AS bedroom_sharing),
    CASE WHEN SesScoreQnt = '1. very low' THEN 1 WHEN SesScoreQnt IS NOT NULL THEN 0 END
      AS lowestSES,
    CASE WHEN BMI > 8 AND BMI < 19 THEN 'underweight' WHEN BMI > 29.99 AND BMI < 50
        THEN 'obesity' WHEN BMI > 24.99 AND BMI < 30 THEN 'overweight'
      WHEN BMI IS NOT NULL THEN 'normal' END AS overweight,
    {_last_match("ednivel_educacao", ("cundario incom", "'primary'"),
                 base=_listed("ednivel_educacao", study.EDUCATION_CODES))} AS education,
    {_listed("hiv", study.HIV_CODES, _last_match("hiv", ("Seropositivo", "1")))} AS hivbin,
    {_listed("main_bus", study.TRANSPORT_CODES, _listed("mass_bus", {"Não": "none"}))}
      AS publictransport_pastweek,
    {_last_match("main_bus", ("Sim", "'pregnant'"), ("Não", "'not'"))} AS pregnant,
    {_last_match("hypertension", ("Não", "0"), ("Diagnosticado,", "1"), ("Diagnostico", "1"))}
      AS hypertensionbin,
    {_last_match("diabet", ("Não", "0"), ("Diagnosticado,", "1"))} AS diabetesbin,
    {_last_match("smoking", ("fumador", "'(ex-)smoker'"), ("Fumador", "'(ex-)smoker'"),
                 ("Nao", "'non smoker'"), ("Nunca", "'non smoker'"))} AS smokingbin,
    {_last_match("chronic_lung_disease", ("Nao", "'not'"), ("asma", "'asthma'"),
                 ("outra", "'chronic pulmonary disease'"))} AS lungdisease,
    CASE WHEN contains(cancer, 'malignidade hemato') THEN 'leukemia'
      WHEN cancer IS NOT NULL THEN 'not' END AS leukemia,
    CASE WHEN contains(hearth_diseases, 'Diagno') THEN 'heart disease'
      WHEN hearth_diseases IS NOT NULL THEN 'not' END AS heart,
    CASE WHEN contains(tb, 'tubercu') THEN '(history of) tuberculosis'
      WHEN tb IS NOT NULL THEN 'not' END AS tbbin
  FROM raw)
"""


def _sql(body: str, people: str = _PEOPLE) -> str:
    text = body.strip().removeprefix("WITH ")
    joined = ", " if body.strip().startswith("WITH ") else " "
    return sql(f"WITH {people}{joined}{text}", "sero_panel")


@register("sero_survival_rows", _sql("SELECT * FROM raw", _RAW))
def sero_survival_rows(spark, folder):
    """Event, time and all 46 answers of the first sample, one row per participant."""
    shown = ["pseudoID", "event", "time", "inclusiondate", "nsurveys", *BASELINE, "hiv"]
    samples = serosurvey_study.classified_samples(
        data.sero_panel(spark, folder), ("sampleid",), CUTOFF
    )
    return serosurvey_study.raw_survival_rows(samples).select(*shown)


_RECODED = [
    "lowestSES", "overweight", "education", "hivbin", "publictransport_pastweek", "pregnant",
    "bedroom_sharing", "hypertensionbin", "diabetesbin", "smokingbin", "lungdisease",
    "leukemia", "heart", "tbbin",
]


@register("sero_covariates", _sql(f"SELECT pseudoID, {', '.join(_RECODED)} FROM people"))
def sero_covariates(spark, folder):
    return people(spark, folder).select("pseudoID", *_RECODED)


_TABLES = " UNION ALL ".join(f"SELECT * FROM ({part})" for part in [
    univariable_sql(serosurvey_study.ALL_ROWS, "all_rows", view="people"),
    univariable_sql(
        serosurvey_study.ADULT_ONLY, "known_only", "agegr <> '0-17 years'", "people"
    ),
    univariable_sql(serosurvey_study.OTHERS, "known_only", view="people"),
])


@register("sero_univariable", _sql(_TABLES))
def sero_univariable(spark, folder):
    """All univariable tables of the sero-survey from one scan."""
    specs = [
        *[Exposure(v, "all_rows") for v in serosurvey_study.ALL_ROWS],
        *[Exposure(v, scoped=True) for v in serosurvey_study.ADULT_ONLY],
        *[Exposure(v) for v in serosurvey_study.OTHERS],
    ]
    return freq.univariable_table(
        people(spark, folder), specs, "event", scope=F.col("agegr") != study.CHILDREN
    )


# The values every variable has in the tables, reference first.
LEVELS = {
    "agegr10": ("0-19", "20-39", "40-59", ">=60"),
    "sex": ("M", "F"),
    "SesScoreQnt": ("5. highest", "1. very low", "2. low", "3. med.", "4. high"),
    "education": ("secondary", "higher", "none completed", "primary"),
    "overweight": ("normal", "obesity", "overweight", "underweight"),
    "publictransport_pastweek": ("none", "bus/train", "moto taxi/shared taxi"),
    "smokingbin": ("non smoker", "(ex-)smoker"),
    "bedroom_sharing": ("1 a 2", "3 a 5"),
    "toylet_sharing": ("no", "yes"), "handwash": ("no", "yes"),
    "water_availability": ("Disponivel", "Nao disponivel"),
    "soap_availability": ("no", "yes"), "health_worker": ("no", "yes"),
    "did_work": ("no", "yes"),
    "hivbin": ("0", "1"), "tbbin": ("not", "(history of) tuberculosis"),
    "hypertensionbin": ("0", "1"), "diabetesbin": ("0", "1"),
    "heart": ("not", "heart disease"),
    "lungdisease": ("not", "asthma", "chronic pulmonary disease"),
    "leukemia": ("not", "leukemia"), "pregnant": ("pregnant",),
}


def _columns(*names: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name in names:
        found = model_sql.indicators(name, LEVELS[name])
        out |= found
    return out


def _rows(*known: str, where: str = "TRUE") -> str:
    """People with values in variables that have a single level and so no column."""
    single = [k for k in known if len(LEVELS[k]) == 1]
    conditions = " AND ".join([where, *[f"{k} IS NOT NULL" for k in single]])
    return f"SELECT *, time AS t FROM people WHERE {conditions}"


def _batch_models(names, *adjust):
    return {n: (_rows(n), _columns(n, *adjust)) for n in names}


def _fits(spark, folder, names, *adjust):
    exposures = {n: REFERENCES.get(n) for n in names}
    fits = cox_batch(
        people(spark, folder), "time", "event", exposures,
        [Cat(a, ref=REFERENCES.get(a)) for a in adjust],
    )
    return rounded(fits, *ALL_HAZARD)


@register(
    "sero_cox_behaviour",
    _sql(model_sql.cox_fits(_batch_models(serosurvey_study.BEHAVIOUR, "agegr10"))),
)
def sero_cox_behaviour(spark, folder):
    """Nine exposures, each adjusted for age group."""
    return _fits(spark, folder, serosurvey_study.BEHAVIOUR, "agegr10")


@register(
    "sero_cox_health",
    _sql(model_sql.cox_fits(_batch_models(serosurvey_study.HEALTH, "agegr10", "sex"))),
)
def sero_cox_health(spark, folder):
    """Nine conditions, each adjusted for age group and sex."""
    return _fits(spark, folder, serosurvey_study.HEALTH, "agegr10", "sex")


_ADULT = "agegr <> '0-17 years'"
SINGLE = {
    "age": (("agegr10",), "TRUE"),
    "age_sex": (("agegr10", "sex"), "TRUE"),
    "ses_adults": (("agegr10", "SesScoreQnt"), _ADULT),
    "education_adults": (("agegr10", "education"), _ADULT),
    "overweight": (("agegr10", "sex", "overweight"), "age > 15.99"),
    "transport": (("agegr10", "sex", "publictransport_pastweek"), "TRUE"),
}


@register(
    "sero_cox_single",
    _sql(model_sql.cox_fits({
        name: (_rows(where=where), _columns(*terms)) for name, (terms, where) in SINGLE.items()
    })),
)
def sero_cox_single(spark, folder):
    """The models of one formula each."""
    rows = materialize(people(spark, folder), "survival")
    fits = {
        name: cox_hr(
            rows.where(where), "time", "event",
            [Cat(t, ref=REFERENCES.get(t)) for t in terms],
        )
        for name, (terms, where) in SINGLE.items()
    }
    return rounded(freq.stack_tables(fits, "model"), *ALL_HAZARD)
