"""Active follow-up of households: epidemic curve, risk factors, incidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsmith import functions as fn
from cohortsmith.models import Cat, Num, cox_batch, cox_hr, poly_ols
from cohortsmith.operators import filters, rates, series
from cohortsmith.operators import frequencies as freq
from cohortsmith.operators.frequencies import Exposure
from cohortsmith.operators.joins import cohort_episode_join
from cohortsmith.operators.quantiles import quantile_summary
from cohortsmith.plans.covariates import CHILDREN, NO, OUTCOMES, RESULTS, YES
from cohortsmith.plans.symptom_study import Outputs
from cohortsmith.session import materialize, tune

# Study calendar of the moving average and map extent.
SPINE = ("2020-12-15", "2022-01-15")
MAP = {"left": 32.59, "bottom": -25.95, "right": 32.625, "top": -25.923}
SERIES = {"negative": "PCR negative cases", "positive": "PCR confirmed cases"}

# Reference categories.
REFERENCES = {
    "sex": "M", "SesScoreQnt": "5. highest", "education": "secondary",
    "leukemia": "not", "publictransport_pastweek": "none", "lungdisease": "not",
    "heart": "not", "tbbin": "not",
}

# Answers recoded to 0/1 before the models.
CODED = [
    "toylet_sharing", "water_availability", "soap_availability", "health_worker", "smokingbin",
]

# Exposures of the adjusted models, and the adult-only ones.
HOUSEHOLD = [
    "smokingbin", "publictransport_pastweek", "bedroom_sharing", "toylet_sharing",
    "handwash", "water_availability", "soap_availability",
]
COMORBID = [
    "hivbin", "tbbin", "hypertensionbin", "diabetesbin", "heart", "lungdisease",
    "leukemia", "pregnant",
]
ADULT_ONLY = ["SesScoreQnt", "education", "health_worker"]
NOT_STACKED = ("pregnant", "soap_availability")

CHARACTERISTICS = [
    "agegr10", "sex", "hypertensionbin", "diabetesbin", "hivbin", "SesScoreQnt",
    "education",
]


def case_outputs(cases: DataFrame, spine: tuple[str, str] = SPINE) -> Outputs:
    """Epidemic curve, description of the cases, delays and Ct values."""
    tune(cases.sparkSession)
    cases = materialize(cases, "cases")
    filled = cases.withColumn(
        "testresult", fn.fill_missing_category("testresult", RESULTS[0], RESULTS)
    )
    signs = [F.col(s) == "Sim" for s in ("throat", "cough", "dyspnoea", "rhinorrhea")]
    flagged = cases.withColumn(
        "atleastonesympt", fn.any_of_flags([*signs, F.col("oxygen_saturation") < 95])
    )
    delayed = cases.withColumns({
        "delay": fn.clamp_floor(fn.delay_days("datacolheita", "data_inicio_sintomas")),
        "raw_delay": fn.delay_days("datacolheita", "data_inicio_sintomas"),
        "ct": fn.to_number("valorct"),
    })
    confirmed = delayed.where(F.col("testresult") == "positive")

    def moving_average():
        daily = series.daily_counts(
            cases.where(F.col("testresult").isin(*SERIES)), "datacolheita", "testresult"
        )
        spined = series.spine_join(daily, "testresult", *spine)
        return series.rolling_mean_centered(spined, "testresult").withColumn(
            "result", fn.recode_map("testresult", SERIES)
        )

    def share(column):
        return lambda: freq.freq_share(cases, column)

    return {
        "weekly_cases": lambda: series.epicurve_weekly(filled, "week", "testresult"),
        "monthly_positivity": lambda: freq.monthly_positivity(
            filled, "monthonset", "testresult", "positive", RESULTS[0]
        ),
        "persons_with_episode": lambda: freq.distinct_count(cases, "individualid"),
        "cases_per_visit": lambda: freq.freq_table(cases, "visitid", use_na=True),
        "age_by_result": lambda: quantile_summary(cases, "age", ["testresult"]),
        "age_groups": share("agegr"),
        "sexes": share("GENDER"),
        "fever": share("fever"),
        "anosmia": share("anosmia"),
        "ageusia": share("ageusia"),
        "respiratory": lambda: freq.freq_share(flagged, "atleastonesympt"),
        "onset_to_swab": lambda: quantile_summary(delayed, "raw_delay", mean=True),
        "results": lambda: freq.freq_table(cases, "testresult", use_na=True),
        "result_shares": share("testresult"),
        "monthly_cases": lambda: freq.monthly_counts(cases, "monthonset", "testresult"),
        "month_by_result": lambda: freq.crosstab_row_share(
            cases, "monthonset", "testresult"
        ),
        "moving_average": moving_average,
        "moving_average_stacked": lambda: series.stacked_daily(
            moving_average(), "date", "result", "ma"
        ),
        "delay": lambda: quantile_summary(delayed, "delay"),
        "delay_by_age": lambda: quantile_summary(delayed, "delay", ["agegr"]),
        "ct": lambda: quantile_summary(confirmed, "ct"),
        "ct_by_age": lambda: quantile_summary(confirmed, "ct", ["agegr"]),
        "ct_trend": lambda: poly_ols(confirmed, "delay", "ct", (0, 18)),
        "ct_scatter": lambda: series.scatter_by_group(
            confirmed, "delay", "ct", "agegr", (0, 20)
        ),
    }


def visit_outputs(visits: DataFrame) -> Outputs:
    return {
        "visits_with_symptoms": lambda: freq.freq_table(
            visits, "respiratory_symptoms", use_na=True
        ),
        "weekly_visits": lambda: series.epicurve_weekly(
            visits, "contact_date", "respiratory_symptoms"
        ),
    }


def map_outputs(visited: DataFrame, cases: DataFrame, step: float = 0.0005) -> Outputs:
    """Visits and cases per grid cell of the mapped area."""

    def inside(points):
        return filters.bbox_filter(points, "longitude", "latitude", **MAP)

    return {
        "visits_per_cell": lambda: series.point_density(
            inside(visited), "longitude", "latitude", step, weight="n"
        ),
        "cases_per_cell": lambda: series.point_density(
            inside(cases), "longitude", "latitude", step, by=["testresult"]
        ),
    }


def outcome_outputs(
    participants: DataFrame,
    cases: DataFrame,
    person: str = "openhdsindividualId",
) -> Outputs:
    """Participants by outcome, with the age histogram."""
    episodes = freq.episodes_per_person(
        cases, "individualid", fn.event_flag("testresult", "positive")
    )
    joined = materialize(
        cohort_episode_join(
            participants, person, episodes, "individualid"
        ).withColumn(
            "possibleconfirmed", fn.outcome_tier("n_episodes", "n_confirmed", OUTCOMES)
        ),
        "outcomes",
    )
    return {
        "episodes": lambda: freq.freq_table(joined, "n_episodes", use_na=True),
        "confirmed": lambda: freq.freq_table(joined, "n_confirmed", use_na=True),
        "outcomes": lambda: freq.freq_table(joined, "possibleconfirmed", OUTCOMES),
        "age_histogram": lambda: series.histogram(joined, "age", "possibleconfirmed"),
    }


def cohort_outputs(
    cohort: DataFrame,
    cases: DataFrame | None = None,
    children: str = CHILDREN,
) -> Outputs:
    """Description of the cohort, univariable tables, Cox models and rates."""
    tune(cohort.sparkSession)
    cohort = materialize(cohort, "cohort")
    adult = F.col("agegr") != children
    coded = cohort.withColumns(
        {c: fn.recode_binary(c, YES, NO) for c in CODED}
    )
    age, sex = Cat("agegr10"), Cat("sex", ref=REFERENCES["sex"])

    def category(name):
        return Cat(name, ref=REFERENCES.get(name))

    def model(*terms, data=cohort):
        return lambda: cox_hr(data, "time", "event", terms)

    def batch(data, names, *adjust):
        exposures = {n: REFERENCES.get(n) for n in names}
        return lambda: cox_batch(data, "time", "event", exposures, adjust)

    def univariable():
        specs = [
            Exposure("agegr10", "keep_null"), Exposure("sex", "keep_null"),
            *[Exposure(v, scoped=True) for v in ADULT_ONLY],
            *[Exposure(v) for v in (*HOUSEHOLD, *COMORBID, "overweight")],
        ]
        return freq.univariable_table(cohort, specs, "event", scope=adult)

    def rate(by=()):
        return lambda: rates.incidence_rate(cohort, "time", "event", by)

    outputs = {
        "participants": lambda: freq.row_count(cohort),
        "households": lambda: freq.group_size_mean(cohort, "locationid"),
        "age": lambda: quantile_summary(cohort, "age"),
        **{
            f"{c}_{kind}": (lambda c=c, make=make, na=na: make(cohort, c, use_na=na))
            for c in CHARACTERISTICS
            for kind, make, na in (
                ("counts", freq.freq_table, True), ("shares", freq.freq_share, False)
            )
        },
        "univariable": univariable,
        "univariable_stacked": lambda: univariable().where(
            ~F.col("variable").isin(*NOT_STACKED)
        ),
        "hr_age_sex": model(age, sex),
        "hr_ses_adults": model(age, category("SesScoreQnt"), data=cohort.where(adult)),
        "hr_education_adults": model(
            age, category("education"), data=cohort.where(adult)
        ),
        "hr_health_worker_adults": model(
            age, Cat("health_worker"), data=cohort.where(adult)
        ),
        "hr_exposures": batch(coded, [*HOUSEHOLD, *COMORBID], age, sex),
        "hr_overweight": model(
            Num("age"), sex, Cat("overweight"), data=cohort.where(F.col("age") > 15.99)
        ),
        "hr_ses": model(age, sex, category("SesScoreQnt")),
        "hr_education": model(
            category("education"), sex, Cat("agegr10", ref="20-29"),
            data=cohort.where(~F.col("agegr10").isin("0-9", "10-19")),
        ),
        "hr_transport": model(Num("age"), sex, category("publictransport_pastweek")),
        "hr_health_worker": model(age, sex, Cat("health_worker"), data=coded),
        "incidence": rate(),
        "incidence_by_age": rate(["agegr"]),
    }
    if cases is not None:
        outputs["illness_incidence"] = lambda: rates.episode_incidence(
            cohort, cases, "time"
        )
    return outputs


def with_ci_label(fits: DataFrame) -> DataFrame:
    """Display form of a Cox result: rounded ratio and interval text."""
    label = fn.ci_label(F.col("ci_lower"), F.col("ci_upper")).alias("Combined_CI")
    shown = filters.round_numeric(fits).select(*fits.columns)
    return shown.select("term", "hazard_ratio", label)
