"""Repeated sero-surveys: prevalence over time and risk factors of infection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsmith import functions as fn
from cohortsmith.models import Cat, cox_batch, cox_hr
from cohortsmith.operators import filters, rates, visits
from cohortsmith.operators import frequencies as freq
from cohortsmith.operators.frequencies import Exposure
from cohortsmith.operators.quantiles import quantile_summary
from cohortsmith.plans.covariates import (
    AFTER_VACCINE,
    AGE_GROUPS,
    CHILDREN,
    INFECTED,
    NEGATIVE,
    RESULT_DEFINITIONS,
    VACCINATED,
    sero_result,
    with_covariates,
)
from cohortsmith.plans.symptom_study import Outputs
from cohortsmith.session import materialize, tune
from cohortsmith.sources.schemas import SERO_BASELINE

PERSON, DATE, MAIN = "pseudoID", "datacolheita", "seroresultRBD_NP"

# Fixed value: later samples were not all tested.
CUTOFF = date(2021, 8, 1)

# Reference categories.
REFERENCES = {
    "SesScoreQnt": "5. highest", "education": "secondary", "sex": "M",
    "heart": "not", "leukemia": "not", "tbbin": "not", "lungdisease": "not",
    "water_availability": "Disponivel", "publictransport_pastweek": "none",
    "smokingbin": "non smoker",
}

# Exposures adjusted for age only, and for age and sex.
BEHAVIOUR = [
    "smokingbin", "publictransport_pastweek", "bedroom_sharing", "toylet_sharing",
    "handwash", "water_availability", "soap_availability", "health_worker", "did_work",
]
HEALTH = [
    "overweight", "hivbin", "tbbin", "hypertensionbin", "diabetesbin", "heart",
    "lungdisease", "leukemia", "pregnant",
]
ALL_ROWS = ["agegr10", "sex", "lowestSES"]
ADULT_ONLY = ["SesScoreQnt", "education", "health_worker"]
OTHERS = [
    "hivbin", "hypertensionbin", "diabetesbin", "overweight",
    "publictransport_pastweek", "smokingbin", "pregnant", "tbbin", "lungdisease",
    "heart", "leukemia", "bedroom_sharing", "toylet_sharing", "handwash",
    "water_availability", "soap_availability", "inside_outside_city", "did_work",
    "would_stay_home", "wore_mask_yesterday",
]


def classified_samples(
    survey: DataFrame, order: tuple[str, ...] = (), cutoff: date = CUTOFF
) -> DataFrame:
    """Complete samples before the cut-off, one per person and date, classified.

    Of several samples of a person on a date the first under ``order`` stays;
    without ``order`` all columns decide, so that the choice does not depend on
    how the rows are distributed.
    """
    early = filters.date_cutoff(survey, DATE, cutoff)
    complete = filters.not_null(early, "agegr10", DATE, "analyte25_RBD")
    unique = visits.dedupe_visits(complete, PERSON, DATE, order or complete.columns)
    return unique.withColumns({
        "agegr": fn.as_factor("agegr", AGE_GROUPS),
        "month": fn.month_key(DATE),
        **{name: sero_result(name) for name in RESULT_DEFINITIONS},
    })


def survival_rows(samples: DataFrame) -> DataFrame:
    """One row per unvaccinated participant, with the analysis variables."""
    return with_covariates(raw_survival_rows(samples))


def raw_survival_rows(samples: DataFrame) -> DataFrame:
    """Event, time and the answers of the first sample of every unvaccinated participant."""
    first = [c for c in [*SERO_BASELINE, "BMI"] if c in samples.columns]
    extra = [c for c in ("mean_n_contactos", "age") if c in samples.columns]
    return visits.survival_table(
        filters.unvaccinated(samples, "vacinated", VACCINATED),
        PERSON, DATE, MAIN, INFECTED, first=[*first, *extra], last=["hiv"],
    )


def serosurvey_study(
    survey: DataFrame, order: tuple[str, ...] = (), cutoff: date = CUTOFF
) -> Outputs:
    """All tables and models of the study; each is computed when called."""
    tune(survey.sparkSession)
    samples = materialize(classified_samples(survey, order, cutoff), "samples")
    people = materialize(survival_rows(samples), "survival")
    adult = F.col("agegr") != CHILDREN
    age, sex = Cat("agegr10"), Cat("sex", ref=REFERENCES["sex"])

    def category(name):
        return Cat(name, ref=REFERENCES.get(name))

    def one_per_person():
        return visits.first_per_group(
            samples.select(PERSON, DATE, "sex", "agegr10", "age"), [PERSON], [DATE]
        )

    def prevalence(result, *by):
        return lambda: rates.prevalence_ci(samples, result, by)

    def model(*terms, data=people):
        return lambda: cox_hr(data, "time", "event", terms)

    def batch(names, *adjust):
        exposures = {n: REFERENCES.get(n) for n in names}
        return lambda: cox_batch(people, "time", "event", exposures, adjust)

    def univariable():
        specs = [
            *[Exposure(v, "all_rows") for v in ALL_ROWS],
            *[Exposure(v, scoped=True) for v in ADULT_ONLY],
            *[Exposure(v) for v in OTHERS],
        ]
        return freq.univariable_table(people, specs, "event", scope=adult)

    return {
        "samples": lambda: freq.row_count(samples),
        **{
            f"results_{name}": (
                lambda name=name: freq.freq_table(samples, name, use_na=True)
            )
            for name in RESULT_DEFINITIONS
        },
        "ever_positive": lambda: freq.ever_positive_pct(
            samples, PERSON,
            {
                "positive": F.col(MAIN).contains("positive"),
                "infected": F.col(MAIN).contains(INFECTED),
            },
        ),
        "seroreversion": lambda: visits.lead_transition(
            samples, PERSON, DATE, MAIN, INFECTED, NEGATIVE
        ),
        "result_after_positive": lambda: visits.followed_after_positive(
            samples, PERSON, DATE, MAIN, INFECTED
        ),
        "seroreversion_share": lambda: visits.reversion_share(
            samples, PERSON, DATE, MAIN, INFECTED, NEGATIVE
        ),
        "age": lambda: quantile_summary(one_per_person(), "age", mean=True),
        "age_groups": lambda: freq.freq_share(one_per_person(), "agegr10", use_na=True),
        "sample_sexes": lambda: freq.freq_share(samples, "sex", use_na=True),
        "sample_age_groups": lambda: freq.freq_table(
            samples, "agegr", AGE_GROUPS, use_na=True
        ),
        **{f"prevalence_{r}": prevalence(r, "month") for r in RESULT_DEFINITIONS},
        "prevalence_by_age": prevalence(MAIN, "agegr", "month"),
        "prevalence_by_age_2Ag": prevalence("seroresult2Ag", "agegr", "month"),
        "prevalence_chart": lambda: rates.stack_ci_offset(
            prevalence(MAIN, "agegr", "month")(), MAIN, ["agegr", "month"], INFECTED,
            AFTER_VACCINE,
        ),
        "survival": lambda: people,
        "univariable": univariable,
        "contacts_by_event": lambda: freq.mean_by_event(
            people, "mean_n_contactos", "event"
        ),
        "hr_age": model(age),
        "hr_age_sex": model(age, sex),
        "hr_ses_adults": model(age, category("SesScoreQnt"), data=people.where(adult)),
        "hr_education_adults": model(
            age, category("education"), data=people.where(adult)
        ),
        "hr_behaviour": batch(BEHAVIOUR, age),
        "hr_health": batch(HEALTH, age, sex),
        "hr_overweight": model(
            age, sex, Cat("overweight"), data=people.where(F.col("age") > 15.99)
        ),
        "hr_transport": model(age, sex, category("publictransport_pastweek")),
    }
