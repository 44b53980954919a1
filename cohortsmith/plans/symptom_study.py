"""Symptoms associated with a positive test among possible cases."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsmith import functions as fn
from cohortsmith.models import Cat, Inter, Num, logistic_batch, logistic_or
from cohortsmith.operators import filters
from cohortsmith.operators import frequencies as freq
from cohortsmith.operators.quantiles import quantile_summary
from cohortsmith.plans.covariates import ERA_STARTS, ERAS, NO, YES
from cohortsmith.session import materialize, tune

# Symptoms in the order of the tables.
TABULATED = [
    "fever", "throat", "dyspnoea", "anosmia", "ageusia", "fatigue", "O2under92",
    "O2under95", "cough", "rhinorrhea", "chest_pain", "nausea", "headache", "vomit",
    "appitite_loss", "diarrhea", "nosebleed", "consciousness_change", "convulsions",
    "chills", "myalgia", "arthromyalgia", "rash",
]

# Symptoms in the models; nosebleed keeps its raw answers.
MODELLED = [
    "fever", "throat", "rhinorrhea", "dyspnoea", "cough", "chest_pain", "vomit",
    "anosmia", "ageusia", "chills", "nausea", "diarrhea", "arthromyalgia", "myalgia",
    "fatigue", "O2under95", "appitite_loss", "rash", "headache",
]
RAW = ["nosebleed"]

# Symptoms modelled within the waves.
LAST_WAVE = ["anosmia", "ageusia", "appitite_loss", "chills"]
EARLIER_WAVES = ["anosmia", "ageusia"]

Outputs = dict[str, Callable[[], DataFrame]]


def symptom_study(
    cases: DataFrame,
    age_reference: str = "0-9",
    ses_reference: str = "3. med.",
    sex_reference: str = "M",
    era_starts: Sequence[str] = ERA_STARTS,
    conf: str = "profile",
) -> Outputs:
    """All tables and models of the study; each is computed when called.

    The tested cases are written once, so the raw file is parsed a single time
    for all outputs.
    """
    tune(cases.sparkSession)
    tested = materialize(
        filters.tested_only(cases, "testresult").withColumns({
            "O2under95": fn.threshold_flag("oxygen_saturation", 95),
            "O2under92": fn.threshold_flag("oxygen_saturation", 92),
        }),
        "tested",
    )
    coded = tested.withColumns({
        **{s: fn.recode_binary(s, YES, NO) for s in MODELLED},
        "testresult": fn.recode_binary("testresult", YES, NO),
        "variant": fn.era_from_month("monthonset", era_starts, ERAS),
    })
    known_age = filters.not_null(coded, "agegr10")
    age = Cat("agegr10", ref=age_reference)
    sex = Cat("GENDER", ref=sex_reference)
    ses = Cat("SesScoreQnt", ref=ses_reference)
    exposures = {**{s: ["0", "1"] for s in MODELLED}, **{s: None for s in RAW}}
    last = F.col("variant") == ERAS[-1]

    def model(*terms, data=coded):
        return lambda: logistic_or(data, "testresult", terms, conf=conf)

    def batch(data, names, *adjust):
        chosen = {s: exposures[s] for s in names}
        return lambda: logistic_batch(data, "testresult", chosen, adjust, conf=conf)

    def with_era(symptom):
        exposure, era = Num(symptom), Cat("variant", ERAS)
        return model(exposure, age, era, Inter(exposure, era), data=known_age)

    def table(column):
        return lambda: freq.crosstab(tested, column, "testresult", use_na=True)

    def shares(column):
        return lambda: freq.crosstab_col_share(tested, column, "testresult")

    return {
        "results": lambda: freq.freq_table(tested, "testresult", use_na=True),
        "result_shares": lambda: freq.freq_share(tested, "testresult"),
        "age_by_result": lambda: quantile_summary(tested, "age", ["testresult"]),
        "age_groups": table("agegr10"),
        "age_group_shares": shares("agegr10"),
        "sexes": table("GENDER"),
        "sex_shares": shares("GENDER"),
        "ses_shares": shares("SesScoreQnt"),
        "symptoms": lambda: freq.symptom_profile(tested, TABULATED, "testresult"),
        "eras": lambda: freq.freq_table(coded, "variant", levels=ERAS, use_na=True),
        "or_age": model(age),
        "or_sex": model(sex),
        "or_sex_by_age": model(sex, age),
        "or_ses_by_age": model(ses, age),
        "or_symptoms": batch(coded, exposures),
        "or_symptoms_by_age": batch(known_age, exposures, age),
        "or_anosmia_by_era": with_era("anosmia"),
        "or_ageusia_by_era": with_era("ageusia"),
        "or_last_era": batch(known_age.where(last), LAST_WAVE, age),
        "or_earlier_eras": batch(known_age.where(~last), EARLIER_WAVES, age),
    }
