"""Study categories: how raw answers become analysis variables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsmith.functions import (
    bin_numeric,
    flag_present,
    k_of_n_positive,
    override_vaccinated,
    overrides,
    recode_map,
    recode_pattern,
)

# Answers and labels of the study files.
YES = ("Sim", "yes", "positive", "(ex-)smoker")
NO = ("Não", "Não sabe", "no", "negative", "non smoker")
VACCINATED = "Sim"
INFECTED = "positive after infection"
AFTER_VACCINE = "positive after vaccination"
NEGATIVE = "negative"
AGE_GROUPS = ("0-17 years", "18-49 years", ">=50 years")
CHILDREN = "0-17 years"
OUTCOMES = ("participants", "COVID-19 negative", "confirmed COVID-19")
RESULTS = ("not tested", "negative", "positive")
ERAS = ("alpha/beta", "delta", "omikron")
ERA_STARTS = ("2021-06", "2021-11")

# Antigens of the three result definitions and how many of them
# have to be positive.
RESULT_DEFINITIONS = {
    "seroresultRBD_NP": (("analyte25_RBD", "analyte26_NP"), 2),
    "seroresult2Ag": (("analyte21_S1S2", "analyte25_RBD", "analyte26_NP"), 2),
    "seroresultRBD": (("analyte25_RBD",), 1),
}

# Body mass index classes as open intervals, later ones win.
BMI_CLASSES = (
    (24.99, 30.0, "overweight"),
    (29.99, 50.0, "obesity"),
    (8.0, 19.0, "underweight"),
)

# Education codes.
EDUCATION_CODES = {
    "1.  Primario incompleto": "none completed",
    "8. Nenhum": "none completed",
    "2. Primario completo": "primary",
    "7. Pos-graduacao": "higher",
    "6. Superior": "higher",
    "5. Tecnico-profissional": "higher",
    "4. Secundario completo": "secondary",
}
EDUCATION_TEXT = (("cundario incom", "primary"),)

# Means of transport.
TRANSPORT_CODES = {
    "taxi Nao partilhado com outros": "none",
    "minibus": "bus/train",
    "comboio": "bus/train",
    "autocarro publico": "bus/train",
    "taxi partilhado": "moto taxi/shared taxi",
    "moto taxi": "moto taxi/shared taxi",
}

# HIV status.
HIV_CODES = {
    "Crianca exposta": 1,
    "estado desconhecido": 0,
    "HIV negativo (no momento do ultimo teste HIV)": 0,
}
HIV_TEXT = (("Seropositivo", 1),)

# Text that decides a category, later rules win.
TEXT_RULES = {
    "hypertensionbin": (
        "hypertension", (("Não", 0), ("Diagnosticado,", 1), ("Diagnostico", 1))
    ),
    "diabetesbin": ("diabet", (("Não", 0), ("Diagnosticado,", 1))),
    "smokingbin": (
        "smoking",
        (
            ("fumador", "(ex-)smoker"), ("Fumador", "(ex-)smoker"),
            ("Nao", "non smoker"), ("Nunca", "non smoker"),
        ),
    ),
    "lungdisease": (
        "chronic_lung_disease",
        (("Nao", "not"), ("asma", "asthma"), ("outra", "chronic pulmonary disease")),
    ),
}

# Known answers mean "not" unless the text says otherwise.
PRESENT_RULES = {
    "leukemia": ("cancer", "malignidade hemato", "leukemia"),
    "heart": ("hearth_diseases", "Diagno", "heart disease"),
    "tbbin": ("tb", "tubercu", "(history of) tuberculosis"),
}


def sero_result(definition: str, vaccination: str = "vacinated") -> Column:
    """Result of a sample under one of the three definitions."""
    antigens, k = RESULT_DEFINITIONS[definition]
    return override_vaccinated(
        k_of_n_positive(antigens, k, INFECTED, NEGATIVE),
        INFECTED, vaccination, VACCINATED, AFTER_VACCINE,
    )


def baseline_covariates(pregnancy_source: str = "main_bus") -> Mapping[str, Column]:
    """Analysis variables of a participant from the raw baseline answers."""
    lowest = F.col("SesScoreQnt") == "1. very low"
    out = {
        "lowestSES": overrides(
            [(F.col("SesScoreQnt").isNotNull(), 0), (lowest, 1)]
        ),
        "overweight": bin_numeric("BMI", "normal", BMI_CLASSES),
        "education": recode_pattern(
            "ednivel_educacao", EDUCATION_TEXT,
            recode_map("ednivel_educacao", EDUCATION_CODES),
        ),
        "hivbin": recode_map("hiv", HIV_CODES, recode_pattern("hiv", HIV_TEXT)),
        "publictransport_pastweek": recode_map(
            "main_bus", TRANSPORT_CODES, recode_map("mass_bus", {"Não": "none"})
        ),
        "pregnant": recode_pattern(
            pregnancy_source, (("Sim", "pregnant"), ("Não", "not"))
        ),
        "bedroom_sharing": recode_pattern(
            "bedroom_sharing", (("6", "3 a 5"),), F.col("bedroom_sharing")
        ),
    }
    for name, (source, rules) in TEXT_RULES.items():
        out[name] = recode_pattern(source, rules)
    for name, (source, text, label) in PRESENT_RULES.items():
        out[name] = recode_pattern(
            source, ((text, label),), flag_present(source, "not")
        )
    return out


def with_covariates(df: DataFrame, pregnancy_source: str = "main_bus") -> DataFrame:
    return df.withColumns(dict(baseline_covariates(pregnancy_source)))
