"""Input tables by role.  Columns absent from a file are read as NULL."""

from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


def _schema(**groups: tuple[DataType, list[str]]) -> StructType:
    return StructType([
        StructField(name, kind, True)
        for kind, names in groups.values()
        for name in names
    ])


# Symptom answers of the case table (fixed column names).
SYMPTOMS = [
    "fever", "throat", "rhinorrhea", "dyspnoea", "cough", "chest_pain", "vomit",
    "chills", "appitite_loss", "nausea", "diarrhea", "headache", "rash",
    "conjunctivitis", "myalgia", "arthromyalgia", "anosmia", "ageusia", "fatigue",
    "nosebleed", "consciousness_change", "convulsions",
]

CASES = _schema(
    keys=(StringType(), ["individualid", "visitid"]),
    dates=(DateType(), ["week", "datacolheita", "data_inicio_sintomas"]),
    text=(
        StringType(),
        [
            "monthonset", "testresult", "agegr", "agegr10", "GENDER", "SesScoreQnt",
            "valorct",
        ] + SYMPTOMS,
    ),
    numbers=(DoubleType(), ["oxygen_saturation", "age"]),
)

COHORT = _schema(
    keys=(StringType(), ["openhdsindividualId", "locationid"]),
    numbers=(DoubleType(), ["time", "age"]),
    counts=(IntegerType(), ["event"]),
    text=(
        StringType(),
        [
            "agegr", "agegr10", "sex", "SesScoreQnt", "education", "health_worker",
            "toylet_sharing", "water_availability", "soap_availability", "smokingbin",
            "hypertensionbin", "diabetesbin", "hivbin", "overweight", "pregnant",
            "bedroom_sharing", "handwash", "publictransport_pastweek", "tbbin",
            "lungdisease", "heart", "leukemia",
        ],
    ),
)

# Baseline answers carried from the first sample of a participant.
SERO_BASELINE = [
    "sex", "ednivel_educacao", "SesScoreQnt", "mass_bus", "main_bus", "bus_use",
    "type_cancer", "cancer_histories", "other_imunodef", "specify_other_imunodef",
    "if_diagnosed_hypert", "if_diagnosed_heart_diseases", "hospitalized_avc",
    "specify_chronic_lung_disease", "specify_other_hemat", "chronic_kidney_disease",
    "chronic_neuro_disease", "specify_chronic_neuro_disease", "tb", "smoking",
    "other_health_condition", "bedroom_sharing", "toylet_sharing", "handwash",
    "water_availability", "soap_availability", "health_care_preference",
    "health_care_preference_other", "health_worker", "pregnancy_history",
    "hypertension", "diabet", "cancer", "hearth_diseases", "chronic_lung_disease",
    "chronic_liver_disease", "chronic_hematological_disease", "agegr", "agegr10",
    "inside_outside_city", "did_work", "would_stay_home", "wore_mask_yesterday",
]

SEROSURVEY = _schema(
    keys=(StringType(), ["pseudoID"]),
    dates=(DateType(), ["datacolheita"]),
    numbers=(
        DoubleType(),
        [
            "analyte21_S1S2", "analyte25_RBD", "analyte26_NP", "BMI", "age",
            "mean_n_contactos",
        ],
    ),
    text=(StringType(), ["vacinated", "Result", "hiv"] + SERO_BASELINE),
)

VISITS = _schema(
    dates=(DateType(), ["contact_date"]),
    text=(StringType(), ["respiratory_symptoms", "dateHHID"]),
)

POINTS = _schema(
    numbers=(DoubleType(), ["longitude", "latitude"]),
    counts=(IntegerType(), ["n"]),
    text=(StringType(), ["testresult"]),
)
