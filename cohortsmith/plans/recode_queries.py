"""Row-level recodes, filters and scalar functions."""

from datetime import date

from pyspark.sql import functions as F

from cohortsmith import functions as fn
from cohortsmith.operators import filters
from cohortsmith.plans import bindings as data
from cohortsmith.plans import covariates as study
from cohortsmith.plans.bindings import SYMPTOM_PRIMES, sql
from cohortsmith.plans.registry import register

# Symptoms that are recoded to 0/1 in the study.
RECODED = [
    s for s in SYMPTOM_PRIMES
    if s not in ("nosebleed", "consciousness_change", "convulsions")
]

# Eras of the benchmark calendar.
ERA_STARTS = ("1997-03", "1999-06")


def _binary_sql(name: str) -> str:
    return (
        f"CASE WHEN {name} IN ('Sim', 'yes', 'positive', '(ex-)smoker') THEN 1 "
        f"WHEN {name} IN ('Não', 'Não sabe', 'no', 'negative', 'non smoker') "
        "THEN 0 END"
    )


O2_SQL = "CASE WHEN oxygen_saturation < {0} THEN 'yes' WHEN oxygen_saturation >= {0} " \
    "THEN 'no' END"


@register(
    "recode_binary",
    sql(
        "SELECT caseid, "
        + ", ".join(f"{_binary_sql(s)} AS {s}" for s in [*RECODED, "testresult"])
        + " FROM cases",
        "cases",
    ),
)
def recode_binary(spark, folder):
    return data.cases(spark, folder).select(
        "caseid",
        *[
            fn.recode_binary(s, study.YES, study.NO).alias(s)
            for s in [*RECODED, "testresult"]
        ],
    )


@register(
    "recode_map",
    sql(
        """
        SELECT pseudoID,
          CASE WHEN main_bus = 'taxi Nao partilhado com outros' THEN 'none'
               WHEN main_bus IN ('minibus', 'comboio', 'autocarro publico')
                 THEN 'bus/train'
               WHEN main_bus IN ('taxi partilhado', 'moto taxi')
                 THEN 'moto taxi/shared taxi'
               WHEN mass_bus = 'Não' THEN 'none' END AS publictransport_pastweek,
          CASE WHEN ednivel_educacao LIKE '%cundario incom%' THEN 'primary'
               WHEN ednivel_educacao LIKE '1.%' OR ednivel_educacao LIKE '8.%'
                 THEN 'none completed'
               WHEN ednivel_educacao LIKE '2.%' THEN 'primary'
               WHEN ednivel_educacao LIKE '4.%' THEN 'secondary'
               WHEN ednivel_educacao IS NOT NULL THEN 'higher' END AS education,
          CASE WHEN hiv IN ('Crianca exposta', 'Seropositivo em TARV') THEN 1
               WHEN hiv IS NOT NULL THEN 0 END AS hivbin
        FROM baseline
        """,
        "baseline",
    ),
)
def recode_map(spark, folder):
    recoded = study.with_covariates(data.baseline(spark, folder))
    return recoded.select("pseudoID", "publictransport_pastweek", "education", "hivbin")


@register(
    "recode_pattern",
    sql(
        """
        SELECT pseudoID,
          CASE hypertension WHEN 'Não' THEN 0
            WHEN 'Diagnosticado, em tratamento' THEN 1
            WHEN 'Diagnostico incerto' THEN 1 END AS hypertensionbin,
          CASE diabet WHEN 'Não' THEN 0
            WHEN 'Diagnosticado, sem tratamento' THEN 1 END AS diabetesbin,
          CASE WHEN smoking IN ('Nunca fumou', 'Nao fumador') THEN 'non smoker'
            WHEN smoking IS NOT NULL THEN '(ex-)smoker' END AS smokingbin,
          CASE chronic_lung_disease WHEN 'Nao' THEN 'not'
            WHEN 'Sim, asma' THEN 'asthma'
            WHEN 'Sim, outra' THEN 'chronic pulmonary disease' END AS lungdisease,
          CASE WHEN main_bus LIKE '%Sim%' THEN 'pregnant' END AS pregnant,
          CASE WHEN bedroom_sharing LIKE '%6%' THEN '3 a 5'
            ELSE bedroom_sharing END AS bedroom_sharing
        FROM baseline
        """,
        "baseline",
    ),
)
def recode_pattern(spark, folder):
    return study.with_covariates(data.baseline(spark, folder)).select(
        "pseudoID", "hypertensionbin", "diabetesbin", "smokingbin", "lungdisease",
        "pregnant", "bedroom_sharing",
    )


@register(
    "flag_present",
    sql(
        """
        SELECT pseudoID,
          CASE WHEN SesScoreQnt IS NOT NULL
            THEN CAST(SesScoreQnt = '1. very low' AS INT) END AS lowestSES,
          CASE WHEN cancer LIKE '%hemato%' THEN 'leukemia'
            WHEN cancer IS NOT NULL THEN 'not' END AS leukemia,
          CASE WHEN hearth_diseases = 'Diagnosticada' THEN 'heart disease'
            WHEN hearth_diseases IS NOT NULL THEN 'not' END AS heart,
          CASE WHEN tb LIKE '%tubercu%' THEN '(history of) tuberculosis'
            WHEN tb IS NOT NULL THEN 'not' END AS tbbin
        FROM baseline
        """,
        "baseline",
    ),
)
def flag_present(spark, folder):
    return study.with_covariates(data.baseline(spark, folder)).select(
        "pseudoID", "lowestSES", "leukemia", "heart", "tbbin"
    )


@register(
    "bin_numeric",
    sql(
        """
        SELECT pseudoID, BMI,
          CASE WHEN BMI IS NULL THEN NULL
               WHEN BMI > 8 AND BMI < 19 THEN 'underweight'
               WHEN BMI > 29.99 AND BMI < 50 THEN 'obesity'
               WHEN BMI > 24.99 AND BMI < 30 THEN 'overweight'
               ELSE 'normal' END AS overweight
        FROM baseline
        """,
        "baseline",
    ),
)
def bin_numeric(spark, folder):
    return data.baseline(spark, folder).select(
        "pseudoID", "BMI",
        fn.bin_numeric("BMI", "normal", study.BMI_CLASSES).alias("overweight"),
    )


@register(
    "threshold_flag",
    sql(
        f"SELECT caseid, {O2_SQL.format(95)} AS O2under95, "
        f"{O2_SQL.format(92)} AS O2under92 FROM cases",
        "cases",
    ),
)
def threshold_flag(spark, folder):
    return data.cases(spark, folder).select(
        "caseid",
        fn.threshold_flag("oxygen_saturation", 95).alias("O2under95"),
        fn.threshold_flag("oxygen_saturation", 92).alias("O2under92"),
    )


@register(
    "any_of_flags",
    sql(
        """
        SELECT caseid, CASE WHEN throat = 'Sim' OR cough = 'Sim' OR dyspnoea = 'Sim'
          OR rhinorrhea = 'Sim' OR oxygen_saturation < 95 THEN 1 ELSE 0 END AS flag
        FROM cases
        """,
        "cases",
    ),
)
def any_of_flags(spark, folder):
    signs = [F.col(s) == "Sim" for s in ("throat", "cough", "dyspnoea", "rhinorrhea")]
    low = fn.threshold_flag("oxygen_saturation", 95) == "yes"
    return data.cases(spark, folder).select(
        "caseid", fn.any_of_flags([*signs, low]).alias("flag")
    )


@register(
    "fill_missing_category",
    sql(
        "SELECT caseid, coalesce(testresult, 'not tested') AS testresult FROM cases",
        "cases",
    ),
)
def fill_missing_category(spark, folder):
    return data.cases(spark, folder).select(
        "caseid",
        fn.fill_missing_category("testresult", "not tested", study.RESULTS).alias(
            "testresult"
        ),
    )


@register(
    "event_flag",
    sql(
        "SELECT caseid, CAST(testresult IS NOT DISTINCT FROM 'positive' AS INT) "
        "AS confirmed FROM cases",
        "cases",
    ),
)
def event_flag(spark, folder):
    return data.cases(spark, folder).select(
        "caseid", fn.event_flag("testresult", "positive").alias("confirmed")
    )


@register(
    "era_from_month",
    sql(
        """
        SELECT caseid, CASE WHEN onset >= DATE '1999-06-01' THEN 'omikron'
          WHEN onset >= DATE '1997-03-01' THEN 'delta' ELSE 'alpha/beta' END AS variant
        FROM cases
        """,
        "cases",
    ),
)
def era_from_month(spark, folder):
    era = fn.era_from_month(fn.month_key("onset"), ERA_STARTS, study.ERAS)
    return data.cases(spark, folder).select("caseid", era.alias("variant"))


@register(
    "month_key",
    sql("SELECT caseid, strftime(onset, '%Y-%m') AS month FROM cases", "cases"),
)
def month_key(spark, folder):
    return data.cases(spark, folder).select("caseid", fn.month_key("onset").alias("month"))


@register(
    "week_start",
    sql(
        "SELECT caseid, CAST(onset - CAST(isodow(onset) - 1 AS INT) AS DATE) AS week "
        "FROM cases",
        "cases",
    ),
)
def week_start(spark, folder):
    return data.cases(spark, folder).select("caseid", fn.week_start("onset").alias("week"))


@register(
    "as_factor",
    sql(
        "SELECT caseid, nullif(SesScoreQnt, '4-NOT SPECIFIED') AS SesScoreQnt "
        "FROM cases",
        "cases",
    ),
)
def as_factor(spark, folder):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    return data.cases(spark, folder).select(
        "caseid", fn.as_factor("SesScoreQnt", levels).alias("SesScoreQnt")
    )


@register(
    "relevel",
    sql(
        """
        SELECT SesScoreQnt AS level,
          list_position(['5. highest', '1. very low', '2. low', '3. med.', '4. high'],
            SesScoreQnt) - 1 AS code, count(*) AS n
        FROM cohort WHERE SesScoreQnt IS NOT NULL GROUP BY ALL
        """,
        "cohort",
    ),
)
def relevel(spark, folder):
    levels = fn.relevel(
        ["1. very low", "2. low", "3. med.", "4. high", "5. highest"], "5. highest"
    )
    people = data.cohort(spark, folder).where(F.col("SesScoreQnt").isNotNull())
    return people.groupBy(
        F.col("SesScoreQnt").alias("level"),
        fn.level_code("SesScoreQnt", levels).alias("code"),
    ).agg(F.count("*").alias("n"))


@register(
    "k_of_n_positive",
    sql(
        """
        SELECT sampleid,
          CASE WHEN analyte25_RBD IS NULL OR analyte26_NP IS NULL THEN NULL
            WHEN analyte25_RBD >= 1 AND analyte26_NP >= 1
            THEN 'positive after infection' ELSE 'negative' END AS RBD_NP,
          CASE WHEN analyte25_RBD IS NULL OR analyte26_NP IS NULL
              OR analyte21_S1S2 IS NULL THEN NULL
            WHEN CAST(analyte25_RBD >= 1 AS INT) + CAST(analyte26_NP >= 1 AS INT)
              + CAST(analyte21_S1S2 >= 1 AS INT) >= 2
            THEN 'positive after infection' ELSE 'negative' END AS two_antigens,
          CASE WHEN analyte25_RBD >= 1 THEN 'positive after infection'
            WHEN analyte25_RBD < 1 THEN 'negative' END AS RBD
        FROM sero
        """,
        "sero",
    ),
)
def k_of_n_positive(spark, folder):
    names = ("RBD_NP", "two_antigens", "RBD")
    results = [
        fn.k_of_n_positive(antigens, k, study.INFECTED, study.NEGATIVE).alias(name)
        for name, (antigens, k) in zip(names, study.RESULT_DEFINITIONS.values())
    ]
    return data.sero(spark, folder).select("sampleid", *results)


@register(
    "override_vaccinated",
    sql(
        """
        SELECT sampleid, CASE WHEN analyte25_RBD >= 1 AND vacinated LIKE '%Sim%'
            THEN 'positive after vaccination'
          WHEN analyte25_RBD >= 1 THEN 'positive after infection'
          WHEN analyte25_RBD < 1 THEN 'negative' END AS result
        FROM sero
        """,
        "sero",
    ),
)
def override_vaccinated(spark, folder):
    return data.sero(spark, folder).select(
        "sampleid", study.sero_result("seroresultRBD").alias("result")
    )


@register(
    "delay_days",
    sql(
        "SELECT swabid, line, datediff('day', data_inicio_sintomas, datacolheita_y) "
        "AS delay FROM swabs "
        "WHERE datacolheita_y IS NOT NULL AND data_inicio_sintomas IS NOT NULL",
        "swabs",
    ),
)
def delay_days(spark, folder):
    known = filters.not_null(
        data.swabs(spark, folder), "datacolheita_y", "data_inicio_sintomas"
    )
    return known.select(
        "swabid", "line",
        fn.delay_days("datacolheita_y", "data_inicio_sintomas")
        .cast("bigint").alias("delay"),
    )


def clamped_delay():
    collected = fn.coalesce_cols("datacolheita_x", "datacolheita_y")
    return fn.clamp_floor(fn.delay_days(collected, "data_inicio_sintomas"))


@register(
    "clamp_floor",
    sql(
        """
        SELECT swabid, line, CASE WHEN datacolheita_x IS NULL AND datacolheita_y IS NULL
          THEN NULL ELSE greatest(0, datediff('day', data_inicio_sintomas,
            coalesce(datacolheita_x, datacolheita_y))) END AS delay
        FROM swabs
        """,
        "swabs",
    ),
)
def clamp_floor(spark, folder):
    return data.swabs(spark, folder).select(
        "swabid", "line", clamped_delay().cast("bigint").alias("delay")
    )


@register(
    "coalesce_cols",
    sql(
        "SELECT swabid, line, CASE WHEN datacolheita_x IS NOT NULL THEN datacolheita_x "
        "ELSE datacolheita_y END AS collectiondate FROM swabs",
        "swabs",
    ),
)
def coalesce_cols(spark, folder):
    return data.swabs(spark, folder).select(
        "swabid", "line",
        fn.coalesce_cols("datacolheita_x", "datacolheita_y").alias("collectiondate"),
    )


@register(
    "to_number",
    sql(
        "SELECT swabid, line, TRY_CAST(valorct AS DOUBLE) AS ct FROM swabs", "swabs"
    ),
)
def to_number(spark, folder):
    return data.swabs(spark, folder).select(
        "swabid", "line", fn.to_number("valorct").alias("ct")
    )


@register(
    "select_columns",
    sql("SELECT caseid, monthonset, testresult FROM cases", "cases"),
)
def select_columns(spark, folder):
    wide = data.cases(spark, folder).select(
        "caseid", "monthonset", "testresult", "onset", "GENDER"
    )
    return wide.drop("onset", "GENDER")


@register(
    "tested_only",
    sql(
        "SELECT caseid, testresult FROM cases WHERE testresult IS NOT NULL", "cases"
    ),
)
def tested_only(spark, folder):
    tested = filters.tested_only(data.cases(spark, folder), "testresult")
    return tested.select("caseid", "testresult")


@register(
    "not_null",
    sql(
        "SELECT caseid, testresult, GENDER, oxygen_saturation FROM cases WHERE "
        "testresult IS NOT NULL AND GENDER IS NOT NULL "
        "AND oxygen_saturation IS NOT NULL",
        "cases",
    ),
)
def not_null(spark, folder):
    columns = ["testresult", "GENDER", "oxygen_saturation"]
    return filters.not_null(data.cases(spark, folder), *columns).select(
        "caseid", *columns
    )


@register(
    "date_cutoff",
    sql(
        "SELECT sampleid, datacolheita FROM sero WHERE datacolheita < '2024-01-20'",
        "sero",
    ),
)
def date_cutoff(spark, folder):
    early = filters.date_cutoff(
        data.sero(spark, folder), "datacolheita", date(2024, 1, 20)
    )
    return early.select("sampleid", "datacolheita")


@register(
    "subgroup",
    sql(
        "SELECT individualid, agegr, age FROM cohort "
        "WHERE agegr <> '0-17 years' AND age > 15.99",
        "cohort",
    ),
)
def subgroup(spark, folder):
    adults = (F.col("agegr") != study.CHILDREN) & (F.col("age") > 15.99)
    return filters.subgroup(data.cohort(spark, folder), adults).select(
        "individualid", "agegr", "age"
    )


@register(
    "drop_category",
    sql(
        "SELECT individualid, publictransport_pastweek FROM cohort "
        "WHERE publictransport_pastweek IN ('none', 'bus/train')",
        "cohort",
    ),
)
def drop_category(spark, folder):
    return filters.drop_category(
        data.cohort(spark, folder), "publictransport_pastweek", "moto taxi/shared taxi"
    ).select("individualid", "publictransport_pastweek")


@register(
    "unvaccinated",
    sql(
        "SELECT sampleid, vacinated FROM sero "
        "WHERE vacinated IS NULL OR vacinated NOT LIKE '%Sim%'",
        "sero",
    ),
)
def unvaccinated(spark, folder):
    kept = filters.unvaccinated(
        data.sero(spark, folder), "vacinated", study.VACCINATED
    )
    return kept.select("sampleid", "vacinated")


@register(
    "bbox_filter",
    sql(
        """
        SELECT longitude, latitude, n FROM points WHERE longitude >= 32.59
          AND longitude <= 32.625 AND latitude >= -25.95 AND latitude <= -25.923
        """,
        "points",
    ),
)
def bbox_filter(spark, folder):
    return filters.bbox_filter(
        data.points(spark, folder), "longitude", "latitude",
        left=32.59, bottom=-25.95, right=32.625, top=-25.923,
    )


@register(
    "distinct",
    sql("SELECT DISTINCT individualid FROM cases", "cases"),
)
def distinct(spark, folder):
    return data.cases(spark, folder).select("individualid").distinct()


@register(
    "sort_by_id_date",
    sql(
        "SELECT pseudoID, datacolheita, sampleid FROM sero "
        "ORDER BY pseudoID, datacolheita, sampleid",
        "sero",
    ),
)
def sort_by_id_date(spark, folder):
    samples = data.sero(spark, folder).select("pseudoID", "datacolheita", "sampleid")
    return samples.orderBy("pseudoID", "datacolheita", "sampleid")


@register(
    "design_matrix",
    sql(
        """
        SELECT individualid,
          CAST(sex = 'F' AS DOUBLE) AS "sex=F",
          CAST(SesScoreQnt = '1. very low' AS DOUBLE) AS "SesScoreQnt=1. very low",
          CAST(SesScoreQnt = '3. med.' AS DOUBLE) AS "SesScoreQnt=3. med.",
          age, CAST(sex = 'F' AS DOUBLE) * age AS "sex=F:age"
        FROM cohort WHERE sex IS NOT NULL AND age IS NOT NULL
          AND SesScoreQnt IN ('5. highest', '1. very low', '3. med.')
        """,
        "cohort",
    ),
)
def design_matrix(spark, folder):
    from cohortsmith.models import Cat, Inter, Num, design_matrix

    sex, age = Cat("sex", ("M", "F")), Num("age")
    ses = Cat("SesScoreQnt", ("5. highest", "1. very low", "3. med."))
    return design_matrix(
        data.cohort(spark, folder), [sex, ses, age, Inter(sex, age)], "individualid"
    )
