"""Study roles derived from the benchmark tables.

The tables have no NULLs, so some answers are turned into NULL here.  Every
expression is plain SQL; ``sql`` gives the same views to another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Symptom names with the multiplier that spreads their answers over the rows.
SYMPTOM_PRIMES = {
    "fever": 2, "throat": 3, "rhinorrhea": 5, "dyspnoea": 7, "cough": 13,
    "chest_pain": 17, "vomit": 19, "chills": 23, "appitite_loss": 29,
    "nausea": 31, "diarrhea": 37, "headache": 41, "rash": 43,
    "conjunctivitis": 47, "myalgia": 53, "arthromyalgia": 59, "anosmia": 61,
    "ageusia": 67, "fatigue": 71, "nosebleed": 73, "consciousness_change": 79,
    "convulsions": 83,
}


def _answer(prime: int) -> str:
    code = f"(o_orderkey * {prime} + o_custkey) % 11"
    return (
        f"CASE WHEN {code} < 4 THEN 'Sim' WHEN {code} < 9 THEN 'Não' "
        f"WHEN {code} = 9 THEN 'Não sabe' END"
    )


def _spread(code: str, *cases: tuple[int, str]) -> str:
    """Value by upper limits of a code; NULL beyond the last limit."""
    whens = " ".join(f"WHEN {code} < {upper} THEN '{v}'" for upper, v in cases)
    return f"CASE {whens} END"


AGE = "CAST(floor((c_acctbal + 1000) / 110) AS DOUBLE)"
KNOWN_AGE = f"CASE WHEN c_acctbal < 9800 THEN {AGE} END"
AGE_GROUP = (
    f"CASE WHEN c_acctbal >= 9800 THEN NULL WHEN {AGE} < 18 THEN '0-17 years' "
    f"WHEN {AGE} < 50 THEN '18-49 years' ELSE '>=50 years' END"
)

CASES = {
    "caseid": "o_orderkey",
    "individualid": "CASE WHEN o_totalprice >= 20000 THEN o_custkey END",
    "visitid": "CAST(floor(o_orderkey / 4) AS BIGINT)",
    "onset": "CAST(o_orderdate AS DATE)",
    "monthonset": "substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)",
    "testresult": "CASE o_orderstatus WHEN 'F' THEN 'positive' "
    "WHEN 'O' THEN 'negative' END",
    "GENDER": "CASE WHEN o_totalprice < 480000 THEN "
    "CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END END",
    "SesScoreQnt": "o_orderpriority",
    "oxygen_saturation": "CASE WHEN o_totalprice < 450000 THEN "
    "CAST(85 + o_orderkey % 15 AS DOUBLE) END",
    **{name: _answer(p) for name, p in SYMPTOM_PRIMES.items()},
}

PERSON_OF_CASE = {"agegr10": "c_mktsegment", "agegr": AGE_GROUP, "age": KNOWN_AGE}

FIRST_EVENTS = {"first_date": "min(CAST(o_orderdate AS DATE))"}
FIRST_EVENT_FILTER = "o_orderstatus = 'F' AND o_totalprice > 450000"


def _yes_no(prime: int) -> str:
    code = f"(c_custkey * {prime} + c_nationkey) % 9"
    return _spread(code, (3, "yes"), (8, "no"))


COHORT_BINARY = {
    "health_worker": 2, "toylet_sharing": 4, "water_availability": 5,
    "soap_availability": 7, "hivbin": 11, "hypertensionbin": 13,
    "diabetesbin": 16, "handwash": 17, "smokingbin": 19,
}

COHORT = {
    "individualid": "c_custkey",
    "locationid": "CAST(floor(c_custkey / 4) AS BIGINT)",
    "age": KNOWN_AGE,
    "agegr": AGE_GROUP,
    "agegr10": "c_mktsegment",
    "sex": "CASE WHEN c_nationkey < 24 THEN "
    "CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END END",
    "SesScoreQnt": _spread(
        "(c_custkey * 3 + c_nationkey) % 6", (1, "1. very low"), (2, "2. low"),
        (3, "3. med."), (4, "4. high"), (5, "5. highest"),
    ),
    "education": _spread(
        "c_nationkey % 5", (1, "none completed"), (2, "primary"), (3, "secondary"),
        (4, "higher"),
    ),
    "publictransport_pastweek": _spread(
        "(c_custkey * 7 + c_nationkey) % 7", (3, "none"), (5, "bus/train"),
        (6, "moto taxi/shared taxi"),
    ),
    "bedroom_sharing": _spread(
        "(c_custkey * 5 + c_nationkey) % 7", (2, "1 a 2"), (5, "3 a 5"),
        (6, "6 ou mais"),
    ),
    **{name: _yes_no(p) for name, p in COHORT_BINARY.items()},
    "mean_n_contactos": "CASE WHEN c_acctbal < 9800 THEN CAST(c_nationkey AS DOUBLE) "
    "END",
    "overweight": _spread(
        "(c_custkey * 23 + c_nationkey) % 6", (3, "normal"), (4, "overweight"),
        (5, "obesity"),
    ),
    "pregnant": _spread("(c_custkey * 29 + c_nationkey) % 5", (1, "pregnant"), (4, "not")),
    "tbbin": _spread(
        "(c_custkey * 31 + c_nationkey) % 6", (4, "not"), (5, "(history of) tuberculosis")
    ),
    "lungdisease": _spread(
        "(c_custkey * 37 + c_nationkey) % 7", (4, "not"), (5, "asthma"),
        (6, "chronic pulmonary disease"),
    ),
    "heart": _spread("(c_custkey * 41 + c_nationkey) % 6", (4, "not"), (5, "heart disease")),
    "leukemia": _spread("(c_custkey * 43 + c_nationkey) % 9", (7, "not"), (8, "leukemia")),
}

FOLLOW_UP = {
    "event": "CASE WHEN first_date IS NULL THEN 0 ELSE 1 END",
    "days": "1 + CAST(datediff('day', DATE '1995-01-01', "
    "coalesce(first_date, DATE '2001-08-01')) AS INT)",
    "time": "(1 + datediff('day', DATE '1995-01-01', "
    "coalesce(first_date, DATE '2001-08-01'))) / CAST(30 AS DOUBLE)",
}

# Raw baseline answers, before they are recoded.
BASELINE = {
    "pseudoID": "c_custkey",
    "SesScoreQnt": COHORT["SesScoreQnt"],
    "BMI": "CASE WHEN c_acctbal < 9800 THEN 8 + c_acctbal / 200 END",
    "ednivel_educacao": _spread(
        "c_nationkey % 9", (1, "1.  Primario incompleto"), (2, "2. Primario completo"),
        (3, "3. Secundario incompleto"), (4, "4. Secundario completo"),
        (5, "5. Tecnico-profissional"), (6, "6. Superior"), (7, "7. Pos-graduacao"),
        (8, "8. Nenhum"),
    ),
    "hypertension": _spread(
        "(c_custkey * 2 + c_nationkey) % 5", (2, "Não"),
        (3, "Diagnosticado, em tratamento"), (4, "Diagnostico incerto"),
    ),
    "diabet": _spread(
        "(c_custkey * 3 + c_nationkey) % 4", (2, "Não"),
        (3, "Diagnosticado, sem tratamento"),
    ),
    "hiv": _spread(
        "(c_custkey * 5 + c_nationkey) % 6", (1, "Crianca exposta"),
        (2, "Seropositivo em TARV"), (3, "estado desconhecido"),
        (5, "HIV negativo (no momento do ultimo teste HIV)"),
    ),
    "smoking": _spread(
        "(c_custkey * 7 + c_nationkey) % 6", (2, "Nunca fumou"), (3, "Nao fumador"),
        (4, "Ex-fumador"), (5, "Fumador actual"),
    ),
    "mass_bus": _spread("(c_custkey * 11 + c_nationkey) % 3", (1, "Não"), (2, "Sim")),
    "main_bus": _spread(
        "(c_custkey * 13 + c_nationkey) % 8", (1, "taxi Nao partilhado com outros"),
        (2, "minibus"), (3, "comboio"), (4, "autocarro publico"),
        (5, "taxi partilhado"), (6, "moto taxi"), (7, "Sim, outro"),
    ),
    "cancer": _spread(
        "(c_custkey * 17 + c_nationkey) % 5", (3, "Nao"),
        (4, "Sim, malignidade hematologica"),
    ),
    "hearth_diseases": _spread(
        "(c_custkey * 19 + c_nationkey) % 5", (3, "Nao"), (4, "Diagnosticada")
    ),
    "chronic_lung_disease": _spread(
        "(c_custkey * 23 + c_nationkey) % 6", (3, "Nao"), (4, "Sim, asma"),
        (5, "Sim, outra"),
    ),
    "tb": _spread(
        "(c_custkey * 29 + c_nationkey) % 5", (3, "Nao"), (4, "Sim, tuberculose")
    ),
    "bedroom_sharing": COHORT["bedroom_sharing"],
}

SERO = {
    "pseudoID": "user_id",
    "datacolheita": "CAST(ts AS DATE)",
    "sampleid": "event_id",
    "analyte25_RBD": "value / 10",
    "analyte26_NP": "CASE WHEN event_type = 'purchase' AND value > 25 THEN NULL "
    "ELSE (event_id % 7) / CAST(3 AS DOUBLE) END",
    "analyte21_S1S2": "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 50",
    "vacinated": "CASE event_type WHEN 'signup' THEN 'Sim, 1 dose' "
    "WHEN 'view' THEN 'Não' WHEN 'click' THEN 'Não' WHEN 'purchase' THEN 'Não' END",
    "hiv": "CASE WHEN event_type <> 'view' THEN event_type END",
    "sex": "CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END",
    "agegr": "CASE user_id % 4 WHEN 0 THEN '0-17 years' WHEN 1 THEN '18-49 years' "
    "WHEN 2 THEN '>=50 years' END",
}

def _panel(prime: int, parts: int, *cases: tuple[int, str]) -> str:
    """An answer that may change from sample to sample; NULL beyond the last limit."""
    return _spread(f"(o_orderkey * {prime} + o_custkey) % {parts}", *cases)


def _of_order(expr: str) -> str:
    return expr.replace("c_custkey", "o_orderkey").replace("c_nationkey", "o_custkey")


# A sero-survey of persons with several samples and every baseline answer.
SERO_PANEL = {
    "pseudoID": "CAST(floor(o_orderkey / 16) AS BIGINT)",
    "datacolheita": "CAST(o_orderdate AS DATE)",
    "sampleid": "o_orderkey",
    "analyte25_RBD": "(o_custkey % 17) / CAST(10 AS DOUBLE)",
    "analyte26_NP": "CASE WHEN o_totalprice < 470000 THEN "
    "((o_orderkey * 3 + o_custkey) % 13) / CAST(8 AS DOUBLE) END",
    "analyte21_S1S2": "(o_custkey % 11) / CAST(5 AS DOUBLE)",
    "vacinated": "CASE WHEN o_custkey % 6 = 0 THEN 'Sim, 1 dose' "
    "WHEN o_custkey % 6 < 5 THEN 'Não' END",
    "hiv": _of_order(BASELINE["hiv"]),
    "BMI": "CASE WHEN o_totalprice < 480000 THEN "
    "CAST(14 + o_orderkey % 28 AS DOUBLE) END",
    "age": "CAST(floor(o_orderkey / 16) * 7 % 90 AS DOUBLE)",
    "mean_n_contactos": "CASE WHEN o_totalprice < 460000 THEN "
    "CAST(o_custkey % 12 AS DOUBLE) END",
    "sex": "CASE WHEN floor(o_orderkey / 16) % 2 = 0 THEN 'M' ELSE 'F' END",
    "agegr": "CASE WHEN floor(o_orderkey / 16) * 7 % 90 < 18 THEN '0-17 years' "
    "WHEN floor(o_orderkey / 16) * 7 % 90 < 50 THEN '18-49 years' ELSE '>=50 years' END",
    "agegr10": "CASE WHEN o_totalprice >= 490000 THEN NULL "
    "WHEN floor(o_orderkey / 16) * 7 % 90 < 20 THEN '0-19' "
    "WHEN floor(o_orderkey / 16) * 7 % 90 < 40 THEN '20-39' "
    "WHEN floor(o_orderkey / 16) * 7 % 90 < 60 THEN '40-59' ELSE '>=60' END",
    **{
        name: _of_order(BASELINE[name]) for name in (
            "SesScoreQnt", "ednivel_educacao", "mass_bus", "main_bus", "tb", "smoking",
            "bedroom_sharing", "hypertension", "diabet", "cancer", "hearth_diseases",
            "chronic_lung_disease",
        )
    },
    "water_availability": _panel(31, 5, (3, "Disponivel"), (4, "Nao disponivel")),
    **{
        name: _panel(prime, 5, (2, "yes"), (4, "no")) for name, prime in {
            "toylet_sharing": 37, "handwash": 41, "soap_availability": 43,
            "health_worker": 47, "did_work": 53, "would_stay_home": 59,
            "wore_mask_yesterday": 61, "inside_outside_city": 67,
        }.items()
    },
    **{
        name: _panel(prime, 4, (1, "Sim"), (3, "Não")) for name, prime in {
            "bus_use": 71, "type_cancer": 73, "cancer_histories": 79,
            "other_imunodef": 83, "specify_other_imunodef": 89,
            "if_diagnosed_hypert": 97, "if_diagnosed_heart_diseases": 101,
            "hospitalized_avc": 103, "specify_chronic_lung_disease": 107,
            "specify_other_hemat": 109, "chronic_kidney_disease": 113,
            "chronic_neuro_disease": 127, "specify_chronic_neuro_disease": 131,
            "other_health_condition": 137, "health_care_preference": 139,
            "health_care_preference_other": 149, "pregnancy_history": 151,
            "chronic_liver_disease": 157, "chronic_hematological_disease": 163,
        }.items()
    },
}

# A second sero-survey with many months.
SERO_MONTHS = {
    "pseudoID": "l_suppkey",
    "datacolheita": "CAST(l_shipdate AS DATE)",
    "month": "substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7)",
    "agegr": "l_returnflag",
    "analyte21_S1S2": "l_tax / 0.04",
    "analyte25_RBD": "l_quantity / 25",
    "analyte26_NP": "l_discount / 0.05",
    "vacinated": "CASE WHEN l_linenumber >= 6 THEN 'Sim' "
    "WHEN l_linenumber >= 2 THEN 'Não' END",
}

SWABS = {
    "swabid": "l_orderkey",
    "line": "l_linenumber",
    "agegr": "l_returnflag",
    "testresult": CASES["testresult"],
    "data_inicio_sintomas": "CAST(o_orderdate AS DATE)",
    "datacolheita_x": "CASE WHEN l_linestatus = 'O' THEN CAST(l_shipdate AS DATE) END",
    "datacolheita_y": "CASE WHEN l_linenumber < 7 THEN CAST(l_shipdate AS DATE) END",
    "valorct": "CASE WHEN l_tax >= 0.08 THEN 'indeterminado' "
    "ELSE CAST(l_quantity AS STRING) END",
}

VISITS = {
    "contact_date": "CAST(o_orderdate AS DATE)",
    "respiratory_symptoms": "CASE o_orderstatus WHEN 'F' THEN 'Sim' "
    "WHEN 'O' THEN 'Não' END",
    "dateHHID": "CAST(o_orderkey AS STRING)",
}

POINTS = {
    "longitude": "32.58 + c_acctbal / 200000",
    "latitude": "-25.96 + c_nationkey * CAST(0.002 AS DOUBLE)",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _columns(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in exprs.items()]


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(*_columns(CASES))


def cases_with_person(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = read(spark, folder, "orders"), read(spark, folder, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(*_columns(CASES | PERSON_OF_CASE))


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    """One row per person; the events are reduced to one per person first."""
    first = (
        read(spark, folder, "orders")
        .where(FIRST_EVENT_FILTER)
        .groupBy("o_custkey")
        .agg(*[F.expr(e).alias(n) for n, e in FIRST_EVENTS.items()])
    )
    joined = read(spark, folder, "customer").join(
        first, F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    return joined.selectExpr(*_columns(COHORT), *_spark_follow_up())


def _spark_follow_up() -> list[str]:
    return [c.replace("'day',", "DAY,") for c in _columns(FOLLOW_UP)]


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").selectExpr(*_columns(BASELINE))


def sero(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").selectExpr(*_columns(SERO))


def sero_panel(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(*_columns(SERO_PANEL))


def sero_months(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").selectExpr(*_columns(SERO_MONTHS))


def swabs(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = read(spark, folder, "lineitem"), read(spark, folder, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.selectExpr(*_columns(SWABS))


def visits(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").selectExpr(*_columns(VISITS))


def points(spark: SparkSession, folder: str) -> DataFrame:
    per_person = read(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n")
    )
    joined = read(spark, folder, "customer").join(
        per_person, F.col("c_custkey") == F.col("o_custkey")
    )
    return joined.selectExpr(*_columns(POINTS), "n")


def case_points(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = read(spark, folder, "orders"), read(spark, folder, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(*_columns(POINTS), *_columns(
        {"testresult": CASES["testresult"]}
    ))


def _list(exprs: dict[str, str]) -> str:
    return ", ".join(_columns(exprs))


# The same views as SQL, for engines that have the tables under their names.
SQL_VIEWS = {
    "cases": f"SELECT {_list(CASES)} FROM orders",
    "cases_with_person": f"SELECT {_list(CASES | PERSON_OF_CASE)} "
    "FROM orders JOIN customer ON o_custkey = c_custkey",
    "cohort": f"SELECT {_list(COHORT)}, {_list(FOLLOW_UP)} FROM customer LEFT JOIN "
    f"(SELECT o_custkey, {_list(FIRST_EVENTS)} FROM orders "
    f"WHERE {FIRST_EVENT_FILTER} GROUP BY o_custkey) ON c_custkey = o_custkey",
    "baseline": f"SELECT {_list(BASELINE)} FROM customer",
    "sero": f"SELECT {_list(SERO)} FROM events",
    "sero_panel": f"SELECT {_list(SERO_PANEL)} FROM orders",
    "sero_months": f"SELECT {_list(SERO_MONTHS)} FROM lineitem",
    "swabs": f"SELECT {_list(SWABS)} FROM lineitem JOIN orders "
    "ON l_orderkey = o_orderkey",
    "visits": f"SELECT {_list(VISITS)} FROM orders",
    "points": f"SELECT {_list(POINTS)}, n FROM customer JOIN "
    "(SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) "
    "ON c_custkey = o_custkey",
    "case_points": f"SELECT {_list(POINTS)}, {CASES['testresult']} AS testresult "
    "FROM orders JOIN customer ON o_custkey = c_custkey",
}


def unpivoted(source: str, columns: list[str], name: str, value: str) -> str:
    """``columns`` of ``source`` as rows, NULL included."""
    return (
        f"({source}) UNPIVOT INCLUDE NULLS "
        f"({value} FOR {name} IN ({', '.join(columns)}))"
    )


def sql(body: str, *views: str) -> str:
    """``body`` with the named views in front of it."""
    text = body.strip()
    ctes = [f"{v} AS ({SQL_VIEWS[v]})" for v in views]
    for opening in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(opening):
            return opening + ",\n".join([*ctes, text.removeprefix(opening)])
    return "WITH " + ",\n".join(ctes) + "\n" + text
