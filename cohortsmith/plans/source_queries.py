"""Readers and writers: tables are written by Spark and read back."""

from pyspark.sql import functions as F

from cohortsmith import sources
from cohortsmith.plans import bindings as data
from cohortsmith.plans.bindings import SYMPTOM_PRIMES, sql
from cohortsmith.plans.registry import register
from cohortsmith.session import fresh_path

_SYMPTOMS = list(SYMPTOM_PRIMES)


def _round_trip(spark, df, reader, label):
    path = fresh_path(spark, label)
    sources.write_table(df, path)
    return reader(spark, path)


@register(
    "read_cases",
    sql(
        "SELECT CAST(individualid AS STRING) AS individualid, "
        "CAST(visitid AS STRING) AS visitid, onset AS week, monthonset, testresult, "
        f"GENDER, SesScoreQnt, oxygen_saturation, {', '.join(_SYMPTOMS)} FROM cases",
        "cases",
    ),
)
def read_cases(spark, folder):
    columns = [
        "individualid", "visitid", "week", "monthonset", "testresult", "GENDER",
        "SesScoreQnt", "oxygen_saturation", *_SYMPTOMS,
    ]
    table = data.cases(spark, folder).withColumnRenamed("onset", "week")
    return _round_trip(
        spark, table.select(*columns), sources.read_cases, "cases"
    ).select(*columns)


_COHORT = [
    "locationid", "time", "event", "age", "agegr", "agegr10", "sex", "SesScoreQnt",
    "education", "health_worker", "publictransport_pastweek",
]


@register(
    "read_cohort",
    sql(
        "SELECT CAST(locationid AS STRING) AS locationid, "
        f"{', '.join(_COHORT[1:])} FROM cohort",
        "cohort",
    ),
)
def read_cohort(spark, folder):
    table = data.cohort(spark, folder).select(*_COHORT)
    return _round_trip(spark, table, sources.read_cohort, "cohort").select(*_COHORT)


_SERO = [
    "pseudoID", "datacolheita", "analyte25_RBD", "analyte26_NP", "analyte21_S1S2",
    "vacinated", "hiv", "sex", "agegr",
]


@register(
    "read_serosurvey",
    sql(
        f"SELECT CAST(pseudoID AS STRING) AS pseudoID, {', '.join(_SERO[1:])} "
        "FROM sero",
        "sero",
    ),
)
def read_serosurvey(spark, folder):
    table = data.sero(spark, folder).select(*_SERO)
    return _round_trip(spark, table, sources.read_serosurvey, "sero").select(*_SERO)


@register("read_visits", sql("SELECT * FROM visits", "visits"))
def read_visits(spark, folder):
    table = data.visits(spark, folder)
    return _round_trip(spark, table, sources.read_visits, "visits")


@register(
    "read_points",
    sql("SELECT longitude, latitude, CAST(n AS INT) AS n FROM points", "points"),
)
def read_points(spark, folder):
    table = data.points(spark, folder)
    columns = ["longitude", "latitude", "n"]
    return _round_trip(spark, table, sources.read_points, "points").select(*columns)


@register(
    "write_table",
    sql(
        "SELECT monthonset, testresult, count(*) AS n FROM cases GROUP BY ALL", "cases"
    ),
)
def write_table(spark, folder):
    """Monthly counts written as partitioned Parquet."""
    counts = (
        data.cases(spark, folder)
        .groupBy("monthonset", "testresult")
        .agg(F.count("*").alias("n"))
    )
    path = fresh_path(spark, "monthly")
    sources.write_table(counts, path, "parquet", partition_by=["testresult"])
    return spark.read.schema(counts.schema).parquet(path).select(*counts.columns)
