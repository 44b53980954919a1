"""Frequency tables, quantiles, univariable tables and joins."""

from pyspark.sql import functions as F

from cohortsmith import functions as fn
from cohortsmith.operators import filters
from cohortsmith.operators import frequencies as freq
from cohortsmith.operators.frequencies import Exposure
from cohortsmith.operators.joins import cohort_episode_join
from cohortsmith.operators.quantiles import quantile_summary
from cohortsmith.plans import bindings as data
from cohortsmith.plans import covariates as study
from cohortsmith.plans.bindings import SYMPTOM_PRIMES, sql, unpivoted
from cohortsmith.plans.recode_queries import O2_SQL, clamped_delay
from cohortsmith.plans.registry import register

# Variables of the symptom tables.
PROFILE = [
    *[s for s in SYMPTOM_PRIMES if s != "conjunctivitis"], "O2under92", "O2under95"
]


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@register("row_count", sql("SELECT count(*) AS n FROM cases", "cases"))
def row_count(spark, folder):
    return freq.row_count(data.cases(spark, folder))


@register(
    "freq_table",
    sql(
        """
        SELECT testresult, count(*) AS n FROM cases GROUP BY testresult
        UNION ALL SELECT 'inconclusive', 0
        """,
        "cases",
    ),
)
def freq_table(spark, folder):
    """All levels, also one nobody has, and the NULL cell."""
    return freq.freq_table(
        data.cases(spark, folder), "testresult",
        levels=["negative", "positive", "inconclusive"], use_na=True,
    )


@register(
    "freq_share",
    sql(
        """
        SELECT testresult, count(*) AS n,
          count(*) / (SELECT count(*) FROM cases WHERE testresult IS NOT NULL) * 100
            AS pct
        FROM cases WHERE testresult IS NOT NULL GROUP BY testresult
        """,
        "cases",
    ),
)
def freq_share(spark, folder):
    return freq.freq_share(data.cases(spark, folder), "testresult")


@register(
    "freq_share_with_na",
    sql(
        "SELECT GENDER, count(*) AS n, count(*) / (SELECT count(*) FROM cases) * 100 "
        "AS pct FROM cases GROUP BY GENDER",
        "cases",
    ),
)
def freq_share_with_na(spark, folder):
    return freq.freq_share(data.cases(spark, folder), "GENDER", use_na=True)


_CROSS = """
SELECT {0}, {1}, count(*) AS n FROM {2} WHERE {0} IS NOT NULL AND {1} IS NOT NULL
GROUP BY ALL
"""


@register(
    "crosstab",
    sql(
        """
        SELECT r.GENDER, c.testresult, count(cases.caseid) AS n
        FROM (VALUES ('M'), ('F'), (NULL)) AS r(GENDER),
             (VALUES ('negative'), ('positive'), ('other'), (NULL)) AS c(testresult)
        LEFT JOIN cases ON cases.GENDER IS NOT DISTINCT FROM r.GENDER
          AND cases.testresult IS NOT DISTINCT FROM c.testresult
        GROUP BY ALL
        """,
        "cases",
    ),
)
def crosstab(spark, folder):
    return freq.crosstab(
        data.cases(spark, folder), "GENDER", "testresult",
        row_levels=["M", "F"], col_levels=["negative", "positive", "other"],
        use_na=True,
    )


@register(
    "crosstab_row_share",
    sql(
        "WITH t AS (" + _CROSS.format("monthonset", "testresult", "cases") + ") "
        "SELECT *, n / sum(n) OVER (PARTITION BY monthonset) * 100 AS pct FROM t",
        "cases",
    ),
)
def crosstab_row_share(spark, folder):
    return freq.crosstab_row_share(
        data.cases(spark, folder), "monthonset", "testresult"
    )


@register(
    "crosstab_col_share",
    sql(
        "WITH t AS (" + _CROSS.format("agegr10", "testresult", "cases_with_person")
        + ") SELECT *, n / sum(n) OVER (PARTITION BY testresult) * 100 AS pct FROM t",
        "cases_with_person",
    ),
)
def crosstab_col_share(spark, folder):
    return freq.crosstab_col_share(
        data.cases_with_person(spark, folder), "agegr10", "testresult"
    )


def tested_cases(spark, folder, person=False):
    """Tested cases with the oxygen flags."""
    view = data.cases_with_person if person else data.cases
    return filters.tested_only(view(spark, folder), "testresult").withColumns({
        "O2under95": fn.threshold_flag("oxygen_saturation", 95),
        "O2under92": fn.threshold_flag("oxygen_saturation", 92),
    })


@register(
    "symptom_profile",
    sql(
        f"""
        WITH flagged AS (SELECT *, {O2_SQL.format(92)} AS O2under92,
            {O2_SQL.format(95)} AS O2under95 FROM cases WHERE testresult IS NOT NULL),
        long AS (SELECT variable, value, testresult FROM {unpivoted(
          f"SELECT testresult, {', '.join(PROFILE)} FROM flagged", PROFILE,
          "variable", "value")}),
        counts AS (SELECT variable, value, testresult, count(*) AS n FROM long
          GROUP BY ALL)
        SELECT variable, value, testresult, n,
          CASE WHEN value IS NOT NULL THEN n / sum(n) FILTER (WHERE value IS NOT NULL)
            OVER (PARTITION BY variable, testresult) * 100 END AS pct
        FROM counts
        """,
        "cases",
    ),
)
def symptom_profile(spark, folder):
    return freq.symptom_profile(tested_cases(spark, folder), PROFILE, "testresult")


@register(
    "group_size_mean",
    sql(
        "SELECT count(*) AS n_groups, avg(size) AS mean_size FROM "
        "(SELECT locationid, count(*) AS size FROM cohort GROUP BY 1)",
        "cohort",
    ),
)
def group_size_mean(spark, folder):
    return freq.group_size_mean(data.cohort(spark, folder), "locationid")


_EPISODES = """
SELECT individualid, count(*) AS n_episodes,
  count(*) FILTER (WHERE testresult = 'positive') AS n_confirmed
FROM cases WHERE individualid IS NOT NULL GROUP BY 1
"""


def episodes(spark, folder):
    return freq.episodes_per_person(
        data.cases(spark, folder), "individualid",
        fn.event_flag("testresult", "positive"),
    )


@register("episodes_per_person", sql(_EPISODES, "cases"))
def episodes_per_person(spark, folder):
    return episodes(spark, folder)


@register(
    "episodes_per_visit",
    sql("SELECT visitid, count(*) AS n FROM cases GROUP BY visitid", "cases"),
)
def episodes_per_visit(spark, folder):
    return freq.freq_table(data.cases(spark, folder), "visitid")


# Persons without an age group have no id here, so both sides have unmatched keys.
_PARTICIPANTS = (
    "SELECT CASE WHEN agegr IS NOT NULL THEN individualid END AS personid, age "
    "FROM cohort"
)


def joined_people(spark, folder):
    people = data.cohort(spark, folder).select(
        F.when(F.col("agegr").isNotNull(), F.col("individualid")).alias("personid"),
        "age",
    )
    return cohort_episode_join(
        people, "personid", episodes(spark, folder), "individualid"
    )


_JOINED = f"""
SELECT coalesce(personid, individualid) AS personid, age, n_episodes, n_confirmed
FROM ({_PARTICIPANTS}) FULL JOIN ({_EPISODES})
  ON personid IS NOT DISTINCT FROM individualid
"""


@register("cohort_episode_join", sql(_JOINED, "cohort", "cases"))
def cohort_episode_join_query(spark, folder):
    return joined_people(spark, folder)


_TIER = """
CASE WHEN n_confirmed > 0 THEN 'confirmed COVID-19'
  WHEN n_episodes > 0 THEN 'COVID-19 negative' ELSE 'participants' END
"""


@register(
    "outcome_tier",
    sql(
        f"SELECT {_TIER} AS tier, count(*) AS n FROM ({_JOINED}) GROUP BY 1",
        "cohort", "cases",
    ),
)
def outcome_tier(spark, folder):
    tier = fn.outcome_tier("n_episodes", "n_confirmed", study.OUTCOMES)
    return freq.freq_table(joined_people(spark, folder).withColumn("tier", tier), "tier")


_QUANTILES = (
    "round(quantile_cont({0}, 0.5), 6) AS median, "
    "round(quantile_cont({0}, 0.25), 6) AS q25, "
    "round(quantile_cont({0}, 0.75), 6) AS q75"
)
_DELAY = (
    "greatest(0, datediff('day', data_inicio_sintomas, "
    "coalesce(datacolheita_x, datacolheita_y)))"
)


@register(
    "quantile_summary",
    sql(
        f"SELECT agegr, {_QUANTILES.format(_DELAY)} FROM swabs "
        "WHERE coalesce(datacolheita_x, datacolheita_y) IS NOT NULL GROUP BY agegr",
        "swabs",
    ),
)
def delay_quantiles(spark, folder):
    swabs = data.swabs(spark, folder).withColumn("delay", clamped_delay())
    return rounded(
        quantile_summary(swabs, "delay", ["agegr"]), "median", "q25", "q75"
    )


@register(
    "quantile_summary_continuous",
    sql(
        f"SELECT o_orderstatus, round(avg(o_totalprice), 2) AS mean, "
        f"{_QUANTILES.format('o_totalprice')} FROM orders GROUP BY o_orderstatus",
        "cases",
    ),
)
def continuous_quantiles(spark, folder):
    """A measure with about as many values as rows."""
    orders = data.read(spark, folder, "orders")
    summary = quantile_summary(orders, "o_totalprice", ["o_orderstatus"], mean=True)
    return rounded(rounded(summary, "mean", digits=2), "median", "q25", "q75")


@register(
    "quantile_by_result",
    sql(
        f"SELECT testresult, {_QUANTILES.format('age')} FROM cases_with_person "
        "WHERE age IS NOT NULL AND testresult IS NOT NULL GROUP BY testresult",
        "cases_with_person",
    ),
)
def age_by_result(spark, folder):
    tested = filters.tested_only(
        data.cases_with_person(spark, folder), "testresult"
    )
    return rounded(
        quantile_summary(tested, "age", ["testresult"]), "median", "q25", "q75"
    )


@register(
    "monthly_positivity",
    sql(
        """
        SELECT monthonset, count(*) AS ntested,
          avg(CASE WHEN testresult = 'positive' THEN 1.0::DOUBLE ELSE 0 END) * 100
            AS pct_positive
        FROM cases WHERE testresult IS NOT NULL GROUP BY monthonset
        """,
        "cases",
    ),
)
def monthly_positivity(spark, folder):
    filled = data.cases(spark, folder).withColumn(
        "testresult", fn.fill_missing_category("testresult", "not tested")
    )
    return freq.monthly_positivity(
        filled, "monthonset", "testresult", "positive", "not tested"
    )


@register(
    "monthly_counts",
    sql(
        "SELECT monthonset, testresult, count(*) AS n FROM cases "
        "WHERE testresult <> 'negative' GROUP BY ALL",
        "cases",
    ),
)
def monthly_counts(spark, folder):
    return freq.monthly_counts(
        data.cases(spark, folder), "monthonset", "testresult",
        exclude=["negative", "unknown"],
    )


@register(
    "distinct_count",
    sql(
        "SELECT count(*) AS n FROM (SELECT DISTINCT pseudoID FROM sero)", "sero"
    ),
)
def distinct_count(spark, folder):
    return freq.distinct_count(data.sero(spark, folder), "pseudoID")


_MODES = {
    "keep_null": ("category IS NOT NULL", "TRUE", "TRUE"),
    "all_rows": ("TRUE", "TRUE", "TRUE"),
    "known_only": ("category IS NOT NULL", "category IS NOT NULL",
                   "category IS NOT NULL"),
}


def univariable_sql(names, mode, scope="TRUE", view="cohort"):
    rows, cases, shown = _MODES[mode]
    texts = ", ".join(f"CAST({v} AS STRING) AS {v}" for v in names)
    return f"""
    SELECT variable, category, total, total / rows_n * 100 AS pcttotal, cases,
      cases / cases_n * 100 AS pctcases
    FROM (
      SELECT variable, category, count(*) AS total, sum(event)::BIGINT AS cases,
        sum(count(*)) FILTER (WHERE {rows}) OVER (PARTITION BY variable) AS rows_n,
        sum(sum(event)) FILTER (WHERE {cases}) OVER (PARTITION BY variable) AS cases_n
      FROM {unpivoted(f"SELECT event, {texts} FROM {view} WHERE {scope}", names,
                      "variable", "category")}
      GROUP BY variable, category)
    WHERE {shown}
    """


_DEMOGRAPHY = ["agegr10", "sex", "agegr"]
_HEALTH = [
    "hivbin", "hypertensionbin", "diabetesbin", "publictransport_pastweek",
    "smokingbin", "bedroom_sharing", "toylet_sharing", "handwash",
    "water_availability", "soap_availability",
]
_ADULT = ["SesScoreQnt", "education", "health_worker"]


@register(
    "univariable_table", sql(univariable_sql(_HEALTH, "known_only"), "cohort")
)
def univariable_known(spark, folder):
    return freq.univariable_table(data.cohort(spark, folder), _HEALTH, "event")


@register(
    "univariable_table_keep_null",
    sql(univariable_sql(_DEMOGRAPHY, "keep_null"), "cohort"),
)
def univariable_keep_null(spark, folder):
    specs = [Exposure(v, "keep_null") for v in _DEMOGRAPHY]
    return freq.univariable_table(data.cohort(spark, folder), specs, "event")


@register(
    "univariable_table_all_rows",
    sql(univariable_sql(_DEMOGRAPHY, "all_rows"), "cohort"),
)
def univariable_all_rows(spark, folder):
    specs = [Exposure(v, "all_rows") for v in _DEMOGRAPHY]
    return freq.univariable_table(data.cohort(spark, folder), specs, "event")


_COMORBIDITIES = ["overweight", "pregnant", "tbbin", "lungdisease", "heart", "leukemia"]


@register(
    "univariable_table_comorbidities",
    sql(univariable_sql(_COMORBIDITIES, "known_only"), "cohort"),
)
def univariable_comorbidities(spark, folder):
    return freq.univariable_table(data.cohort(spark, folder), _COMORBIDITIES, "event")


_ADULTS = "agegr <> '0-17 years'"


@register(
    "univariable_table_adults",
    sql(univariable_sql(_ADULT, "known_only", _ADULTS), "cohort"),
)
def univariable_adults(spark, folder):
    specs = [Exposure(v, scoped=True) for v in _ADULT]
    return freq.univariable_table(
        data.cohort(spark, folder), specs, "event",
        scope=F.col("agegr") != study.CHILDREN,
    )


_STACK_PARTS = [
    univariable_sql(_DEMOGRAPHY, "keep_null"),
    univariable_sql(_ADULT, "known_only", _ADULTS),
    univariable_sql(_HEALTH, "known_only"),
]


@register(
    "stack_tables",
    sql(
        " UNION ALL ".join(f"SELECT * FROM ({part})" for part in _STACK_PARTS), "cohort"
    ),
)
def stack_tables(spark, folder):
    """All univariable tables of the study from one scan."""
    specs = [
        *[Exposure(v, "keep_null") for v in _DEMOGRAPHY],
        *[Exposure(v, scoped=True) for v in _ADULT],
        *[Exposure(v) for v in _HEALTH],
    ]
    return freq.univariable_table(
        data.cohort(spark, folder), specs, "event",
        scope=F.col("agegr") != study.CHILDREN,
    )


@register(
    "union_tables",
    sql(
        """
        SELECT 'sex' AS variable, sex AS category, count(*) AS n FROM cohort
          WHERE sex IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'education', education, count(*) FROM cohort
          WHERE education IS NOT NULL GROUP BY 2
        """,
        "cohort",
    ),
)
def union_tables(spark, folder):
    people = data.cohort(spark, folder)
    return freq.stack_tables({
        v: filters.rename_first(freq.freq_table(people, v), "category")
        for v in ("sex", "education")
    })


@register(
    "rename_first",
    sql(
        "SELECT agegr AS category, count(*) AS n FROM cohort WHERE agegr IS NOT NULL "
        "GROUP BY 1",
        "cohort",
    ),
)
def rename_first(spark, folder):
    table = freq.freq_table(data.cohort(spark, folder), "agegr")
    return filters.rename_first(table, "category")


@register(
    "mean_by_event",
    sql(
        "SELECT event, avg(mean_n_contactos) AS mean FROM cohort "
        "WHERE mean_n_contactos IS NOT NULL GROUP BY event",
        "cohort",
    ),
)
def mean_by_event(spark, folder):
    return freq.mean_by_event(data.cohort(spark, folder), "mean_n_contactos", "event")


@register(
    "round_numeric",
    sql(
        """
        SELECT monthonset, round_even(100 * count(*) FILTER (testresult = 'positive')
          / count(*), 1) AS pct_positive, count(*) AS ntested
        FROM cases WHERE testresult IS NOT NULL GROUP BY monthonset
        """,
        "cases",
    ),
)
def round_numeric(spark, folder):
    return filters.round_numeric(monthly_positivity(spark, folder), 1)
