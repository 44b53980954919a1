"""Repeated visits, prevalence and incidence."""

from pyspark.sql import functions as F

from cohortsmith import functions as fn
from cohortsmith.operators import filters, rates, visits
from cohortsmith.operators import frequencies as freq
from cohortsmith.plans import bindings as data
from cohortsmith.plans import covariates as study
from cohortsmith.plans.bindings import sql
from cohortsmith.plans.registry import register
from cohortsmith.plans.table_queries import rounded

PERSON, DATE, RESULT = "pseudoID", "datacolheita", "result"


def samples(spark, folder):
    """Complete samples, one per person and date, with their result."""
    complete = filters.not_null(data.sero(spark, folder), DATE, "analyte25_RBD")
    unique = visits.dedupe_visits(complete, PERSON, DATE, ["sampleid"])
    return unique.withColumn(RESULT, study.sero_result("seroresultRBD_NP"))


def unvaccinated_samples(spark, folder):
    return filters.unvaccinated(samples(spark, folder), "vacinated", study.VACCINATED)


_SAMPLES = """
samples AS (
  SELECT *, CASE WHEN analyte26_NP IS NULL THEN NULL
      WHEN analyte25_RBD >= 1 AND analyte26_NP >= 1 AND vacinated LIKE '%Sim%'
        THEN 'positive after vaccination'
      WHEN analyte25_RBD >= 1 AND analyte26_NP >= 1 THEN 'positive after infection'
      ELSE 'negative' END AS result
  FROM (SELECT *, row_number() OVER (PARTITION BY pseudoID, datacolheita
      ORDER BY sampleid) AS rn FROM sero WHERE analyte25_RBD IS NOT NULL)
  WHERE rn = 1),
unvaccinated AS (SELECT * FROM samples
  WHERE vacinated IS NULL OR vacinated NOT LIKE '%Sim%')
"""


def _sql(body):
    return sql(f"WITH {_SAMPLES} {body}", "sero")


@register("dedupe_rank", _sql("SELECT sampleid, pseudoID, datacolheita FROM samples"))
def dedupe_rank(spark, folder):
    return samples(spark, folder).select("sampleid", PERSON, DATE)


@register(
    "first_per_group",
    _sql(
        """
        SELECT pseudoID, sampleid, sex, agegr FROM samples
        QUALIFY row_number() OVER (PARTITION BY pseudoID ORDER BY sampleid) = 1
        """
    ),
)
def first_per_group(spark, folder):
    first = visits.first_per_group(samples(spark, folder), [PERSON], ["sampleid"])
    return first.select(PERSON, "sampleid", "sex", "agegr")


@register(
    "ever_positive_pct",
    _sql(
        """
        SELECT count(DISTINCT pseudoID) AS participants,
          count(DISTINCT pseudoID) FILTER (WHERE result LIKE '%positive%')
            AS n_positive,
          n_positive / participants * 100 AS pct_positive,
          count(DISTINCT pseudoID) FILTER (WHERE result = 'positive after infection')
            AS n_infected,
          n_infected / participants * 100 AS pct_infected
        FROM samples
        """
    ),
)
def ever_positive_pct(spark, folder):
    return freq.ever_positive_pct(
        samples(spark, folder), PERSON,
        {
            "positive": F.col(RESULT).contains("positive"),
            "infected": F.col(RESULT).contains(study.INFECTED),
        },
    )


_LEAD = "lead(result) OVER (PARTITION BY pseudoID ORDER BY datacolheita)"


@register(
    "lead_transition",
    _sql(
        f"""
        SELECT count(DISTINCT pseudoID) AS n
        FROM (SELECT pseudoID, result, {_LEAD} AS following FROM samples)
        WHERE result = 'positive after infection' AND following = 'negative'
        """
    ),
)
def lead_transition(spark, folder):
    return visits.lead_transition(
        samples(spark, folder), PERSON, DATE, RESULT, study.INFECTED, study.NEGATIVE
    )


_FOLLOWED = f"""
SELECT DISTINCT pseudoID FROM (SELECT pseudoID, {_LEAD} AS following FROM samples)
WHERE following <> 'positive after infection' AND pseudoID IN
  (SELECT pseudoID FROM samples WHERE result = 'positive after infection')
"""


@register("followed_after_positive", _sql(f"SELECT count(*) AS n FROM ({_FOLLOWED})"))
def followed_after_positive(spark, folder):
    return visits.followed_after_positive(
        samples(spark, folder), PERSON, DATE, RESULT, study.INFECTED
    )


@register(
    "seroreversion_pct",
    _sql(
        f"""
        SELECT reverted, followed, reverted / nullif(followed, 0) * 100 AS pct FROM
          (SELECT count(DISTINCT pseudoID) AS reverted FROM
            (SELECT pseudoID, result, {_LEAD} AS following FROM samples)
            WHERE result = 'positive after infection' AND following = 'negative'),
          (SELECT count(*) AS followed FROM ({_FOLLOWED}))
        """
    ),
)
def seroreversion_pct(spark, folder):
    return visits.reversion_share(
        samples(spark, folder), PERSON, DATE, RESULT, study.INFECTED, study.NEGATIVE
    )


_DAYS = """coalesce(datediff('day', lag(datacolheita) OVER
  (PARTITION BY pseudoID ORDER BY datacolheita), datacolheita), 90)"""


@register(
    "time_since_previous",
    _sql(
        f"SELECT pseudoID, datacolheita, CAST({_DAYS} AS INT) AS days "
        "FROM unvaccinated"
    ),
)
def time_since_previous(spark, folder):
    return visits.time_since_previous(
        unvaccinated_samples(spark, folder), PERSON, DATE
    ).select(PERSON, DATE, "days")


_HALVED = f"""SELECT *, CASE WHEN result = 'positive after infection'
  THEN {_DAYS} / 2 ELSE {_DAYS}::DOUBLE END AS days FROM unvaccinated"""


@register(
    "half_interval_on_event",
    _sql(f"SELECT pseudoID, datacolheita, days FROM ({_HALVED})"),
)
def half_interval_on_event(spark, folder):
    timed = visits.time_since_previous(
        unvaccinated_samples(spark, folder), PERSON, DATE
    )
    return visits.half_interval_on_event(timed, RESULT, study.INFECTED).select(
        PERSON, DATE, "days"
    )


_KEPT = f"""SELECT * FROM (SELECT *, lag(result, 1, '') OVER
    (PARTITION BY pseudoID ORDER BY datacolheita) AS previous FROM ({_HALVED}))
  WHERE NOT (previous = 'positive after infection'
    AND result = 'positive after infection')"""


@register(
    "censor_repeat_positive",
    _sql(f"SELECT pseudoID, datacolheita, result FROM ({_KEPT})"),
)
def censor_repeat_positive(spark, folder):
    return visits.censor_repeat_positive(
        unvaccinated_samples(spark, folder), PERSON, DATE, RESULT, study.INFECTED
    ).select(PERSON, DATE, RESULT)


@register(
    "first_last_by_date",
    _sql(
        """
        SELECT pseudoID, arg_min_null(sampleid, datacolheita) AS sampleid,
          arg_min_null(agegr, datacolheita) AS agegr,
          arg_min_null(vacinated, datacolheita) AS vacinated,
          arg_max_null(hiv, datacolheita) AS hiv
        FROM samples GROUP BY pseudoID
        """
    ),
)
def first_last_by_date(spark, folder):
    return visits.first_last_by_date(
        samples(spark, folder), PERSON, DATE,
        first=["sampleid", "agegr", "vacinated"], last=["hiv"],
    )


_SURVIVAL = f"""
SELECT pseudoID,
  CAST(coalesce(bool_or(result = 'positive after infection'), FALSE) AS INT) AS event,
  sum(days) / 30 AS time, min(datacolheita) AS inclusiondate, count(*) AS nsurveys,
  arg_min_null(sex, datacolheita) AS sex, arg_min_null(agegr, datacolheita) AS agegr,
  arg_max_null(hiv, datacolheita) AS hiv
FROM ({_KEPT}) GROUP BY pseudoID
"""


def survival(spark, folder):
    return visits.survival_table(
        unvaccinated_samples(spark, folder), PERSON, DATE, RESULT, study.INFECTED,
        first=["sex", "agegr"], last=["hiv"],
    )


@register("survival_table", _sql(_SURVIVAL))
def survival_table(spark, folder):
    return survival(spark, folder)


def monthly_samples(spark, folder, definition):
    view = data.sero_months(spark, folder)
    return view.withColumn(RESULT, study.sero_result(definition))


_DEFINED = {
    "seroresultRBD_NP": "analyte25_RBD >= 1 AND analyte26_NP >= 1",
    "seroresult2Ag": "CAST(analyte21_S1S2 >= 1 AS INT) + CAST(analyte25_RBD >= 1 AS "
    "INT) + CAST(analyte26_NP >= 1 AS INT) >= 2",
    "seroresultRBD": "analyte25_RBD >= 1",
}
_Z = 1.959963984540054


def _prevalence_sql(definition, *by):
    keys = ", ".join(by)
    return f"""
    SELECT {keys}, result, n, proportion,
      round(proportion - {_Z}::DOUBLE * se, 6) AS ci_low,
      round(proportion + {_Z}::DOUBLE * se, 6) AS ci_high
    FROM (SELECT *, sqrt(proportion * (1 - proportion) / total) AS se FROM (
      SELECT {keys}, result, count(*) AS n,
        sum(count(*)) OVER (PARTITION BY {keys}) AS total,
        count(*) / sum(count(*)) OVER (PARTITION BY {keys}) AS proportion
      FROM (SELECT {keys}, CASE WHEN NOT ({_DEFINED[definition]}) THEN 'negative'
          WHEN vacinated LIKE '%Sim%' THEN 'positive after vaccination'
          ELSE 'positive after infection' END AS result FROM sero_months)
      GROUP BY {keys}, result))
    """


def _register_prevalence(name, definition, *by):
    @register(name, sql(_prevalence_sql(definition, *by), "sero_months"))
    def prevalence(spark, folder):
        table = rates.prevalence_ci(
            monthly_samples(spark, folder, definition), RESULT, list(by)
        )
        return rounded(table, "ci_low", "ci_high")


_register_prevalence("prevalence_ci", "seroresultRBD_NP", "month")
_register_prevalence("prevalence_ci_2ag", "seroresult2Ag", "month")
_register_prevalence("prevalence_ci_rbd", "seroresultRBD", "month")
_register_prevalence("prevalence_ci_by_group", "seroresultRBD_NP", "agegr", "month")
_register_prevalence("prevalence_ci_by_group_2ag", "seroresult2Ag", "agegr", "month")


@register(
    "group_share",
    sql(
        """
        SELECT month, agegr, count(*) AS n,
          count(*) / sum(count(*)) OVER (PARTITION BY month) * 100 AS pct
        FROM sero_months GROUP BY month, agegr
        """,
        "sero_months",
    ),
)
def group_share(spark, folder):
    counts = data.sero_months(spark, folder).groupBy("month", "agegr").agg(
        F.count("*").alias("n")
    )
    return freq.share_within(counts, ["month"])


@register(
    "stat_denominator",
    sql(
        """
        SELECT agegr, count(*) AS n,
          count(*) / (SELECT count(*) FROM cohort WHERE agegr IS NOT NULL) * 100 AS pct,
          sum(event)::BIGINT AS cases,
          sum(event) / (SELECT sum(event) FROM cohort) * 100 AS pctcases
        FROM cohort WHERE agegr IS NOT NULL GROUP BY agegr
        """,
        "cohort",
    ),
)
def stat_denominator(spark, folder):
    """Shares of totals that are taken over differently filtered rows."""
    return freq.stat_denominator(data.cohort(spark, folder), "agegr", "event")


@register(
    "stack_ci_offset",
    sql(
        f"""
        WITH p AS ({_prevalence_sql("seroresultRBD_NP", "agegr", "month")
                    .replace("round(", "(").replace(", 6) AS", ") AS")}),
        v AS (SELECT agegr, month, proportion AS share FROM p
          WHERE result = 'positive after vaccination'),
        s AS (SELECT p.*, coalesce(share, 0) AS share FROM p
          LEFT JOIN v ON p.agegr = v.agegr AND p.month = v.month)
        SELECT agegr, month, result, n, proportion,
          round(CASE WHEN result <> 'positive after infection' THEN NULL
            WHEN ci_low + share < 0 THEN 0.01 ELSE ci_low + share END, 6) AS ci_low,
          round(CASE WHEN result = 'positive after infection' THEN ci_high + share END,
            6) AS ci_high
        FROM s
        """,
        "sero_months",
    ),
)
def stack_ci_offset(spark, folder):
    prevalence = rates.prevalence_ci(
        monthly_samples(spark, folder, "seroresultRBD_NP"), RESULT, ["agegr", "month"]
    )
    shifted = rates.stack_ci_offset(
        prevalence, RESULT, ["agegr", "month"], study.INFECTED, study.AFTER_VACCINE
    )
    return rounded(shifted, "ci_low", "ci_high")


def _rate_sql(select, source, events):
    return f"""
    SELECT {select} events, round(years, 6) AS person_years, round(rate, 6) AS rate,
      CASE WHEN rate <= 1 THEN round(rate - {_Z}::DOUBLE * sqrt(rate * (1 - rate)
        / years), 6) END AS ci_low,
      CASE WHEN rate <= 1 THEN round(rate + {_Z}::DOUBLE * sqrt(rate * (1 - rate)
        / years), 6) END AS ci_high
    FROM (SELECT {select} {events} AS events, sum(time) / 12 AS years,
        {events} / sum(time) * 12 AS rate FROM {source} {'GROUP BY ALL' if select else ''})
    """


_RATES = ["person_years", "rate", "ci_low", "ci_high"]


@register(
    "incidence_rate", sql(_rate_sql("", "cohort", "sum(event)::BIGINT"), "cohort")
)
def incidence_rate(spark, folder):
    return rounded(rates.incidence_rate(data.cohort(spark, folder), "time", "event"), *_RATES)


@register(
    "incidence_rate_by_group",
    sql(_rate_sql("agegr,", "cohort", "sum(event)::BIGINT"), "cohort"),
)
def incidence_rate_by_group(spark, folder):
    table = rates.incidence_rate(
        data.cohort(spark, folder), "time", "event", by=["agegr"]
    )
    return rounded(table, *_RATES)


@register(
    "incidence_rate_episodes",
    sql(
        _rate_sql("", "cohort", "(SELECT count(*) FROM cases)"),
        "cohort", "cases",
    ),
)
def incidence_rate_episodes(spark, folder):
    table = rates.episode_incidence(
        data.cohort(spark, folder), data.cases(spark, folder), "time"
    )
    return rounded(table, *_RATES)


@register(
    "ci_label",
    sql(
        f"""
        SELECT agegr, printf('%.2f-%.2f', ci_low, ci_high) AS ci
        FROM ({_rate_sql("agegr,", "cohort", "sum(event)::BIGINT")})
        """,
        "cohort",
    ),
)
def ci_label(spark, folder):
    table = incidence_rate_by_group(spark, folder)
    return table.select("agegr", fn.ci_label(F.col("ci_low"), F.col("ci_high")).alias("ci"))
