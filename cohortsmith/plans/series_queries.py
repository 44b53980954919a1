"""Time series, histograms and grids."""

from pyspark.sql import functions as F

from cohortsmith import functions as fn
from cohortsmith.operators import filters, series
from cohortsmith.plans import bindings as data
from cohortsmith.plans import covariates as study
from cohortsmith.plans.bindings import sql
from cohortsmith.plans.recode_queries import clamped_delay
from cohortsmith.plans.registry import register
from cohortsmith.plans.table_queries import joined_people, rounded, _JOINED, _TIER
from cohortsmith.sources.spine import date_spine, group_spine


@register(
    "epicurve_weekly",
    sql(
        """
        SELECT CAST(date_trunc('week', onset) AS DATE) AS week,
          coalesce(testresult, 'not tested') AS testresult, count(*) AS n
        FROM cases GROUP BY ALL
        """,
        "cases",
    ),
)
def epicurve_weekly(spark, folder):
    filled = data.cases(spark, folder).withColumn(
        "testresult",
        fn.fill_missing_category("testresult", "not tested", study.RESULTS),
    )
    return series.epicurve_weekly(filled, "onset", "testresult")


@register(
    "epicurve_visits",
    sql(
        "SELECT CAST(date_trunc('week', contact_date) AS DATE) AS week, "
        "respiratory_symptoms, count(*) AS n FROM visits GROUP BY ALL",
        "visits",
    ),
)
def epicurve_visits(spark, folder):
    return series.epicurve_weekly(
        data.visits(spark, folder), "contact_date", "respiratory_symptoms"
    )


def _limits(cases):
    """Spine that leaves out the first and the last ten days of the data."""
    start = cases.agg(F.date_add(F.min("onset"), 10)).scalar()
    end = cases.agg(F.date_sub(F.max("onset"), 10)).scalar()
    return start, end


_LIMITS = "(SELECT min(onset) + 10 AS a, max(onset) - 10 AS b FROM cases)"


@register(
    "date_spine",
    sql(
        f"""
        SELECT testresult, CAST(d AS DATE) AS date FROM
          (SELECT DISTINCT testresult FROM cases WHERE testresult IS NOT NULL),
          (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
            INTERVAL 1 DAY)) AS d FROM {_LIMITS})
        """,
        "cases",
    ),
)
def dates(spark, folder):
    """The calendar for every result: each gets a value for every date."""
    cases = data.cases(spark, folder)
    results = filters.not_null(cases, "testresult").select("testresult").distinct()
    return results.crossJoin(date_spine(spark, *_limits(cases)))


@register(
    "calendar_days",
    sql(
        f"""
        SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
          INTERVAL 1 DAY)) AS DATE) AS date FROM {_LIMITS}
        """,
        "cases",
    ),
)
def calendar_days(spark, folder):
    return date_spine(spark, *_limits(data.cases(spark, folder)))


@register(
    "group_spine",
    sql(
        f"""
        SELECT testresult, CAST(d AS DATE) AS date FROM
          (SELECT DISTINCT testresult FROM cases WHERE testresult IS NOT NULL),
          (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
            INTERVAL 1 DAY)) AS d FROM {_LIMITS})
        """,
        "cases",
    ),
)
def dates_per_result(spark, folder):
    cases = filters.not_null(data.cases(spark, folder), "testresult")
    return group_spine(cases, ["testresult"], *_limits(data.cases(spark, folder)))


_SPINED = f"""
SELECT s.testresult, s.date, coalesce(n, 0) AS ntotal FROM
  (SELECT testresult, CAST(d AS DATE) AS date FROM
    (SELECT DISTINCT testresult FROM cases WHERE testresult IS NOT NULL),
    (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
      INTERVAL 1 DAY)) AS d FROM {_LIMITS})) s
  LEFT JOIN (SELECT testresult, onset, count(*) AS n FROM cases GROUP BY ALL) c
    ON s.testresult = c.testresult AND s.date = c.onset
"""
_WINDOW = "PARTITION BY testresult ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"
_AVERAGED = f"""
SELECT testresult, date, ntotal,
  CASE WHEN count(*) OVER ({_WINDOW}) = 7 THEN avg(ntotal) OVER ({_WINDOW}) END AS ma
FROM ({_SPINED})
"""


def spined(spark, folder):
    cases = data.cases(spark, folder)
    daily = series.daily_counts(filters.not_null(cases, "testresult"), "onset", "testresult")
    return series.spine_join(daily, "testresult", *_limits(cases))


def averaged(spark, folder):
    return series.rolling_mean_centered(spined(spark, folder), "testresult")


@register("spine_join", sql(_SPINED, "cases"))
def spine_join(spark, folder):
    return spined(spark, folder)


@register("rolling_mean_centered", sql(_AVERAGED, "cases"))
def rolling_mean_centered(spark, folder):
    return averaged(spark, folder)


@register(
    "series_align",
    sql(
        f"""
        SELECT date, ntotal AS cases, ma AS "MA7days" FROM ({_AVERAGED})
        WHERE testresult = 'negative'
        """,
        "cases",
    ),
)
def series_align(spark, folder):
    one = averaged(spark, folder).where(F.col("testresult") == "negative")
    return one.select("date", "ntotal", "ma").toDF("date", "cases", "MA7days")


@register(
    "union_series",
    sql(
        f"""
        SELECT date, ntotal AS cases, ma AS "MA7days",
          CASE testresult WHEN 'negative' THEN 'PCR negative cases'
            ELSE 'PCR confirmed cases' END AS result
        FROM ({_AVERAGED})
        """,
        "cases",
    ),
)
def union_series(spark, folder):
    """Both series below each other; they come out of one pass."""
    labels = {"negative": "PCR negative cases", "positive": "PCR confirmed cases"}
    return averaged(spark, folder).select(
        "date", F.col("ntotal").alias("cases"), F.col("ma").alias("MA7days"),
        fn.recode_map("testresult", labels).alias("result"),
    )


@register(
    "stacked_daily_ma",
    sql(
        f"SELECT date, testresult, round(sum(ma), 6) AS value FROM ({_AVERAGED}) "
        "GROUP BY ALL",
        "cases",
    ),
)
def stacked_daily_ma(spark, folder):
    stacked = series.stacked_daily(averaged(spark, folder), "date", "testresult", "ma")
    return rounded(stacked, "value")


@register(
    "histogram",
    sql(
        f"""
        WITH tiers AS (SELECT age, {_TIER} AS tier FROM ({_JOINED})
            WHERE age IS NOT NULL),
        span AS (SELECT min(age) AS low, (max(age) - min(age)) / 20 AS width
          FROM tiers)
        SELECT tier, CAST(least(floor((age - low) / width), 19) AS BIGINT) AS bin,
          count(*) AS n,
          any_value(low + least(floor((age - low) / width), 19) * width) AS bin_start
        FROM tiers, span GROUP BY 1, 2
        """,
        "cohort", "cases",
    ),
)
def histogram(spark, folder):
    tier = fn.outcome_tier("n_episodes", "n_confirmed", study.OUTCOMES)
    people = joined_people(spark, folder).withColumn("tier", tier)
    return series.histogram(people, "age", "tier", bins=20)


_GRID = (
    "CAST(floor(longitude / 0.005) AS BIGINT) AS lon_cell, "
    "CAST(floor(latitude / 0.005) AS BIGINT) AS lat_cell"
)


@register(
    "point_density",
    sql(f"SELECT {_GRID}, sum(n)::BIGINT AS n FROM points GROUP BY ALL", "points"),
)
def point_density(spark, folder):
    return series.point_density(
        data.points(spark, folder), "longitude", "latitude", 0.005, weight="n"
    )


@register(
    "point_density_by_result",
    sql(
        f"SELECT {_GRID}, testresult, count(*) AS n FROM case_points GROUP BY ALL",
        "case_points",
    ),
)
def point_density_by_result(spark, folder):
    return series.point_density(
        data.case_points(spark, folder), "longitude", "latitude", 0.005,
        by=["testresult"],
    )


@register(
    "scatter_by_group",
    sql(
        """
        WITH d AS (SELECT agegr, TRY_CAST(valorct AS DOUBLE) AS ct,
          CASE WHEN coalesce(datacolheita_x, datacolheita_y) IS NOT NULL THEN
            greatest(0, datediff('day', data_inicio_sintomas,
              coalesce(datacolheita_x, datacolheita_y))) END AS delay
          FROM swabs WHERE testresult = 'positive')
        SELECT agegr, delay AS x_cell, CAST(floor(ct / 2) AS BIGINT) AS y_cell,
          count(*) AS n
        FROM d WHERE delay BETWEEN 0 AND 20 AND ct IS NOT NULL GROUP BY ALL
        """,
        "swabs",
    ),
)
def scatter_by_group(spark, folder):
    confirmed = data.swabs(spark, folder).where(F.col("testresult") == "positive")
    measured = confirmed.withColumns(
        {"delay": clamped_delay(), "ct": fn.to_number("valorct")}
    )
    return series.scatter_by_group(
        measured, "delay", "ct", "agegr", (0, 20), x_step=1, y_step=2
    )
