"""URL filters with dated lists: what was listed when the page was fetched.

List events (an entry was added or removed on a day) become validity intervals.  A
capture is evaluated against the intervals that cover its fetch day, by an as-of join
on host and day.  An entry covers its domain and everything below; the most specific
active entry decides, and of equally specific ones a blocking one.

Captures are reduced to different (host, day) pairs before anything is joined, so a
host with very many captures is as cheap as its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortsmith.llm.tables import column

# Scheme, optional user, host.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a closing dot; empty for NULL and for what is no URL."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    return F.regexp_replace(host, r"\.+$", "")


def domains(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def validity(events: DataFrame) -> DataFrame:
    """``list, blocks, domain, valid_from, valid_to`` out of dated events.

    ``events``: ``list``, ``blocks`` (true for a blocking list), ``domain``, ``added``
    (true or false) and ``day``.  An entry is valid from the day it is added up to,
    but not on, the day it is removed (NULL: still valid).  Of contrary events on one
    day the addition counts; repeated events change nothing; events without domain or
    day are ignored.
    """
    per_day = (
        events.where(F.col("domain").isNotNull() & F.col("day").isNotNull())
        .groupBy("list", "blocks", F.lower("domain").alias("domain"), "day")
        .agg(F.max("added").alias("added"))
    )
    history = Window.partitionBy("list", "blocks", "domain").orderBy("day")
    changes = per_day.withColumn(
        "before", F.coalesce(F.lag("added").over(history), F.lit(False))
    ).where(F.col("before") != F.col("added"))
    return (
        changes.withColumn("valid_to", F.lead("day").over(history))
        .where("added")
        .select("list", "blocks", "domain", F.col("day").alias("valid_from"), "valid_to")
    )


def evaluate(
    captures: DataFrame,
    events: DataFrame,
    url_column: str = "url",
    day_column: str = "fetched",
    id_column: str = "page_id",
) -> DataFrame:
    """Every capture with the verdict of the lists on its fetch day.

    Returns ``id_column``, ``url_column``, ``host``, ``day_column``, ``n_active``
    (entries that applied), ``decided_by`` (domain of the deciding entry), ``list``,
    ``listed_since`` and ``blocked``.  A capture without host or day, or that no entry
    covers, is not blocked.  Repeated captures each get their row; other columns of
    ``captures`` do not matter.
    """
    seen = captures.select(
        column(captures, id_column).alias("id"), column(captures, url_column).alias("url"),
        host_of(column(captures, url_column)).alias("host"),
        column(captures, day_column).alias("day"),
    )
    moments = seen.where((F.col("host") != "") & F.col("day").isNotNull()).select(
        "host", "day"
    ).distinct()
    of_host = (
        moments.select("host").distinct()
        .select("host", F.explode(domains(F.col("host"))).alias("covered"))
        .join(validity(events), F.col("covered") == F.col("domain"))
        .select(
            F.col("host").alias("of"), "list", "blocks", "domain", "valid_from", "valid_to"
        )
    )
    active = moments.join(
        of_host,
        (F.col("host") == F.col("of")) & (F.col("valid_from") <= F.col("day"))
        & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))),
    )
    rank = F.struct(
        F.size(F.split("domain", r"\.")).alias("labels"), "blocks",
        F.date_diff(F.lit("9999-12-31").cast("date"), "valid_from").alias("age"),
        "list", "domain", "valid_from",
    )
    verdicts = active.groupBy(F.col("host").alias("of"), F.col("day").alias("on")).agg(
        F.count("*").alias("n_active"), F.max(rank).alias("entry")
    )
    return seen.join(
        verdicts, (F.col("host") == F.col("of")) & (F.col("day") == F.col("on")), "left"
    ).select(
        F.col("id").alias(id_column), F.col("url").alias(url_column), "host",
        F.col("day").alias(day_column),
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.col("entry.domain").alias("decided_by"), F.col("entry.list").alias("list"),
        F.col("entry.valid_from").alias("listed_since"),
        F.coalesce("entry.blocks", F.lit(False)).alias("blocked"),
    )
