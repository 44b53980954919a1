"""Readers for the study files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, StructType

from cohortsmith.sources import schemas

MISSING = "NA"


def _typed(name: str, kind: DataType) -> Column:
    """Only the text ``NA`` is missing; a blank is missing unless it is text."""
    raw = F.coalesce(F.col(f"`{name}`"), F.lit(""))
    known = F.when(raw != MISSING, raw)
    if isinstance(kind, StringType):
        return known
    if isinstance(kind, DateType):
        return F.try_to_date(known, "yyyy-MM-dd")
    return known.try_cast(kind)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, matched to ``schema`` by column name.

    Columns the file lacks come back as NULL, columns the schema lacks are not
    read.  Files of one folder need the same header, else the read fails.  No type
    inference: the only look at the data is the header line.
    """
    read = spark.read.options(header=True, quote='"', escape='"', encoding="UTF-8")
    # Files of a folder must agree in their headers; Spark compares each with the first.
    raw = read.schema(read.csv(path).schema).option("enforceSchema", False).csv(path)
    present = set(raw.columns)
    return raw.select([
        (
            _typed(f.name, f.dataType)
            if f.name in present
            else F.lit(None).cast(f.dataType)
        ).alias(f.name)
        for f in schema.fields
    ])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.CASES)


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.COHORT)


def read_serosurvey(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.SEROSURVEY)


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.VISITS)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.POINTS)
