"""Readers and writers."""

from pathlib import Path

import pytest
from pyspark.sql.types import StructType

from cohortsmith import session, sources
from cohortsmith.sources import schemas


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_missing_values(spark, tmp_path, rows):
    path = write(
        tmp_path / "cases.csv",
        '"","testresult","fever","oxygen_saturation","week","valorct"\n'
        '"1","positive","Não sabe",94.5,"2021-03-01","23.4"\n'
        '"2",NA,"",NA,NA,NA\n'
        '"3","NA",,,,\n',
    )
    got = sources.read_cases(spark, path)
    assert got.schema == schemas.CASES
    assert rows(got, "testresult", "fever", "oxygen_saturation") == [
        (None, "", None), (None, "", None), ("positive", "Não sabe", 94.5)
    ]
    assert got.where("week IS NOT NULL").count() == 1
    assert got.where("age IS NOT NULL").count() == 0


def test_columns_are_matched_by_name(spark, tmp_path, rows):
    path = write(tmp_path / "points.csv", "n,other,latitude,longitude\n3,x,-25.9,32.6\n")
    got = sources.read_points(spark, path)
    assert rows(got, "longitude", "latitude", "n") == [(32.6, -25.9, 3)]


@pytest.mark.parametrize("schema", [
    schemas.CASES, schemas.COHORT, schemas.SEROSURVEY, schemas.VISITS, schemas.POINTS
])
def test_schemas_have_distinct_columns(schema: StructType):
    assert len(set(schema.names)) == len(schema.names)


def test_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame(
        [("a, \"b\"", 1.5, 1), ("", None, None), (None, 0.1, 0), ("linha\nnova", 2.0, 1)],
        "agegr string, time double, event int",
    )
    path = str(tmp_path / "out")
    sources.write_table(df.where("agegr IS NULL OR agegr NOT LIKE 'linha%'"), path)
    got = sources.read_cohort(spark, path).select("agegr", "time", "event")
    assert rows(got) == rows(df.where("agegr IS NULL OR agegr NOT LIKE 'linha%'"))
    with pytest.raises(Exception, match="already exists"):
        sources.write_table(df, path)


def test_partitioned_parquet(spark, tmp_path, rows):
    df = spark.createDataFrame([("p", 1), ("n", 2)], "r string, n int")
    path = str(tmp_path / "parquet")
    sources.write_table(df, path, "parquet", partition_by=["r"])
    assert rows(spark.read.parquet(path), "r", "n") == [("n", 2), ("p", 1)]


def test_scratch_is_the_configured_folder(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.scratch_path(spark) == configured.rstrip("/")


def test_materialize(spark, rows):
    df = spark.createDataFrame([("a b", 1), (None, 2)], "`x=1` string, n int")
    assert rows(session.materialize(df, "check")) == [(None, 2), ("a b", 1)]


def test_tuning_keeps_a_limit_the_user_chose(spark):
    default = spark.conf.get(session.HUGE_METHOD)
    try:
        spark.conf.set(session.HUGE_METHOD, "65535")
        session.tune(spark)
        assert spark.conf.get(session.HUGE_METHOD) == session.COMPILED_METHOD_BYTES
        spark.conf.set(session.HUGE_METHOD, "12345")
        session.tune(spark)
        assert spark.conf.get(session.HUGE_METHOD) == "12345"
    finally:
        spark.conf.set(session.HUGE_METHOD, default)


def test_scratch_tables_are_deleted_with_their_block(spark, rows):
    df = spark.createDataFrame([(1,), (2,)], "n int")

    def written(label):
        return list(Path(session.scratch_path(spark)).glob(f"{label}-*"))

    stays = session.materialize(df, "stays")
    with session.scratch(spark):
        outer = session.materialize(df, "outer")
        with session.scratch(spark):
            inner = session.materialize(df, "inner")
            assert rows(inner) == [(1,), (2,)]
        assert not written("inner")
        session.fresh_path(spark, "unused")
        assert rows(outer) == [(1,), (2,)]
    assert not written("outer")
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        session.materialize(df, "failed")
        1 / 0
    assert not written("failed")
    session.materialize(df, "later")
    assert rows(stays) == [(1,), (2,)] and written("later")
