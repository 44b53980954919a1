"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_scopes: dict[str, list[list[str]]] = {}

# The JVM does not compile methods beyond this many bytes of bytecode.  Spark's
# own default lets generated code for wide projections run interpreted instead.
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
COMPILED_METHOD_BYTES = "8000"

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Session settings that wide recodes and unpivots profit from."""
    if spark.conf.get(HUGE_METHOD) == "65535":
        spark.conf.set(HUGE_METHOD, COMPILED_METHOD_BYTES)
    return spark


def scratch_path(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only a local-mode
    session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_scratch:
        _local_scratch[sc.applicationId] = tempfile.mkdtemp(prefix="cohortsmith-")
    return _local_scratch[sc.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nothing has been written to; it belongs to the innermost open scope."""
    path = f"{scratch_path(spark)}/{label}-{uuid.uuid4().hex}"
    for scope in _scopes.get(spark.sparkContext.applicationId, [])[-1:]:
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables written inside when the block ends or fails.

    Results are computed when they are used, and then read such tables: write or
    collect them inside the block.  Only paths handed out by ``fresh_path`` in the
    block are deleted, nothing else in the shared folder.  Without a block the tables
    stay for the user to remove.
    """
    scopes = _scopes.setdefault(spark.sparkContext.applicationId, [])
    own: list[str] = []
    scopes.append(own)
    try:
        yield
    finally:
        scopes.remove(own)
        delete(spark, own)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables from whatever file system they are on; absent ones are skipped."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside the block delete their shuffle files when they end.

    Otherwise files stay until the driver happens to collect its garbage.  For queries
    that run once, as those that write a table; Spark before 4.1 keeps the files.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used for results that several later jobs read.  The written table survives
    the loss of executors and cuts the lineage.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
