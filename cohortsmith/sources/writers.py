"""Writers for result and intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortsmith.sources.readers import MISSING


def write_table(
    df: DataFrame,
    path: str,
    format: str = "csv",
    partition_by: list[str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write one file per partition; CSV gets a header and ``NA`` for NULL."""
    writer = df.write.mode(mode).format(format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer = writer.options(
            header=True, nullValue=MISSING, emptyValue='""', escape='"',
            dateFormat="yyyy-MM-dd", encoding="UTF-8",
        )
    writer.save(path)
