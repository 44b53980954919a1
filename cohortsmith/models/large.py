"""Models whose covariate patterns do not fit one task, all in one table.

The table is written once, partitioned by model.  A pass evaluates any number of
coefficient vectors of any models: every task reduces its patterns to sums with one
matrix product per vector, and Spark adds the tasks' sums.  Models that need nothing
more are not read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohortsmith.models.design import Cat, Term, expand, resolve, variables
from cohortsmith.session import fresh_path


@dataclass
class Large:
    """``rows`` has the model's number ``at``, its variables and the counts."""

    rows: DataFrame
    terms: list[list[Term]]
    keys: list[tuple]
    n_patterns: list[int]

    def active(self, models: Sequence[int]) -> DataFrame:
        return self.rows.where(F.col("at").isin([int(m) for m in sorted(set(models))]))


def gather(
    table: DataFrame,
    model_keys: Sequence[str],
    sizes: Sequence[tuple[tuple, int]],
    terms_of: Callable[[str], list[Term]],
) -> Large:
    """The large models of a table of patterns, as a table of their own.

    ``sizes``: key values and patterns of the large models; there are at most as many
    as the table's size divided by the limit.  Levels that terms leave open are
    collected for all models in one job.
    """
    spark = table.sparkSession
    keys = [key for key, _ in sizes]
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    numbers = spark.createDataFrame(
        [(i, *key) for i, key in enumerate(keys)],
        "at int, " + ", ".join(f"key_{k} {kinds[k]}" for k in model_keys),
    )
    same = F.lit(True)
    for k in model_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"key_{k}"))
    path = fresh_path(spark, "large")
    # One row per large model on the right.
    table.join(F.broadcast(numbers), same).drop(
        *[f"key_{k}" for k in model_keys]
    ).write.partitionBy("at").parquet(path)
    schema = StructType([*table.schema.fields, StructField("at", IntegerType())])
    rows = spark.read.schema(schema).parquet(path)
    terms = [terms_of(key[0]) for key in keys]
    open_names = sorted({
        v.name for own in terms for v in variables(own)
        if isinstance(v, Cat) and v.levels is None
    })
    present: dict[int, dict[str, list[str]]] = {}
    if open_names:
        for row in rows.groupBy("at").agg(
            *[F.collect_set(F.col(n)).alias(n) for n in open_names]
        ).collect():
            present[row["at"]] = {n: row[n] for n in open_names}
    terms = [resolve(own, present.get(i, {})) for i, own in enumerate(terms)]
    return Large(rows, terms, keys, [n for _, n in sizes])


def arrow_design(batch: pa.RecordBatch, terms: Sequence[Term]) -> np.ndarray:
    """Design columns of resolved terms, rows by columns."""
    codes: dict[str, np.ndarray] = {}

    def indicator(part: Cat, level: str) -> np.ndarray:
        if part.name not in codes:
            at = pc.index_in(batch.column(part.name), value_set=pa.array(part.levels, pa.string()))
            codes[part.name] = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        return (codes[part.name] == part.levels.index(level)).astype(float)

    def number(part) -> np.ndarray:
        return batch.column(part.name).cast(pa.float64()).to_numpy(zero_copy_only=False)

    pairs = expand(terms, indicator, number)
    if not pairs:
        return np.empty((batch.num_rows, 0))
    return np.column_stack([column for _, column in pairs])


def by_model(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows per model."""
    at = batch.column("at").to_numpy(zero_copy_only=False)
    found = np.unique(at)
    if len(found) == 1:
        yield int(found[0]), batch
        return
    for model in found:
        yield int(model), batch.filter(pa.array(at == model))


def added_up(
    rows: DataFrame,
    reduce_rows: Callable[[int, pa.RecordBatch], Iterator[tuple[tuple, np.ndarray]]],
    keys: Mapping[str, str],
) -> dict[tuple, np.ndarray]:
    """Sums of vectors over all rows, by key.

    ``reduce_rows(model, rows)`` gives ``(key, sums)`` pairs.  They are added up per task
    first, then by Spark; one vector per key reaches the driver.
    """
    names = list(keys)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for model, part in by_model(batch):
                for key, sums in reduce_rows(model, part):
                    totals[key] = totals[key] + sums if key in totals else sums
        yield as_batch(totals, names)

    return collected(rows.mapInArrow(reduced, sums_schema(keys)), names)


def sums_schema(keys: Mapping[str, str]) -> str:
    return ", ".join([*[f"{n} {kind}" for n, kind in keys.items()], "sums array<double>"])


def as_batch(totals: Mapping[tuple, np.ndarray], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            *[pa.array([key[i] for key in totals], pa.int32()) for i in range(len(names))],
            pa.array([v.astype(float) for v in totals.values()], pa.list_(pa.float64())),
        ],
        names=[*names, "sums"],
    )


def collected(partial: DataFrame, names: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Elementwise sums of the arrays by key."""
    found = (
        partial.select(*names, F.posexplode("sums").alias("place", "value"))
        .groupBy(*names, "place").agg(F.sum("value").alias("value"))
        .toArrow().to_pandas()
        .sort_values([*names, "place"], ignore_index=True)
    )
    out: dict[tuple, np.ndarray] = {}
    if len(found):
        keys = found[list(names)].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for a, b in zip(starts, [*starts[1:], len(found)]):
            out[tuple(int(v) for v in keys[a])] = found["value"].to_numpy()[a:b]
    return out


def upper(matrix_sums: Sequence[float], p: int) -> np.ndarray:
    """Symmetric matrix from its upper triangle, row by row."""
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = matrix_sums
    return out + np.triu(out, 1).T
