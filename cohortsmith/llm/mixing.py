"""Mixing sources to target weights by Pareto order sampling.

Every document is taken ``target / size of its source`` times on average.  The
whole part of that is certain.  For the rest each document gets a random number
``u`` and the rank ``odds(u) / odds(inclusion probability)``; a source takes its
documents in rank order until its words are used up, so the size of the sample is
fixed and only its members are random; what the first document that no longer fits
leaves goes to the next ones that do.  ``u`` is a hash of the document, so that
reruns and recomputed tasks agree.

No source is sorted as a whole.  Words are summed per rank range; only the range
in which a source reaches its words is sorted, and it holds about
``ROWS_PER_RANGE`` rows at any size of the input.  That range is read to its end, so
that a few rounds are enough, each a small number of jobs of the same plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortsmith.llm.tables import WORD, column, uniform
from cohortsmith.session import materialize

ROWS_PER_RANGE = 2_000
SPANS = "array<struct<after: double, through: double, fits: double, words: bigint>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def allocate(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Target size per source: by weight, at most ``most`` times its own size.

    ``sources`` has one row per source (``source``, ``source_size``).  Weights
    repeat over the sources in code point order, NULL last.  What a source cannot
    take is shared again by weight until no source is above its limit; sorted by
    the level at which a source reaches its limit, that is one running sum.
    """
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    position = (F.row_number().over(order) - 1) % len(weights)
    weighted = sources.select(
        "source", "source_size", F.get(cycle, position).alias("weight"),
        (F.lit(float(most)) * F.col("source_size")).alias("limit"),
    )
    everything = Window.partitionBy()
    by_level = Window.partitionBy().orderBy(
        F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum("limit").over(before), F.lit(0.0)
    )
    weight_left = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0.0)
    )
    levels = weighted.withColumn("level", left / weight_left).withColumn(
        "place", F.row_number().over(by_level)
    )
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    # The level of the first source that fits; later ones, ties too, have lower levels.
    shared = F.min(F.when(fits, F.struct("place", "level")))
    return levels.withColumn("shared", shared.over(everything)).select(
        "source", "source_size",
        F.least(
            F.col("limit"),
            F.coalesce(F.col("shared.level") * F.col("weight"), F.col("limit")),
        ).alias("target"),
    )


def _span(after: Column, through: Column, fits: Column, words: Column) -> Column:
    """Taken are the ranks beyond ``after`` up to ``through`` of sizes up to ``fits``."""
    return F.struct(
        after.alias("after"), through.alias("through"), fits.alias("fits"),
        words.cast("long").alias("words"),
    )


def _take(state: Column, unit: Column) -> Column:
    """One more rank: taken if it fits; else the span ends, and the next one is narrower."""
    span, left = state["span"], state["left"]
    fits = unit["words"] <= left
    blocks = ~fits & (unit["size"] <= span["fits"])
    more = _span(span["after"], unit["rank"], span["fits"], span["words"] + unit["words"])
    new = _span(unit["rank"], unit["rank"], left, F.lit(0))
    return F.struct(
        F.when(fits, left - unit["words"]).otherwise(left).alias("left"),
        F.when(blocks, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        .alias("spans"),
        F.when(fits, more).when(blocks, new).otherwise(span).alias("span"),
    )


def _largest_prefix(open_rows: DataFrame, rows_total: int) -> DataFrame:
    """Per source the last rank whose running words stay within ``budget``, and what follows.

    ``open_rows``: ``source``, ``size``, ``rank`` in (0, 1) and ``budget``.  Rows
    of equal rank are taken together or not at all.  ``edge`` and ``words`` are those of
    the prefix.  The range in which it ends is read on in rank order, and what still fits
    is taken: ``spans`` lists all that is, ``left`` is what then stays open, and ``done``
    the rank up to which nothing is undecided.
    """
    n_ranges = max(1, math.ceil(rows_total / ROWS_PER_RANGE))
    ranged = open_rows.withColumn(
        "range", F.floor(F.col("rank") * n_ranges).cast("long")
    )
    sums = ranged.groupBy("source", "range").agg(
        F.sum("size").alias("words"), F.max("rank").alias("last"),
        F.first("budget").alias("budget"),
    )
    so_far = Window.partitionBy("source").orderBy("range")
    running = sums.withColumn("through", F.sum("words").over(so_far))
    within = F.col("through") <= F.col("budget")
    # The first range that goes beyond; NULL if all rows fit.
    cuts = running.groupBy(F.col("source").alias("of")).agg(
        F.min(F.when(~within, F.col("range"))).alias("cut"),
        F.coalesce(F.max(F.when(within, F.col("through"))), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.when(within, F.col("last"))), F.lit(0.0)).alias("last"),
        F.first("budget").alias("budget"),
    )
    # One row per source on the right; the rows of a large source are split.
    inside = ranged.select("source", "range", "rank", "size").join(
        cuts.select(F.col("of").alias("cut_of"), "cut"),
        F.col("source").eqNullSafe(F.col("cut_of")) & (F.col("range") == F.col("cut")),
    )
    units = inside.groupBy("source", "rank").agg(
        F.sum("size").alias("words"), F.min("size").alias("size")
    ).groupBy(F.col("source").alias("units_of")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "words", "size"))).alias("units")
    )
    no_spans = F.expr(f"CAST(array() AS {SPANS})")
    start = F.struct(
        (F.col("budget") - F.col("before")).alias("left"), no_spans.alias("spans"),
        _span(F.lit(0.0), F.col("last"), F.col("budget"), F.col("before")).alias("span"),
    )
    nothing = F.expr("CAST(array() AS array<struct<rank: double, words: bigint, size: bigint>>)")
    scanned = cuts.join(units, F.col("of").eqNullSafe(F.col("units_of")), "left").select(
        "of", F.coalesce("units", nothing).alias("units"),
        F.aggregate(F.coalesce("units", nothing), start, _take).alias("end"),
    ).select(
        "of", "units", F.col("end.left").alias("left"),
        F.concat("end.spans", F.array("end.span")).alias("spans"),
    )
    return scanned.select(
        "of", F.get("spans", F.lit(0))["through"].alias("edge"),
        F.get("spans", F.lit(0))["words"].alias("words"), "spans", "left",
        F.coalesce(F.try_element_at("units", F.lit(-1))["rank"], F.lit(1.0)).alias("done"),
    )


def substance(size: Column) -> Column:
    """An appeal that grows slowly with a document's words."""
    return F.log2(size + F.lit(2.0))


Appeal = Column | Callable[[Column], Column] | None


def _ranks(rows: DataFrame, seed: int) -> DataFrame:
    """``rank`` in (0, 1) of sized rows with their source's ``odds``."""
    u = uniform(seed, F.col("id"), F.col("size"), F.col("source"))
    odds = F.try_divide(F.try_divide(u, 1 - u), F.col("appeal") * F.col("odds"))
    return rows.withColumn("rank", F.when(F.col("odds") > 0, odds / (1 + odds)))


def _taken() -> Column:
    """A rank within a span that the document is small enough for."""
    return F.coalesce(
        F.exists("spans", lambda s: (F.col("rank") > s["after"])
                 & (F.col("rank") <= s["through"]) & (F.col("size") <= s["fits"])),
        F.lit(False),
    )


def _copies() -> Column:
    copies = F.col("whole") + _taken().cast("long")
    return F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long"))


def _mixture(
    sized: DataFrame, weights: Sequence[float], most: float, seed: int
) -> DataFrame:
    """What every source takes: one row per source, with its ``spans``.

    A source takes documents in rank order and leaves out what does not fit, until none
    is left that does.  A round decides up to the end of the rank range in which words run
    out; what then stays open is so little that few documents are candidates for the next.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = allocate(sources, weights, most).withColumnRenamed("source", "of")
    # Words that whole copies leave open, and the odds that go with them.
    per_copy = F.try_divide(F.col("target"), F.col("source_size"))
    whole = F.coalesce(F.floor(per_copy + F.lit(1e-12)), F.lit(0)).cast("long")
    budget = F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0))
    part = F.try_divide(budget, F.col("source_size"))
    current = materialize(
        targets.select(
            "*", whole.alias("whole"), budget.alias("budget"),
            F.try_divide(part, 1 - part).alias("odds"),
            F.lit(0.0).alias("done"), F.expr(f"CAST(array() AS {SPANS})").alias("spans"),
        ),
        "mix",
    )
    kept = [c for c in current.columns if c not in ("budget", "done", "spans")]
    n_open = sized.count()
    while n_open:
        found = _largest_prefix(_open(sized, current, seed), n_open).select(
            F.col("of").alias("found_of"), "left", F.col("done").alias("found_done"),
            F.col("spans").alias("found_spans"),
        )
        joined = current.join(found, F.col("of").eqNullSafe(F.col("found_of")), "left")
        current = materialize(
            joined.select(
                *kept, F.coalesce("left", "budget").alias("budget"),
                F.coalesce("found_done", "done").alias("done"),
                F.coalesce(F.concat("spans", "found_spans"), "spans").alias("spans"),
            ),
            "mix",
        )
        # One range holds all ranks: every one is decided.
        n_open = n_open > ROWS_PER_RANGE and _open(sized, current, seed).count()
    return current


def _open(sized: DataFrame, current: DataFrame, seed: int) -> DataFrame:
    """Documents beyond the ranks that are decided and no larger than what is left."""
    ranked = _ranks(sized.join(current, F.col("source").eqNullSafe(F.col("of"))), seed)
    return ranked.where(
        (F.col("size") > 0) & (F.col("size") <= F.col("budget"))
        & (F.col("rank") > F.col("done"))
    ).select("source", "size", "rank", "budget")


def sample_copies(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    appeal: Appeal = None,
    seed: int = 20,
) -> DataFrame:
    """How often the mix takes each document.

    Returns ``id_column``, ``source_column``, ``size`` (words, NULL text 0),
    ``source_size``, ``target``, ``copies`` and ``taken`` (``copies * size``), one
    row per input row.  All targets together are as large as the input.

    ``appeal`` makes inclusion odds differ inside a source: a column of ``docs``, or a
    function of the size, with positive numbers; a document with twice the number has
    twice the odds of the extra copy.  The size of the sample stays the same.

    NULL sources form one source that comes last.  Documents without words are
    never taken.  Rows equal in id, size and source share their fate.  An empty
    table gives an empty result.  The words per document are counted once and
    written to the shared folder.
    """
    sized = materialize(_sized(docs, id_column, text_column, source_column, appeal), "sizes")
    current = _mixture(sized, weights, most, seed)
    final = _ranks(sized.join(current, F.col("source").eqNullSafe(F.col("of"))), seed)
    return final.select(
        F.col("id").alias(id_column), F.col("source").alias(source_column), "size",
        "source_size", "target", _copies().alias("copies"),
        (_copies() * F.col("size")).alias("taken"),
    )


def _sized(
    docs: DataFrame, id_column: str, text_column: str, source_column: str, appeal: Appeal,
    *more: Column,
) -> DataFrame:
    given = appeal if isinstance(appeal, Column) else F.lit(1.0)
    sized = docs.select(
        column(docs, id_column).alias("id"), column(docs, source_column).alias("source"),
        word_count(column(docs, text_column)).alias("size"),
        given.cast("double").alias("appeal"), *more,
    )
    if appeal is None or isinstance(appeal, Column):
        return sized
    return sized.withColumn("appeal", appeal(F.col("size")).cast("double"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    appeal: Appeal = None,
    seed: int = 20,
) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies.

    All columns stay; arguments are those of :func:`sample_copies`.  A row's copies follow
    from its id, size and source and the source's edges, so that no text is shuffled as
    long as there are not too many sources to broadcast, which Spark checks.
    """
    sized = materialize(_sized(docs, id_column, text_column, source_column, appeal), "sizes")
    current = _mixture(sized, weights, most, seed)
    row = F.struct(*[column(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    whole = _sized(docs, id_column, text_column, source_column, appeal, row.alias("row"))
    ranked = _ranks(whole.join(current, F.col("source").eqNullSafe(F.col("of"))), seed)
    return (
        ranked.select("row", _copies().alias("copies")).where("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("n"))
        .select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    )
