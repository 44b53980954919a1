"""Exact duplicates with a Bloom filter in two passes.

Pass one counts filter slots: every text sets ``HASHES`` slots, and only slots
that were set twice stay.  They are kept as one BIGINT per 64 slots, which is broadcast.  Pass two reads the texts
again.  A text with a slot that was set once has no copy and passes straight
through; only the others, true copies and a few false positives, are shuffled by
their SHA-256 and counted.

The filter has about 16 slots per text, between two fixed sizes, so that its broadcast
is bounded.  With more texts than the larger size has room for it fills up, more texts
take the shuffle, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsmith.llm.tables import column
from cohortsmith.session import materialize

# Slots are numbers of so many bits at most and at least.  2**26 slots are at most 2**20
# rows of 16 bytes, 16 MB to broadcast; 2**30 are 256 MB.
SLOT_BITS = 30
LEAST_BITS = 26
SLOTS_PER_TEXT = 16
HASHES = 2


def slot_bits(n_texts: int) -> int:
    """Bits of a slot number for so many texts."""
    return min(max((n_texts * SLOTS_PER_TEXT).bit_length(), LEAST_BITS), SLOT_BITS)


def _slots(text: Column, bits: int) -> list[Column]:
    """Independent slots, cut out of 64-bit hashes with different seeds."""
    last = F.lit((1 << bits) - 1).cast("long")
    return [F.xxhash64(F.lit(k), text).bitwiseAND(last) for k in range(HASHES)]


def repeated_slots(texts: DataFrame, text: str, bits: int = LEAST_BITS) -> DataFrame:
    """Filter words ``(word, bits)`` of the slots that at least two rows set."""
    slots = texts.select(F.explode(F.array(*_slots(F.col(text), bits))).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.expr("int(slot & 63)"))
    return twice.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )


def _mark(docs: DataFrame, id_column: str, text_column: str, carried: Column):
    """``id, row, sha, keep_id, group_size, kept`` of every row."""
    texts = docs.select(
        column(docs, id_column).alias("id"),
        carried.alias("row"),
        F.coalesce(column(docs, text_column), F.lit("")).alias("text"),
    )
    bits = slot_bits(docs.count())
    bloom = materialize(repeated_slots(texts, "text", bits), "bloom")
    seen, passes = texts, F.lit(True)
    for k, slot in enumerate(_slots(F.col("text"), bits)):
        # At most 2**24 rows of 16 bytes whatever the input.
        words = F.broadcast(bloom.select(
            F.col("word").alias(f"word{k}"), F.col("bits").alias(f"bits{k}")
        ))
        seen = seen.withColumn(f"slot{k}", slot).join(
            words, F.shiftright(f"slot{k}", 6) == F.col(f"word{k}"), "left"
        )
        bit = F.expr(f"shiftrightunsigned(bits{k}, int(slot{k} & 63)) & 1")
        passes = passes & (F.coalesce(bit, F.lit(0).cast("long")) == 1)
    seen = seen.select(
        "id", "row", F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        passes.alias("maybe"),
    )
    alone = seen.where(~F.col("maybe")).select(
        "id", "row", "sha", F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
    )
    # The written number tells rows apart that are equal in text and id.
    maybe = materialize(
        seen.where("maybe").select(
            "id", "row", "sha", F.monotonically_increasing_id().alias("n")
        ),
        "copies",
    )
    groups = materialize(
        maybe.groupBy("sha").agg(
            F.max(F.struct("id", "n")).alias("keep"), F.count("*").alias("group_size")
        ),
        "groups",
    )
    # Copies on the left, groups from a table: adaptive execution splits a large group.
    together = maybe.join(groups, "sha", "left").select(
        "id", "row", "sha", F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("n") == F.col("keep.n")).alias("kept"),
    )
    return alone.unionByName(together)


def mark_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every row with its group of equal texts and whether it stays.

    Returns ``id_column``, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256``; other columns of ``docs`` do not matter, names like those
    added included.  NULL text counts as empty.  Of equal texts the row with the
    largest id stays; a NULL id is smaller than any other, and of rows that are
    equal in text and id exactly one stays.  An empty table gives an empty
    result.  Rows that may have copies are written to the shared folder first.
    """
    marked = _mark(docs, id_column, text_column, F.lit(None).cast("int"))
    return marked.select(
        F.col("id").alias(id_column), "keep_id", "group_size", "kept",
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` without the rows that :func:`mark_copies` drops, all columns kept."""
    fields = [column(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    kept = _mark(docs, id_column, text_column, F.struct(*fields)).where("kept")
    return kept.select(*[
        F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)
    ])
