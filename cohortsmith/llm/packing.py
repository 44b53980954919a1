"""Packing texts into windows by non-negative least squares on the length histogram.

A text longer than the window is cut into whole windows and a tail.  Tails are then
only numbers of tokens: their histogram has fewer bins than the window, whatever
the input.  Combinations of two or three tails that fill a block exactly are
enumerated (blocks are the window and its halves down to ``SMALLEST_BLOCK``); repeat
counts come from non-negative least squares against the histogram, are rounded down,
and what is left of the histogram is packed greedily, largest first.  The plan is a
table of at most a few entries per bin, so it is small enough to send to every task;
each piece finds its place in it from its number among the pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortsmith.llm.tables import column
from cohortsmith.llm.tokens import encoder
from cohortsmith.session import materialize

WINDOW = 2048
SMALLEST_BLOCK = 256

# Third members of a triple lie on a grid, so that triples stay as few as pairs.
GRID = 16
STEPS = 400

# Pieces of one length that one task numbers.
PIECES_PER_RANGE = 5_000

# Characters a task tokenizes at a time.
BATCH_CHARS = 1_000_000


def combinations(histogram: np.ndarray, window: int) -> list[np.ndarray]:
    """Per block size an array of rows of lengths (0 for none) that fill it.

    Only lengths that occur are combined.
    """
    present = histogram > 0
    out = []
    block = window
    while block >= SMALLEST_BLOCK:
        lengths = np.flatnonzero(present[: block + 1])
        lengths = lengths[lengths > 0]
        low = lengths[lengths <= block // 2]
        pairs = np.stack([block - low, low, np.zeros_like(low)], axis=1)
        grid = lengths[lengths % GRID == 0]
        a, b = np.meshgrid(lengths, grid, indexing="ij")
        c = block - a - b
        triples = np.stack([a, b, c], axis=2)[(c > 0) & (c <= b) & (b <= a)]
        rows = np.concatenate([pairs, triples])
        rows = rows[present[rows].all(axis=1) | (
            present[rows[:, 0]] & present[rows[:, 1]] & (rows[:, 2] == 0)
        )]
        whole = np.array([[block, 0, 0]]) if present[block] else np.zeros((0, 3), int)
        out.append(np.concatenate([whole, rows]))
        block //= 2
    return out


def nonnegative_counts(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Least squares repeat counts of the combinations, all non-negative.

    Multiplicative steps keep counts non-negative and use that every combination
    touches at most three bins.
    """
    used = rows > 0
    bins = len(histogram)

    def covered(x):
        return np.bincount(rows[used], np.repeat(x, used.sum(axis=1)), bins)

    def pull(values):
        return np.where(used, values[rows], 0.0).sum(axis=1)

    target = pull(histogram.astype(float))
    share = np.bincount(rows[used], minlength=bins)
    x = np.where(used, histogram[rows] / np.maximum(share[rows], 1), np.inf).min(axis=1)
    x = np.maximum(x, 1e-9)
    for _ in range(STEPS):
        x *= target / np.maximum(pull(covered(x)), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[pd.DataFrame, int]:
    """Where the pieces of each length go.

    Rows ``length, first, pieces, sequence, every, offset, step``: the pieces of a
    length numbered from ``first`` on, ``pieces`` of them.  Piece ``i`` of an entry is
    the ``i``-th block of a run of equal blocks; blocks shorter than the window
    share a sequence, ``every`` blocks to one, ``step`` tokens apart.  Also returns
    the number of sequences.
    """
    histogram = histogram.astype(np.int64)
    left, entries, taken = histogram.copy(), [], np.zeros(len(histogram), np.int64)
    sequences = 0

    def place(lengths, blocks, start_block, block):
        """Give ``blocks`` equal blocks their pieces."""
        offset, per = 0, window // block
        for length in lengths:
            entries.append((
                length, taken[length], blocks, sequences, start_block, per, offset, block
            ))
            taken[length] += blocks
            offset += length

    groups = combinations(histogram, window)
    if sum(map(len, groups)):
        rows = np.concatenate(groups)
        sizes = np.repeat([window >> k for k in range(len(groups))], list(map(len, groups)))
        counts = np.floor(nonnegative_counts(rows, histogram) + 1e-6).astype(np.int64)
        for block in sorted(set(sizes.tolist()), reverse=True):
            filled = 0
            mine = np.flatnonzero((sizes == block) & (counts > 0))
            for k in mine[np.argsort(-counts[mine], kind="stable")]:
                lengths = rows[k][rows[k] > 0]
                kinds, need = np.unique(lengths, return_counts=True)
                n = int(min(counts[k], (left[kinds] // need).min()))
                if n > 0:
                    left[kinds] -= n * need
                    place(lengths.tolist(), n, filled, block)
                    filled += n
            sequences += math.ceil(filled * block / window)
    while left.any():
        room, lengths, have = window, [], left.copy()
        while room > 0 and (fits := np.flatnonzero(have[: room + 1])).size:
            length = int(fits[-1])
            n = int(min(have[length], room // length))
            lengths += [length] * n
            have[length] -= n
            room -= n * length
        kinds, need = np.unique(lengths, return_counts=True)
        n = int((left[kinds] // need).min())
        left[kinds] -= n * need
        place(lengths, n, 0, window)
        sequences += n
    frame = pd.DataFrame(
        entries,
        columns=["length", "first", "pieces", "sequence", "block", "every", "offset", "step"],
    )
    return frame.sort_values(["length", "first"], ignore_index=True), sequences


def _cut(tokenizer: str, end_id: int, window: int, with_ids: bool):
    """Arrow batches of rows to Arrow batches of pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column("text")
            chars = np.cumsum(pc.fill_null(
                pc.binary_length(texts), 0
            ).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(chars // BATCH_CHARS)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(texts)]):
                yield some(batch.slice(a, b - a), encode)

    def some(batch, encode):
        flat, ends = encode(batch.column("text"))
        rows, starts, lengths, sums, totals, ids = [], [], [], [], [], []
        begin = 0
        for row, end in enumerate(ends):
            tokens = np.append(flat[begin:end], np.uint32(end_id)).astype("<u4")
            begin = end
            for start in range(0, len(tokens), window):
                piece = tokens[start : start + window]
                rows.append(row)
                starts.append(start)
                lengths.append(len(piece))
                sums.append(zlib.crc32(piece.tobytes()))
                totals.append(len(tokens))
                if with_ids:
                    ids.append(piece.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(pa.array(rows, pa.int64())),
                pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()), pa.array(totals, pa.int64()),
                *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
            ],
            names=["id", "start", "length", "crc", "total", *(["ids"] if with_ids else [])],
        )

    return pieces


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of the texts and their places in sequences of up to ``window`` tokens.

    Returns per piece ``id_column``, ``start`` (tokens of its text before it),
    ``length``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers),
    ``doc_tokens`` (with the closing ``end_id``), ``sequence_id``, ``offset``, and the
    token ids themselves (``ids``) with ``with_ids``.  Every token lies in one piece,
    every sequence is filled from offset 0 without gaps.  NULL and empty texts are
    the closing id alone; rows with equal ids are packed as different texts.  An
    empty table gives an empty result.  The pieces are written to the shared folder
    first, without their ids unless asked for.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(
        column(docs, id_column).alias("id"), column(docs, text_column).alias("text")
    )
    fields = f"id {kind}, start long, length long, crc long, total long"
    pieces = materialize(
        rows.mapInArrow(
            _cut(tokenizer, end_id, window, with_ids),
            fields + (", ids array<int>" if with_ids else ""),
        ).withColumn("row", F.monotonically_increasing_id()),
        "pieces",
    )
    # At most one row per length up to the window.
    counted = pieces.groupBy("length").count().collect()
    histogram = np.zeros(window + 1, np.int64)
    for row in counted:
        histogram[row["length"]] = row["count"]
    entries, _ = plan(histogram, window)
    # Pieces of one length are numbered in ranges, so that no length is one task; the
    # written row number tells equal pieces apart.
    n_ranges = max(1, math.ceil(int(histogram.max()) / PIECES_PER_RANGE))
    ranged = pieces.withColumn(
        "range", F.pmod(F.xxhash64("id", "start", "crc", "row"), F.lit(n_ranges))
    )
    inside = Window.partitionBy("length", "range").orderBy(
        "id", "start", "crc", "row"
    )
    before = Window.partitionBy("length").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = ranged.groupBy("length", "range").count().select(
        "length", "range",
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"),
    )
    numbered = ranged.withColumn(
        "at", F.row_number().over(inside).cast("long") - 1
    ).join(shift, ["length", "range"]).withColumn("number", F.col("at") + F.col("shift"))
    # First entry number of a length; entries of a length are in order of ``first``.
    keys = entries["length"].to_numpy() * (1 << 40) + entries["first"].to_numpy()
    parts = {c: entries[c].to_numpy() for c in entries.columns}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            e = np.searchsorted(keys, length * (1 << 40) + number, side="right") - 1
            block = parts["block"][e] + number - parts["first"][e]
            every = parts["every"][e]
            out = [
                batch.column(c)
                for c in ["id", "start", "length", "crc", "total"]
            ] + [
                pa.array(parts["sequence"][e] + block // every),
                pa.array(parts["offset"][e] + block % every * parts["step"][e]),
            ] + ([batch.column("ids")] if with_ids else [])
            yield pa.RecordBatch.from_arrays(
                out,
                names=["id", "start", "length", "crc", "total", "sequence_id", "offset",
                       *(["ids"] if with_ids else [])],
            )

    placed = numbered.select(*pieces.drop("row").columns, "number").mapInArrow(
        places,
        f"{fields}, sequence_id long, offset long"
        + (", ids array<int>" if with_ids else ""),
    )
    return placed.select(
        F.col("id").alias(id_column), "start", "length",
        F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"),
        "sequence_id", "offset", *(["ids"] if with_ids else []),
    )
