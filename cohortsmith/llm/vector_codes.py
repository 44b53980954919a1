"""Short codes for vectors, all in integers.

A vector is cut into parts, and each part is replaced by the number of the nearest of
a few hundred entries that were learned for its position.  Distances are compared
after an integer Walsh-Hadamard transform of the zero-padded parts and entries: it
multiplies every squared distance by the padded length and moves most of it into the
few coefficients of low sequency (number of sign changes).  Squared differences are
added up in that order, and an entry is out as soon as its sum is beyond the full
distance of a good candidate.  Sums only grow, so the nearest entry is never lost, and
nothing is rounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsmith.llm.tables import column
from cohortsmith.session import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024

# Coefficients added at a time.
STEP = 4

# Entries are dealt with one by one once this share of them is left.
FEW = 0.2

# Vectors compared at a time.
CHUNK = 2048


def _sequency(width: int) -> np.ndarray:
    """Rows of the Hadamard matrix in the order of their sign changes."""
    matrix = np.ones((1, 1), np.int8)
    while len(matrix) < width:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return np.argsort((matrix[:, 1:] != matrix[:, :-1]).sum(axis=1))


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of integer rows, padded to a power of two, by sequency."""
    n, given = rows.shape
    width = 1
    while width < given:
        width *= 2
    out = np.zeros((n, width), rows.dtype)
    out[:, :given] = rows
    half = 1
    while half < width:
        pairs = out.reshape(n, width // (2 * half), 2, half)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
        half *= 2
    return out[:, _sequency(width)]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For transformed points the nearest transformed entry and the scaled distance.

    Ties go to the lower number.
    """
    width = points.shape[1]
    sums = np.zeros((len(points), len(entries)), points.dtype)
    limit = None
    for at in range(0, width, STEP):
        for k in range(at, min(at + STEP, width)):
            d = points[:, k, None] - entries[None, :, k]
            sums += d * d
        # The entry that is ahead gives a distance nothing farther has to be kept for.
        ahead = _squares(points, entries[sums.argmin(axis=1)])
        limit = ahead if limit is None else np.minimum(limit, ahead)
        stays = sums <= limit[:, None]
        if stays.sum() <= FEW * stays.size:
            break
    row, entry = np.nonzero(stays)
    left = sums[row, entry]
    for k in range(at + STEP, width, STEP):
        left = left + _squares(points[row, k : k + STEP], entries[entry, k : k + STEP])
        stay = left <= limit[row]
        row, entry, left = row[stay], entry[stay], left[stay]
    # At least the candidate of every point is left, entries in ascending order.
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    lowest = np.minimum.reduceat(left, starts)
    hits = np.flatnonzero(left == lowest[row])
    _, first = np.unique(row[hits], return_index=True)
    return entry[hits[first]], lowest


def integers(vectors: pa.Array, length: int) -> np.ndarray:
    """``floor(1024 x)`` as rows of ``length``; shorter vectors end in zeros.

    64-bit numbers if no distance can leave them, else Python's.
    """
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE)
    if np.abs(flat).max(initial=0) < _safe(length):
        flat = flat.astype(np.int64)
    else:
        flat = np.array([int(v) for v in flat], object)
    out = np.zeros((len(vectors), length), flat.dtype)
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _safe(length: int) -> int:
    """Integers below this keep scaled squared distances inside 64 bits."""
    return (1 << 30) // max(2 * length, 1)


@dataclass
class Codebooks:
    """Entries per part: ``entries[part]`` has a row of integers per entry."""

    entries: list[np.ndarray]
    length: int

    @property
    def width(self) -> int:
        return self.length // len(self.entries)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers and squared distances of integer rows, a column per part."""
        numbers = np.zeros((len(rows), len(self.entries)), np.int64)
        errors = np.zeros(numbers.shape, rows.dtype)
        for p, entries in enumerate(self.entries):
            known = transform(entries.astype(rows.dtype, copy=False))
            for a in range(0, len(rows), CHUNK):
                piece = rows[a : a + CHUNK, p * self.width : (p + 1) * self.width]
                coefficients = transform(piece)
                found, distance = nearest(coefficients, known)
                numbers[a : a + CHUNK, p] = found
                errors[a : a + CHUNK, p] = distance // coefficients.shape[1]
        return numbers, errors

    def sha256(self) -> str:
        flat = (str(int(v)) for part in self.entries for v in part.ravel())
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def _slices(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple]:
    for a in range(0, batch.num_rows, CHUNK):
        piece = batch.slice(a, CHUNK)
        rows = integers(piece.column("vector"), books.length)
        if rows.dtype != object and any(e.dtype == object for e in books.entries):
            rows = rows.astype(object)
        yield piece, rows


def _learned(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: parts go to their nearest entry, entries to the floor of the mean."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        totals = [np.zeros(e.shape, object) for e in books.entries]
        for batch in batches:
            for _, rows in _slices(batch, books):
                numbers, _ = books.encode(rows)
                for p in range(len(books.entries)):
                    piece = rows[:, p * books.width : (p + 1) * books.width]
                    order = np.argsort(numbers[:, p], kind="stable")
                    found, starts = np.unique(numbers[order, p], return_index=True)
                    totals[p][found] += np.add.reduceat(piece[order], starts, axis=0)
                    counts[p] += np.bincount(numbers[:, p], minlength=len(counts[p]))
        used = [(p, int(e)) for p, n in enumerate(counts) for e in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in used], pa.int32()),
                pa.array([e for _, e in used], pa.int32()),
                pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
                pa.array([[int(v) for v in totals[p][e]] for p, e in used],
                         pa.list_(pa.decimal128(38, 0))),
            ],
            names=["part", "entry", "n", "sums"],
        )

    partial = kept.select("vector").mapInArrow(
        sums, "part int, entry int, n long, sums array<decimal(38,0)>"
    )
    per_value = partial.select(
        "part", "entry", F.posexplode(F.concat(
            F.col("sums"), F.array(F.col("n").cast("decimal(38,0)"))
        )).alias("place", "value"),
    )
    found = per_value.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
    entries = [e.astype(object) for e in books.entries]
    # A codebook's own size: parts x entries x (width + 1) numbers.
    rows = {(r["part"], r["entry"], r["place"]): int(r["value"]) for r in found.collect()}
    for (part, entry, place), value in rows.items():
        if place < books.width:
            entries[part][entry, place] = value // rows[part, entry, books.width]
    return Codebooks(_compact(entries, books.length), books.length)


def _compact(entries: list[np.ndarray], length: int) -> list[np.ndarray]:
    most = max((abs(int(v)) for e in entries for v in e.ravel()), default=0)
    return [e.astype(np.int64 if most < _safe(length) else object) for e in entries]


def usable(vector: Column) -> Column:
    """Neither NULL nor holding NULL, NaN or infinite components."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def learn(
    kept: DataFrame, parts: int, entries: int, rounds: int
) -> Codebooks | None:
    """Codebooks of rows ``id, vector``; None without rows."""
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    length = -(-max(longest, 1) // parts) * parts
    # The first entries: at most ``entries`` vectors.
    first = integers(
        kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries)
        .select("vector").toArrow().column("vector").combine_chunks(),
        length,
    )
    width = length // parts
    start = [first[:, p * width : (p + 1) * width] for p in range(parts)]
    books = Codebooks(_compact([e.astype(object) for e in start], length), length)
    for _ in range(rounds):
        books = _learned(kept, books)
    return books


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """A code of ``parts`` entry numbers for every usable vector.

    Returns ``id_column``, ``code`` (two hex digits per part), ``error`` (squared distance
    to the entries), ``label_error`` (summed over equal labels, NULLs together) and
    ``codebooks_sha256`` (decimal integers by part, entry and place, comma-joined).

    Components x become ``floor(1024 x)``.  Rows whose vector is NULL or holds a NULL or a
    non-finite component are left out.  Codebooks start with the parts of the ``entries``
    smallest ids (NULL ids last, equal ids by vector) and are refined ``rounds`` times.
    Vectors shorter than the longest, or than a multiple of ``parts``, count as if they
    ended in zeros.  Repeated rows get equal codes.  An error beyond 64 bits, which takes
    components beyond ten million, is NULL and counts nothing.  An empty table gives an empty result.
    Only codebooks pass the driver: parts x entries x width integers, whatever the number
    of rows.  Rows with codes are written to the shared folder.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part: 1 to 256 entries")
    kept = vectors.select(
        column(vectors, id_column).alias("id"), column(vectors, label_column).alias("label"),
        column(vectors, vector_column).alias("vector"),
    ).where(usable(F.col("vector")))
    books = learn(kept, parts, entries, rounds)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    if books is None:
        coded, sha = kept.sparkSession.createDataFrame([], schema), None
    else:
        sha = books.sha256()

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece, rows in _slices(batch, books):
                    numbers, errors = books.encode(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("id"), piece.column("label"),
                            pa.array(["".join(f"{v:02x}" for v in r) for r in numbers.tolist()],
                                     pa.string()),
                            pa.array([int(v) if v < 1 << 63 else None
                                      for v in errors.sum(axis=1)], pa.int64()),
                        ],
                        names=["id", "label", "code", "error"],
                    )

        coded = materialize(kept.mapInArrow(codes, schema), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(
        F.try_sum("error").alias("label_error")
    )
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_column), "code", "error", "label_error",
        F.lit(sha).cast("string").alias("codebooks_sha256"),
    )
