"""Language identification by nearest centroid.

A text is the vector of its 1- to 3-character sequences of letters, counted into
``BUCKETS`` hash buckets, dampened, weighted by inverse document frequency and scaled
to length one.  Every language has several centroids from spherical k-means, and a
text gets the language of the centroid with the largest cosine.  A text farther from
it than nearly all of that centroid's own training texts is rejected.

Fitting uses a bounded sample, about ``SAMPLE`` texts of each language picked by a hash
of their id; prediction reads every whole text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsmith.llm.tables import column, uniform
from cohortsmith.session import materialize

BUCKETS = 4096
ORDERS = 3
SAMPLE = 500
CLUSTERS = 3
ROUNDS = 10
REJECT = 0.005  # share of a centroid's training texts that lie beyond its radius

# Texts and characters that a task turns into vectors at a time.
BATCH_ROWS = 256
BATCH_CHARS = 1_000_000

UNKNOWN = "und"


def in_sequences(char: str) -> bool:
    """Letters and the marks that combine with them; a mark alone is no letter."""
    return char.isalpha() or unicodedata.category(char).startswith("M")


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed character sequences, one row per text, and who has a letter.

    Everything that is no letter or combining mark becomes one space; sequences do not cross texts.
    """
    texts = [" " + t.replace("\x00", " ").lower() + " " for t in texts]
    codes = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, which = np.unique(codes, return_inverse=True)
    stays = np.array([in_sequences(chr(c)) for c in known], bool)
    alpha = np.array([chr(c).isalpha() for c in known], bool)[which]
    ends = known == 0
    has_letter = np.zeros(len(texts), bool)
    has_letter[np.cumsum(codes == 0)[alpha]] = True
    symbol = np.where(stays, known, np.where(ends, 0, 32))[which]
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 32) | (symbol[:-1] != 32)
    symbol = symbol[keep].astype(np.uint64)
    row = np.cumsum(symbol == 0)
    counts = np.zeros(len(texts) * BUCKETS)
    value, inside = np.zeros(len(symbol), np.uint64), np.ones(len(symbol), bool)
    for k in range(ORDERS):
        # The sequence of k + 1 symbols that ends here.
        shifted = np.concatenate([np.zeros(k, np.uint64), symbol])[: len(symbol)]
        value = value * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(1)
        inside &= shifted != 0
        use = inside & (symbol != 32) if k == 0 else inside
        bucket = (value[use] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)
        counts += np.bincount(row[use] * BUCKETS + bucket.astype(np.int64), minlength=len(counts))
    return counts.reshape(len(texts), BUCKETS), has_letter


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    centres: np.ndarray
    radii: np.ndarray  # smallest accepted cosine of each centroid
    idf: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text is too far from its centroid."""
        counts, has_letter = sequences(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = vectors(counts, self.idf) @ self.centres.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best, has_letter)]
        return names, np.where(has_letter, score, 0.0), ~has_letter | (score < self.radii[best])


def cluster(x: np.ndarray, k: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centres, and the cluster of each row.

    Starts with the row nearest to the mean, then always the row farthest from all
    centres so far; ties go to the first row.
    """
    centres = [x[int((x @ x.mean(axis=0)).argmax())]]
    while len(centres) < min(k, len(x)):
        centres.append(x[int((x @ np.array(centres).T).max(axis=1).argmin())])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        of = (x @ centres.T).argmax(axis=1)
        moved = np.array([
            _unit(x[of == c].sum(axis=0)) if (of == c).any() else centres[c]
            for c in range(len(centres))
        ])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres, (x @ centres.T).argmax(axis=1)


def fit(
    labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    language_column: str = "lang", sample: int = SAMPLE,
) -> Centroids:
    """Learn from rows with a text, a letter and a language; others are left out.

    A language with up to ``sample`` texts is used whole, of others about as many are drawn.  Vectors of the sample are
    written to the shared folder; each language is clustered in a task of its own.
    """
    rows = labelled.select(
        column(labelled, id_column).alias("id"),
        column(labelled, language_column).alias("lang"),
        column(labelled, text_column).alias("text"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    # One row per language; the fitted model itself is larger and goes to every task.
    # The text decides, too, so that rows without ids are drawn like others; a row that is
    # there again and again counts once.
    drawn = rows.join(F.broadcast(sizes), F.col("lang") == F.col("of")).where(
        uniform(11, F.col("id"), F.col("lang"), F.col("text")) * F.col("n") < sample
    ).groupBy("lang", F.xxhash64("id", "text").alias("order")).agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            counts, has_letter = sequences(batch.column("text").to_pylist())
            flat = pa.array(counts.ravel().astype(np.float32))
            offsets = pa.array(np.arange(0, len(flat) + 1, BUCKETS), pa.int32())
            out = pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("order"),
                 pa.ListArray.from_arrays(offsets, flat)],
                names=["lang", "order", "counts"],
            )
            yield out.filter(pa.array(has_letter))

    table = materialize(
        drawn.mapInArrow(counted, "lang string, order long, counts array<float>"), "sequences"
    )
    frequency = np.zeros(BUCKETS)
    for row in (
        table.select(F.posexplode("counts").alias("bucket", "n")).where("n > 0")
        .groupBy("bucket").count().collect()  # at most BUCKETS rows
    ):
        frequency[row["bucket"]] = row["count"]
    idf = np.log((1 + table.count()) / (1 + frequency)) + 1

    def centres(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order")
        x = vectors(np.stack(frame["counts"].to_numpy()).astype(float), idf)
        found, of = cluster(x)
        own = (x @ found.T)[np.arange(len(x)), of]
        return pd.DataFrame({
            "lang": frame["lang"].iloc[0],
            "number": np.arange(len(found)),
            "radius": [
                float(np.quantile(own[of == c], REJECT)) if (of == c).any() else 1.0
                for c in range(len(found))
            ],
            "centre": list(found),
        })

    found = (
        table.groupBy("lang")
        .applyInPandas(centres, "lang string, number int, radius double, centre array<double>")
        .orderBy("lang", "number").collect()  # CLUSTERS rows per language
    )
    return Centroids(
        [r["lang"] for r in found], np.array([r["centre"] for r in found]),
        np.array([r["radius"] for r in found]), idf,
    )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        through = np.cumsum(size.to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = through[start - 1] if start else 0
            end = int(np.searchsorted(through, base + BATCH_CHARS, side="right"))
            end = min(max(end, start + 1), start + BATCH_ROWS)
            yield batch.slice(start, end - start)
            start = end


def identify(
    docs: DataFrame, model: Centroids, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id_column, lang_pred, score, rejected`` of every row.

    ``lang_pred`` is the language of the nearest centroid also where the text is
    rejected, and ``und`` with score 0 if the text is NULL or has no letter, or nothing
    was learned.  An empty table gives an empty result.
    """
    rows = docs.select(
        column(docs, id_column).alias("id"), column(docs, text_column).alias("text")
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            names, score, rejected = model.predict(
                [t or "" for t in batch.column("text").to_pylist()]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(score),
                 pa.array(rejected)],
                names=["id", "lang_pred", "score", "rejected"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        each, f"id {kind}, lang_pred string, score double, rejected boolean"
    ).withColumnRenamed("id", id_column)
