"""Ranked lexical search by presence masks.

Texts are reduced to the terms of the queries once.  Then every batch of documents
is matched against all queries of a block.  For one query each of its terms is a bit, and
the terms' lists of documents are OR-ed into one mask per document; documents with the
same mask form a group.  No document of a group can score more than the sum of what its
terms can give at most in this batch.  Groups are scored from the highest such maximum
down, and the query is finished with the batch once the next maximum is lower than the
score of the last document of its ranking so far.

Scores are integers throughout, but for the logarithm in a term's weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortsmith.llm.features import parts
from cohortsmith.llm.tables import column
from cohortsmith.llm.words import words
from cohortsmith.session import materialize

TOP = 20

# Constants of the score.
SATURATION = 12
LENGTH_SHARE = 25
SCALE = 1_000_000_000

# Distinct terms of the queries of a block; a query with more has a block of its own.
BLOCK_TERMS = 200_000

# Documents that are scored at a time, at least.
CHUNK = 64


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


def item_terms(items: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """``item, term, repeats``: the terms of every query; equal ids are one query."""
    kind = items.schema[item_column].dataType.simpleString()
    rows = items.select(
        column(items, item_column).alias("item"), column(items, text_column).alias("text")
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                found, ends = words(part.column("text"))
                owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item").take(pa.array(owner)), found.cast(pa.string())],
                    names=["item", "term"],
                )

    return rows.mapInArrow(each, f"item {kind}, term string").groupBy("item", "term").agg(
        F.count("*").alias("repeats")
    )


def postings(docs: DataFrame, id_column: str, text_column: str, terms: list[str]) -> DataFrame:
    """Per document ``id``, its length ``n`` in terms, and the known ones: ``term``, ``tf``."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(
        column(docs, id_column).alias("id"), column(docs, text_column).alias("text")
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(terms, pa.large_string())
        for batch in batches:
            for part in parts(batch, "text"):
                found, ends = words(part.column("text"))
                at = pc.index_in(found, value_set=vocabulary)
                known = pc.is_valid(at).to_numpy(zero_copy_only=False)
                n = np.diff(ends, prepend=0)
                owner = np.repeat(np.arange(len(ends)), n)[known]
                at = at.drop_null().to_numpy().astype(np.int64)
                pairs, tf = np.unique(owner << 32 | at, return_counts=True)
                offsets = pa.array(
                    np.searchsorted(pairs >> 32, np.arange(len(ends) + 1)), pa.int32()
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(
                            offsets, pa.array((pairs & 0xFFFFFFFF).astype(np.int32))
                        ),
                        pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
                    ],
                    names=["id", "n", "term", "tf"],
                )

    return rows.mapInArrow(each, f"id {kind}, n long, term array<int>, tf array<int>")


class Batch:
    """Some documents' postings, by document and by term."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = batch.column("id")
        n = batch.column("n").to_numpy()
        if n.max(initial=0) > (1 << 62) // (LENGTH_SHARE * max(n_docs, 1)):
            norm = np.array([LENGTH_SHARE * int(v) * n_docs // n_terms for v in n], np.int64)
        else:
            norm = LENGTH_SHARE * n * n_docs // n_terms
        self.m = 100 - LENGTH_SHARE + norm
        sizes = pc.list_value_length(batch.column("term")).to_numpy()
        self.starts = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.term = batch.column("term").flatten().to_numpy().astype(np.int64)
        tf = batch.column("tf").flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(n)), sizes)
        self.gain = SCALE * tf // (1000 * tf + SATURATION * self.m[doc])
        order = np.argsort(self.term, kind="stable")
        self.docs_by_term = doc[order]
        sorted_terms = self.term[order]
        self.begin = np.searchsorted(sorted_terms, np.arange(len(weights) + 1))
        most = np.zeros(len(weights), np.int64)
        np.maximum.at(most, self.term, self.gain)
        self.most = most * weights

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with one of the terms, and a row of 64-bit words per document."""
        bits = np.zeros((len(self.m), (len(terms) + 63) // 64), np.uint64)
        for k, term in enumerate(terms.tolist()):
            holders = self.docs_by_term[self.begin[term] : self.begin[term + 1]]
            bits[holders, k >> 6] |= np.uint64(1 << (k & 63))
        docs = np.flatnonzero(bits.any(axis=1))
        return docs, bits[docs]

    def scores(self, docs: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Exact scores; ``value`` is the query's weight of every term."""
        sizes = self.sizes[docs]
        through = np.cumsum(sizes)
        at = np.arange(through[-1]) + np.repeat(self.starts[docs] - through + sizes, sizes)
        sums = np.concatenate([[0], np.cumsum(value[self.term[at]] * self.gain[at])])
        return sums[through] - sums[through - sizes]


def _grouped(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks, and the documents' places in the order of their masks."""
    if masks.shape[1] == 1:
        flat = masks[:, 0]
    else:
        flat = np.ascontiguousarray(masks).view(f"V{8 * masks.shape[1]}")[:, 0]
    _, first, group = np.unique(flat, return_index=True, return_inverse=True)
    return masks[first], np.argsort(group, kind="stable"), np.bincount(group)


def best_of(
    batch: Batch, terms: np.ndarray, repeats: np.ndarray, weights: np.ndarray, top: int,
    best: list[tuple],
) -> list[tuple]:
    """The ranking ``best`` of one query, entries (-score, id is NULL, id), with a batch."""
    use = batch.begin[terms + 1] > batch.begin[terms]
    terms, repeats = terms[use], repeats[use]
    if not len(terms):
        return best
    docs, masks = batch.masks(terms)
    distinct, order, sizes = _grouped(masks)
    bits = np.unpackbits(
        distinct.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=len(terms)
    )
    bounds = bits.astype(np.int64) @ (repeats * batch.most[terms])
    docs, ends = docs[order], np.cumsum(sizes)
    value = np.zeros(len(weights), np.int64)
    value[terms] = repeats * weights[terms]
    falling = np.argsort(-bounds, kind="stable")
    at = 0
    while at < len(falling):
        if bounds[falling[at]] <= 0 or (
            len(best) == top and bounds[falling[at]] < -best[-1][0]
        ):
            break
        chosen = []
        found = 0
        while at < len(falling) and found < CHUNK:
            group = falling[at]
            chosen.append(docs[ends[group] - sizes[group] : ends[group]])
            found += sizes[group]
            at += 1
        chosen = np.concatenate(chosen)
        scores = batch.scores(chosen, value)
        least = -best[-1][0] if len(best) == top else 1
        likely = scores >= max(least, 1)
        if likely.sum() > top:
            likely &= scores >= np.partition(scores[likely], -top)[-top]
        chosen, scores = chosen[likely], scores[likely]
        ids = batch.ids.take(pa.array(chosen)).to_pylist()
        best = sorted(
            [*best, *((-int(s), i is None, i) for s, i in zip(scores, ids))],
            key=lambda entry: (entry[0], entry[1], 0 if entry[1] else entry[2]),
        )[:top]
    return best


def rank(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``top`` documents of every query by score: ``item_column, rank, id_column, score``.

    A term is a run of letters and digits, A to Z lowered.  With N documents that have a
    term, L terms in them, n terms in one document and df documents that hold a term, a
    term weighs ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, a document's length counts as
    ``m = 75 + 25 n N div L``, and the score sums
    ``w * ((10^9 tf) div (1000 tf + 12 m))`` over the query's terms, repeats included.
    Documents with a score above 0 are ranked from 1, equal scores by ascending id.

    NULL texts have no terms.  Query rows of one id are one query with all their terms.
    Rows of documents that are equal in id are documents of their own; NULL ids come last
    among equal scores.  Queries without a match, and empty tables on either side, give no
    rows.  Queries are worked off in blocks of about ``BLOCK_TERMS`` distinct terms, which
    go to every task; each block reads the texts once and writes its postings to the
    shared folder.  Every task sends ``top`` rows per query at most.
    """
    wanted = materialize(item_terms(items, item_column, item_text), "queries")
    n_blocks = max(1, math.ceil(wanted.select("term").distinct().count() / BLOCK_TERMS))
    block_of = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    ranked = None
    for block in range(n_blocks):
        mine = wanted.where(block_of == block)
        some = _rank_block(docs, mine, top, id_column, text_column)
        ranked = some if ranked is None else ranked.unionByName(some)
    return ranked.select(
        F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score"
    )


def _rank_block(docs, wanted, top, id_column, text_column) -> DataFrame:
    spark = docs.sparkSession
    own = wanted.orderBy("item", "term").collect()  # the terms of one block
    terms = sorted({r["term"] for r in own})
    number = {term: k for k, term in enumerate(terms)}
    known = materialize(postings(docs, id_column, text_column, terms), "postings")
    totals = known.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = totals[0], totals[1] or 0
    frequency = np.zeros(len(terms), np.int64)
    counted = known.select(F.explode("term").alias("term")).groupBy("term").count()
    for row in counted.collect():  # one row per term of the block at most
        frequency[row["term"]] = row["count"]
    weights = np.array([weight(n_docs, int(f)) for f in frequency], np.int64)
    queries: list[tuple] = []
    for r in own:
        if not queries or queries[-1][0] != r["item"]:
            queries.append((r["item"], [], []))
        queries[-1][1].append(number[r["term"]])
        queries[-1][2].append(r["repeats"])
    queries = [(i, np.array(t), np.array(k, np.int64)) for i, t, k in queries]
    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    schema = f"query int, id {kinds['id']}, score long"
    id_type = known.limit(0).select("id").toArrow().schema.field("id").type

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            some = Batch(batch, weights, n_docs, max(n_terms, 1))
            for k, (_, its_terms, repeats) in enumerate(queries):
                best[k] = best_of(some, its_terms, repeats, weights, top, best[k])
        flat = [(k, -score, i) for k, found in enumerate(best) for score, _, i in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in flat], pa.int32()),
                pa.array([f[2] for f in flat], id_type),
                pa.array([f[1] for f in flat], pa.int64()),
            ],
            names=["query", "id", "score"],
        )

    found = known.mapInArrow(each, schema)
    # Tasks' rankings are merged in two steps, so that no query meets all of them at once.
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    first = Window.partitionBy("query", "salt").orderBy(*order)
    last = Window.partitionBy("query").orderBy(*order)
    merged = (
        salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
    )
    names = spark.createDataFrame(
        [(k, item) for k, (item, _, _) in enumerate(queries)],
        f"number int, item {wanted.schema['item'].dataType.simpleString()}",
    )
    return merged.join(names, F.col("query") == F.col("number")).select(
        "item", "rank", "id", "score"
    )
