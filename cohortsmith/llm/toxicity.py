"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models.  A later model sees
the probabilities of the earlier categories besides the words.  In training these
come from models that did not see the row (out of fold), so that a later model does
not learn to trust probabilities better than it will get.

The models are fitted on a bounded sample: at most ``SAMPLE`` labelled documents
with a category and as many without, in the order of a hash of their ids.  A side that
does not fit counts as much as all its labels do, so that probabilities keep to the
shares of the whole table at any size.  Everything else reads whole texts of all
documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsmith.llm.features import parts, presence
from cohortsmith.llm.tables import WORD, column

SAMPLE = 4_000
FEATURES = 400  # per category
SEEN_IN = 3  # documents of a category or outside that have a feature
FOLDS = 3
RIDGE = 1.0
STEPS = 12


@dataclass
class Link:
    """One category's model: words (positions in the chain's features) and links."""

    name: str
    words: np.ndarray
    weights: np.ndarray  # words, then earlier categories, then the constant

    def scores(self, row: np.ndarray, feature: np.ndarray, n: int, before: np.ndarray):
        lookup = np.zeros(int(self.words.max(initial=-1)) + 2)
        lookup[self.words] = self.weights[: len(self.words)]
        known = feature < len(lookup) - 1
        sums = np.bincount(row[known], lookup[feature[known]], n)
        rest = self.weights[len(self.words) :]
        return sums + before @ rest[:-1] + rest[-1]


@dataclass
class Chain:
    features: np.ndarray  # sorted hashes
    links: list[Link]

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """One row per text, one column per category in the chain's order."""
        row, feature = presence(texts, self.features)
        out = np.zeros((len(texts), 0))
        for link in self.links:
            p = _sigmoid(link.scores(row, feature, len(texts), _log_odds(out)))
            out = np.column_stack([out, p])
        return out


def _no_words(texts: pa.Array) -> pa.Array:
    return pc.invert(pc.match_substring_regex(pc.fill_null(texts, ""), WORD))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _log_odds(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; last comes the constant."""
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    rate = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    beta[-1] = np.log(rate / (1 - rate))
    for _ in range(STEPS):
        p = _sigmoid(x @ beta)
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        weighted = x * (weight * p * (1 - p) + 1e-9).astype(np.float32)[:, None]
        step = np.linalg.solve(weighted.T @ x + np.diag(ridge), gradient)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return beta


def _select(row, feature, y, n) -> np.ndarray:
    """Features whose share inside and outside the category differs the most."""
    inside = y[row] > 0
    names, counts = np.unique(feature, return_counts=True)
    hits, hit_counts = np.unique(feature[inside], return_counts=True)
    positive = np.zeros(len(names))
    positive[np.searchsorted(names, hits)] = hit_counts
    negative = counts - positive
    n1, n0 = max(y.sum(), 1), max(n - y.sum(), 1)
    rate = counts / n
    z = (positive / n1 - negative / n0) / np.sqrt(
        np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0)
    )
    z[np.maximum(positive, negative) < SEEN_IN] = 0
    best = np.lexsort((names, -np.abs(z)))[:FEATURES]
    return names[best[z[best] != 0]]


def _matrix(row, feature, words, before) -> np.ndarray:
    """Presence of ``words`` (sorted), log-odds of earlier categories, the constant."""
    n = len(before)
    x = np.zeros((n, len(words)), np.float32)
    if len(words):
        at = np.searchsorted(words, feature)
        at[at == len(words)] = 0
        hit = words[at] == feature
        x[row[hit], at[hit]] = 1
    return np.column_stack([x, _log_odds(before), np.ones(n)]).astype(np.float32)


def fit_chain(
    ids: np.ndarray, row: np.ndarray, feature: np.ndarray, labels: np.ndarray,
    names: Sequence[str], weight: np.ndarray | None = None,
) -> Chain:
    """Fit on ``labels`` (rows x categories); folds go by the ids' hash.

    ``weight``: how many labelled documents each row stands for, default 1.
    """
    n = len(labels)
    fold = ids % FOLDS
    weight = np.ones(n) if weight is None else weight * n / max(weight.sum(), 1e-12)
    chosen = [_select(row, feature, labels[:, k], n) for k in range(len(names))]
    features = np.unique(np.concatenate([*chosen, np.zeros(0, np.int64)])).astype(np.int64)
    use = np.isin(feature, features.astype(np.uint32))
    all_row, all_feature = row, feature
    row, feature = row[use], feature[use].astype(np.int64)
    links, before = [], np.zeros((n, 0))
    for k, name in enumerate(names):
        words = np.searchsorted(features, np.sort(chosen[k]))
        x = _matrix(row, feature, np.sort(chosen[k]), before)
        y = labels[:, k].astype(float)
        if not 0 < y.sum() < n:  # nothing to tell apart
            weights = np.zeros(x.shape[1])
            weights[-1] = 20.0 if n and y.all() else -20.0
            links.append(Link(name, words, weights))
            before = np.column_stack([before, np.full(n, float(n > 0 and y.all()))])
            continue
        links.append(Link(name, words, _fit_linear(x, y, weight)))
        if k + 1 < len(names):
            unseen = np.full(n, np.average(y, weights=weight))
            for f in range(FOLDS):
                held = fold == f
                if held.any() and 0 < y[~held].sum() < (~held).sum():
                    # Features, too, are chosen without the rows that are held out.
                    seen = ~held[all_row]
                    place = np.cumsum(~held) - 1
                    own = np.sort(_select(
                        place[all_row[seen]], all_feature[seen], labels[~held, k],
                        int((~held).sum()),
                    ))
                    x = _matrix(all_row, all_feature, own, before)
                    fitted = _fit_linear(x[~held], y[~held], weight[~held])
                    unseen[held] = _sigmoid(x[held] @ fitted)
            before = np.column_stack([before, unseen])
    return Chain(features, links)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    categories: Mapping[str, Column],
    id_column: str = "doc_id",
    text_column: str = "text",
    sample: int = SAMPLE,
) -> Chain:
    """Fit the chain on labelled documents.

    ``categories``: name to a true/false expression over ``labels``, in chain order.
    Label rows with NULL in the id or a category are left out; of several rows for one
    document the categories are joined by "or".  Of several texts with one id the first
    in the order of their bytes counts, so the sample never has more rows than ids.  Without labels of both kinds a
    category is constant.
    """
    n_marks = len(categories)
    marks = [c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]
    known = (
        labels.select(column(labels, id_column).alias("id"), *marks)
        .dropna()
        .groupBy("id")
        .agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(n_marks)])
        .withColumn("order", F.xxhash64("id"))
    )
    some = reduce(lambda a, b: a | b, [F.col(f"y{k}") == 1 for k in range(n_marks)])
    drawn = [
        known.where(side).orderBy("order", "id").limit(sample) for side in (some, ~some)
    ]
    sides = known.agg(F.count_if(some).alias("some"), F.count_if(~some).alias("none")).first()
    # Never more than twice the sample.
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]).withColumnRenamed("id", "key"))
    texts = docs.select(
        column(docs, id_column).alias("id"), column(docs, text_column).alias("text")
    ).join(chosen, F.col("id") == F.col("key")).groupBy(
        "key", "order", *[f"y{k}" for k in range(n_marks)]
    ).agg(F.min("text").alias("text"))  # one text per id, however often it is there

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                row, feature = presence(part.column("text"))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("order"),
                        *[part.column(f"y{k}") for k in range(n_marks)],
                        pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()),
                            pa.array(feature.astype(np.uint32).view(np.int32)),
                        ),
                    ],
                    names=["order", *[f"y{k}" for k in range(n_marks)], "features"],
                )

    fields = ", ".join(f"y{k} int" for k in range(n_marks))
    found = (
        texts.select("text", "order", *[f"y{k}" for k in range(n_marks)])
        .mapInArrow(rows, f"order long, {fields}, features array<int>")
        .toArrow()
        .sort_by("order")
        .combine_chunks()
    )
    lists = found.column("features").combine_chunks()
    feature = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    y = np.column_stack([
        found.column(f"y{k}").to_numpy() for k in range(n_marks)
    ]) if n_marks else np.zeros((found.num_rows, 0))
    # A drawn row stands for so many labels of its side.
    stands_for = [max(size / max(sample, 1), 1.0) for size in (sides["some"], sides["none"])]
    weight = np.where(y.any(axis=1), *stands_for)
    return fit_chain(
        found.column("order").to_numpy(), row, feature, y, list(categories), weight
    )


def classify(
    docs: DataFrame, chain: Chain, id_column: str = "doc_id", text_column: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``id_column``, the ``carry`` columns and one probability per category.

    NULL texts and texts without words have probability 0 in every category.  Rows
    are independent: repeated rows get the same result, an empty table an empty one.
    """
    names = [f"p_{link.name}" for link in chain.links]
    own = docs.select(
        column(docs, id_column).alias("id"), column(docs, text_column).alias("text"),
        F.struct(*[column(docs, c).alias(f"c{i}") for i, c in enumerate(carry)])
        .alias("row") if carry else F.lit(0).alias("row"),
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                texts = part.column("text")
                p = chain.probabilities(texts)
                has_words = ~_no_words(texts).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("row"),
                     *[pa.array(np.where(has_words, p[:, k], 0.0)) for k in range(len(names))]],
                    names=["id", "row", *[f"p{k}" for k in range(len(names))]],
                )

    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    fields = ", ".join(f"p{k} double" for k in range(len(names)))
    scored = own.mapInArrow(rows, f"id {kinds['id']}, row {kinds['row']}, {fields}")
    return scored.select(
        F.col("id").alias(id_column),
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)],
        *[F.col(f"p{k}").alias(name) for k, name in enumerate(names)],
    )


def reject(
    docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = 0.5,
    text_column: str = "text",
) -> DataFrame:
    """``docs`` without the rows whose probability reaches ``threshold``.

    All columns stay as they are, whatever their names.  Texts that are NULL or have
    no words stay.
    """
    at = [link.name for link in chain.links].index(category)
    text = docs.columns.index(text_column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.schema.names[text]
            for part in parts(batch, name):
                texts = part.column(text)
                low = chain.probabilities(texts)[:, at] < threshold
                yield part.filter(pc.or_(pa.array(low), _no_words(texts)))

    return docs.mapInArrow(kept, docs.schema)
