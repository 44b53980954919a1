"""SimHash near-duplicates with the generalised pigeonhole principle.

Two fingerprints that differ in at most ``distance`` bits differ, in at least one of
``m`` groups of bits, in at most that group's threshold, as long as the thresholds
(-1 leaves a group out) add up to ``distance - m + 1``.  Correlated bits go into the
same group, so that the other groups stay selective; the number of groups and the
unequal thresholds come from a dynamic programme over estimated probes and candidates.

Fingerprints that occur more than once are one node.  Linking goes in two steps, so
that a large family of near copies is never compared pair by pair:

1. Of the fingerprints that agree in a group of bits, each is compared with the
   smallest.  What is close is linked, and linked fingerprints get one label.
2. Every fingerprint is looked up under all variants of its groups within the
   threshold.  In each bucket the most frequent label is known; its own members skip
   that part of the bucket, and pairs of one label are never needed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsmith.llm.components import components
from cohortsmith.llm.tables import column, unused
from cohortsmith.session import materialize

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42

# Relative costs for the choice of thresholds: a lookup row against a compared pair.
PROBE_COST = 15.0
PAIR_COST = 1.0
GROUPS = range(2, 6)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of all word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    last = min(shingle, len(words)) - 1
    hashes = [
        xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[last:])
    ]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], ">u8").view(np.uint8)
        counts += np.unpackbits(some.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_column: str, text_column: str, shingle: int = SHINGLE
) -> DataFrame:
    """``id, fp``: the fingerprint as a signed 64-bit number; NULL text as empty."""
    rows = docs.select(
        column(docs, id_column).alias("id"),
        column(docs, text_column).cast("binary").alias("text"),
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(
                [fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(each, f"id {kind}, fp long")


def bit_counts(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """How often two bits are set together, over all fingerprints, and their number."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64).astype(">u8").view(np.uint8)
            bits = np.unpackbits(fp.reshape(-1, 8), axis=1).astype(np.float32)
            sums += bits.T @ bits
            n += len(bits)
        index = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(index), pa.array(np.append(sums.ravel(), n))], names=["pair", "n"]
        )

    rows = (
        nodes.select("fp").mapInArrow(together, "pair long, n double")
        .groupBy("pair").agg(F.sum("n").alias("n")).collect()
    )
    flat = np.zeros(BITS * BITS + 1)
    for row in rows:
        flat[row["pair"]] = row["n"]
    return flat[:-1].reshape(BITS, BITS), int(flat[-1])


def group_bits(sums: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` groups of bit positions (0 is the highest), correlated bits together."""
    share = np.diag(sums) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    alike = np.abs(sums / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        pool = sorted(free)
        # The pair that is most alike starts a group; without one, the lowest bit.
        inner = alike[np.ix_(pool, pool)] - 10 * np.eye(len(pool))
        group = [pool[int(inner.max(axis=1).argmax())]]
        free.discard(group[0])
        while len(group) < size:
            rest = sorted(free)
            group.append(rest[int(alike[np.ix_(rest, group)].mean(axis=1).argmax())])
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def _within(share: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1, .. of these bits."""
    chances = np.zeros(most + 1)
    chances[0] = 1
    for q in 2 * share * (1 - share):
        chances[1:] = chances[1:] * (1 - q) + chances[:-1] * q
        chances[0] *= 1 - q
    return np.cumsum(chances)


@dataclass(frozen=True)
class Layout:
    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def choose_layout(sums: np.ndarray, n: int, distance: int = DISTANCE) -> Layout:
    """Groups and thresholds of the lowest estimated cost.

    For every number of groups a dynamic programme spends ``distance + 1`` units, of
    which a threshold ``t`` costs ``t + 1``.
    """
    share = np.diag(sums) / max(n, 1)
    best = None
    for m in GROUPS:
        groups = group_bits(sums, n, m)
        table = {0: (0.0, ())}
        for group in groups:
            chances = _within(share[group], distance)
            grown: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, distance - spent + 1):
                    more = 0.0
                    if t >= 0:
                        probes = sum(comb(len(group), k) for k in range(t + 1))
                        more = n * (probes + 1) * PROBE_COST + n * n * chances[t] * PAIR_COST
                    option = (cost + more, (*chosen, t))
                    units = spent + t + 1
                    if units not in grown or option < grown[units]:
                        grown[units] = option
            table = grown
        cost, thresholds = table[distance + 1]
        if best is None or cost < best.cost:
            best = Layout(tuple(map(tuple, groups)), thresholds, cost)
    return best


def _mask(bits: Sequence[int]) -> int:
    """The bits as a signed 64-bit number."""
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _used(layout: Layout) -> list[tuple[int, tuple[int, ...], int]]:
    return [
        (g, bits, t)
        for g, (bits, t) in enumerate(zip(layout.groups, layout.thresholds))
        if t >= 0
    ]


def _buckets(layout: Layout) -> Column:
    """``(group, value)`` of every used group."""
    return F.array(*[
        F.struct(
            F.lit(g).alias("group"), F.col("fp").bitwiseAND(_long(_mask(bits))).alias("value")
        )
        for g, bits, _ in _used(layout)
    ])


def _variants(layout: Layout) -> Column:
    """``(group, value)`` with up to the group's threshold of bits flipped."""

    def flipped(group: int, bits: Sequence[int], most: int) -> Column:
        flips = [_mask(c) for k in range(most + 1) for c in combinations(bits, k)]
        value = F.col("fp").bitwiseAND(_long(_mask(bits)))
        return F.transform(
            F.array(*[_long(f) for f in flips]),
            lambda f: F.struct(
                F.lit(group).alias("group"), value.bitwiseXOR(f).alias("value")
            ),
        )

    return F.flatten(F.array(*[flipped(*used) for used in _used(layout)]))


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link_fingerprints(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp, label`` of distinct fingerprints; equal labels are connected by links."""
    layout = choose_layout(*bit_counts(nodes), distance)
    exact = nodes.select("fp", F.explode(_buckets(layout)).alias("at")).select(
        "fp", "at.group", "at.value"
    )
    first = exact.groupBy("group", "value").agg(
        F.min("fp").alias("first"), F.count("*").alias("n")
    ).where("n > 1")
    near = exact.join(first, ["group", "value"]).where(
        (F.col("fp") != F.col("first")) & (_far("fp", "first") <= distance)
    )
    stars = components(near.select(F.col("fp").alias("u"), F.col("first").alias("v")))
    labelled = materialize(
        nodes.join(stars, F.col("fp") == F.col("node"), "left").select(
            "fp", F.coalesce("root", "fp").alias("label")
        ),
        "labels",
    )
    indexed = labelled.select("fp", "label", F.explode(_buckets(layout)).alias("at")).select(
        "fp", "label", "at.group", "at.value"
    )
    # The most frequent label of a bucket, if other fingerprints could meet it.
    main = (
        indexed.groupBy("group", "value", "label").agg(F.count("*").alias("n"))
        .groupBy("group", "value").agg(F.max(F.struct("n", "label")).alias("most"))
        .select("group", "value", F.col("most.label").alias("main"))
    )
    probes = labelled.select(
        F.col("fp").alias("from_fp"), F.col("label").alias("from_label"),
        F.explode(_variants(layout)).alias("at"),
    ).select("from_fp", "from_label", "at.group", "at.value")
    # A probe looks at the main part of a bucket only if its label is another one.
    probes = probes.join(main, ["group", "value"]).select(
        "from_fp", "from_label", "group", "value",
        F.explode(
            F.when(F.col("from_label") == F.col("main"), F.array(F.lit(False)))
            .otherwise(F.array(F.lit(True), F.lit(False)))
        ).alias("in_main"),
    )
    shelves = indexed.join(main, ["group", "value"]).select(
        "fp", "label", F.col("group").alias("own_group"), F.col("value").alias("own_value"),
        (F.col("label") == F.col("main")).alias("own_main"),
    )
    met = probes.join(
        shelves,
        (F.col("group") == F.col("own_group")) & (F.col("value") == F.col("own_value"))
        & (F.col("in_main") == F.col("own_main")) & (F.col("from_label") != F.col("label")) & (_far("from_fp", "fp") <= distance),
    )
    bridges = components(
        met.select(F.col("from_label").alias("u"), F.col("label").alias("v"))
    )
    return labelled.join(bridges, F.col("label") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "label").alias("label")
    )


def near_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    distance: int = DISTANCE,
    shingle: int = SHINGLE,
) -> DataFrame:
    """Every row's fingerprint and the smallest id it reaches by links.

    Returns ``id_column``, ``fingerprint`` (16 hex digits) and ``component_id``.  Rows
    link if their fingerprints differ in at most ``distance`` bits.  NULL and empty
    texts have fingerprint zero and link like any other; NULL ids are never the
    smallest unless a component has no other.  An empty table gives an empty result.
    Fingerprints and links are written to the shared folder.
    """
    marked = materialize(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    nodes = materialize(
        marked.groupBy("fp").agg(F.min("id").alias("low")), "nodes"
    )
    labels = link_fingerprints(nodes.select("fp"), distance)
    known = nodes.join(labels, "fp")
    lowest = known.groupBy("label").agg(F.min("low").alias("component_id"))
    of_fp = known.join(lowest, "label").select(F.col("fp").alias("key"), "component_id")
    return marked.join(of_fp, F.col("fp") == F.col("key")).select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    distance: int = DISTANCE,
) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows that share this id all stay, and so do rows of a component without ids.
    """
    found = near_copies(docs, id_column, text_column, distance)
    own = column(found, id_column)
    lesser = (own != F.col("component_id")) | (own.isNull() & F.col("component_id").isNotNull())
    name = unused(docs, "gone")
    # Written, so that Spark knows its size when it joins.
    gone = materialize(found.where(lesser).select(own.alias(name)).distinct(), "gone")
    return docs.join(gone, column(docs, id_column).eqNullSafe(gone[name]), "left_anti")
