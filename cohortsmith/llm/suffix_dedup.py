"""Removing byte strings that an earlier document has, with merged suffix orders.

1. Every window of ``length`` bytes has an anchor: the smallest hash among its
   ``GRAM``-byte grams.  Equal windows have equal anchors.  Anchors of all documents
   are exchanged as packed arrays, and an anchor seen in one document only ends there.
   Equal texts count as one: whatever a later copy has, the first one has.
2. Runs of windows with the same anchor are cut out as segments.  Equal segments become
   one, with the smallest id that has it.  All segments of an anchor meet in one bucket.
3. In a bucket the segments are dealt into shards; each shard gets its Burrows-Wheeler
   transform, and the transforms are merged by interleave refinement, whose rounds yield
   the intervals of suffixes that share ``length`` bytes (``bwt.merge``).  The smallest id
   of an interval decides for all its windows.
4. Windows an earlier document has are removed from the documents.

An anchor with very many different segments (a passage in a large part of the
documents, each with another text around it) would be too much for one bucket; its
windows are grouped by Spark one by one instead, with partial minima.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsmith.llm.bwt import merge
from cohortsmith.llm.tables import column
from cohortsmith.session import fresh_path, materialize, scratch, shuffles_dropped

LENGTH = 50
GRAM = 24

SLICE_BYTES = 1 << 20
ANCHORS_PER_RANGE = 2_000_000
# Anchors that go out together: so many for each range, or as many as a task holds.
ANCHORS_PER_ROW = 4_096
ANCHORS_AT_ONCE = 1 << 19
SEGMENTS_PER_BUCKET = 20_000

# Texts and settled anchors a task remembers; groups that copies of one text are dealt to.
SEEN = 1 << 20
SALTS = 256

NO_ID = (1 << 63) - 1  # NULL ids come after all others


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``size`` bytes from every position on."""
    base = np.uint64(0x9E3779B97F4A7C15)
    have, value, power = 1, data.astype(np.uint64) + np.uint64(1), base
    total = None
    done = 0
    while True:
        if size & have:
            if total is None:
                total = value
            else:
                # The new part goes in front: hash(front) * base**done + hash(rest).
                n = len(value) - done
                total = value[:n] * np.power(base, done) + total[have : have + n]
            done += have
        if done == size:
            break
        value = value[:-have] * power + value[have:]
        power = np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
        have *= 2
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(32))


def window_minima(x: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = size - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs(texts: list[bytes], length: int, gram: int):
    """Runs of windows with one anchor: text number, first window, windows, anchor.

    Positions count from the beginning of the text.  The anchor is a 58-bit number.
    """
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    span = length - gram + 1
    place = np.arange(len(data) - gram + 1)
    # Low bits tell which of the grams in a window is the anchor.
    low = np.uint64(63)
    keyed = (grams(data, gram) & ~low) | (place.astype(np.uint64) & low)
    least = window_minima(keyed, span)
    # Windows that reach beyond the end of their text; some lie between any two texts.
    beyond = (ends[:, None] - np.arange(1, length)).ravel()
    inside = np.ones(len(least), bool)
    inside[beyond[(beyond >= 0) & (beyond < len(least))]] = False
    # Equal numbers of neighbours are one anchor at one place.
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = np.append(np.flatnonzero(new | ~inside), len(least))
    last = stop[np.searchsorted(stop, first, side="right")]
    text = np.searchsorted(ends, first, side="right")
    begin = ends[text] - np.array([len(t) for t in texts], np.int64)[text]
    return text, first - begin, last - first, (least[first] >> np.uint64(6)).astype(np.int64)


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    through = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(through // SLICE_BYTES)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").to_pylist()]


def _address(anchor: np.ndarray, n_ranges: int) -> np.ndarray:
    """Range (upper half) and 32 further bits of an anchor in one number."""
    mixed = anchor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    where = (mixed >> np.uint64(32)) % np.uint64(n_ranges)
    return where << np.uint64(32) | (mixed & np.uint64(0xFFFFFFFF))


class _Seen:
    """Numbers a task has met; the oldest go when there are many, which costs time only."""

    def __init__(self, most: int):
        self.most = most
        self.young = self.old = np.zeros(0, np.int64)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        found = np.zeros(len(numbers), bool)
        for known in (self.young, self.old):
            if len(known):
                at = np.searchsorted(known, numbers)
                found |= known[np.minimum(at, len(known) - 1)] == numbers
        return found

    def add(self, numbers: np.ndarray) -> None:
        """Numbers the task has not met; two sorted runs are merged."""
        self.young = np.sort(np.concatenate([self.young, np.unique(numbers)]), kind="stable")
        if len(self.young) > self.most:
            self.old, self.young = self.young, np.zeros(0, np.int64)


def _planes(full: np.ndarray) -> bytes:
    """64-bit numbers, lower halves first: upper halves repeat and pack well."""
    return full.astype("<u8").view("<u4").reshape(-1, 2).T.tobytes()


def _unplaned(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, "<u4").reshape(2, -1).T).view("<u8")[:, 0]


def _halves(full: np.ndarray) -> bytes:
    return full.astype("<u4").tobytes()


def _unhalved(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")


ENTRIES = "group long, keys binary, counts binary, anchors binary"


def _by_group(group, keys, full, pack) -> pa.RecordBatch:
    """One row per group: its keys, how many anchors of each follow, the anchors."""
    order = np.lexsort((full, keys))
    # Small numbers are sorted by counting.
    small = group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group
    order = order[np.argsort(small[order], kind="stable")]
    group, keys, full = group[order], keys[order], full[order]
    heads = np.flatnonzero(
        np.append(True, (group[1:] != group[:-1]) | (keys[1:] != keys[:-1]))[: len(group)]
    )
    counts = np.diff(np.append(heads, len(group)))
    of = group[heads]
    cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    ends = np.append(cuts[1:], len(of))
    starts = np.append(heads, len(group))
    rows = [(a, b, starts[a], starts[b]) for a, b in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(of[cuts].astype(np.int64)),
            pa.array([keys[heads[a:b]].astype("<i8").tobytes() for a, b, _, _ in rows], pa.binary()),
            pa.array([counts[a:b].astype("<u4").tobytes() for a, b, _, _ in rows], pa.binary()),
            pa.array([pack(full[lo:hi]) for _, _, lo, hi in rows], pa.binary()),
        ],
        names=["group", "keys", "counts", "anchors"],
    )


def _once(full: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of anchor and key once, by anchor and key."""
    order = np.lexsort((keys, full))
    full, keys = full[order], keys[order]
    fresh = np.append(True, (full[1:] != full[:-1]) | (keys[1:] != keys[:-1]))[: len(keys)]
    return full[fresh], keys[fresh]


def _entries(rows: pa.Table, unpack) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and keys of ``_by_group``, see ``_once``."""

    def numbers(name, read, kind):
        return np.concatenate([np.zeros(0, kind), *map(read, rows.column(name).to_pylist())])

    keys = numbers("keys", lambda b: np.frombuffer(b, "<i8"), "<i8")
    counts = numbers("counts", lambda b: np.frombuffer(b, "<u4"), "<u4")
    kind = "<u8" if unpack is _unplaned else "<u4"
    return _once(numbers("anchors", unpack, kind), np.repeat(keys, counts))


def asked_anchors(keyed: DataFrame, length: int, n_ranges: int) -> DataFrame:
    """Anchors of texts as rows of ``_by_group``, by range or, if settled, by text.

    An anchor that a task has met in two texts is settled there: one text asks for the
    sake of other tasks, and all later ones of the task are answered by text without
    meeting at the anchor.  A text asks once per task.  So what meets at a frequent
    anchor grows with the tasks and not with the documents that have it.

    Anchors of many slices go out in one row per range, so that rows stay long when
    there are more ranges.
    """
    enough = min(n_ranges * ANCHORS_PER_ROW, ANCHORS_AT_ONCE)

    def sent(waiting, pack) -> pa.RecordBatch:
        return _by_group(*map(np.concatenate, zip(*waiting)), pack)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, settled = _Seen(SEEN), _Seen(SEEN)
        # Copies of one text are answered in up to SALTS groups.
        salt = TaskContext.get().partitionId() % SALTS
        open_, answered, n = [], [], 0
        for batch in batches:
            for part in _slices(batch, "text"):
                names, at = np.unique(part.column("key").to_numpy(), return_index=True)
                new = ~asked.has(names)
                names, at = names[new], at[new]
                asked.add(names)
                text, _, _, anchor = runs(_texts(part.take(pa.array(at))), length, GRAM)
                full, keys = _once(_address(anchor, n_ranges), names[text])
                same = np.zeros(len(full), bool)
                same[1:] = full[1:] == full[:-1]
                several = same.copy()
                several[:-1] |= same[1:]
                before = settled.has(full.view(np.int64))
                settled.add(full[same & ~before].view(np.int64))
                known = several | before
                goes = ~before & ~same
                open_.append(
                    ((full[goes] >> np.uint64(32)).astype(np.int64), keys[goes], full[goes])
                )
                group = n_ranges + (keys[known] + salt) % n_ranges
                answered.append((group, keys[known], full[known]))
                n += len(full)
                if n >= enough:
                    yield sent(open_, _halves)
                    yield sent(answered, _planes)
                    open_, answered, n = [], [], 0
        if n:
            yield sent(open_, _halves)
            yield sent(answered, _planes)

    return keyed.select("key", "text").mapInArrow(ask, ENTRIES)


def repeated_anchors(keyed: DataFrame, length: int, n_ranges: int) -> DataFrame:
    """``key, found``: per text the anchors that other texts have, too.

    Found anchors are 64-bit numbers of range and hash.  A few may be there by chance;
    the comparison of bytes that follows sorts them out.
    """

    def answer(rows: pa.Table) -> pa.Table:
        group = rows.column("group")[0].as_py()
        if group >= n_ranges:
            full, keys = _entries(rows, _unplaned)
        else:
            bits, keys = _entries(rows, _unhalved)
            # An anchor counts if its run of entries has more than one text.
            same = bits[1:] == bits[:-1]
            twin = np.append(False, same)[: len(bits)] | np.append(same, False)[: len(bits)]
            keys = keys[twin]
            full = bits[twin].astype("<u8") | np.uint64(group << 32)
        return pa.Table.from_batches([_by_group(keys % n_ranges, keys, full, _planes)])

    def per_text(rows: pa.Table) -> pa.Table:
        full, keys = _entries(rows, _unplaned)
        order = np.argsort(keys, kind="stable")
        keys, full = keys[order], full[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return pa.table({
            "key": pa.array(keys[heads], pa.int64()),
            "found": pa.array([_planes(x) for x in np.split(full, heads[1:])][: len(heads)],
                              pa.binary()),
        })

    return (
        asked_anchors(keyed, length, n_ranges)
        .groupBy("group").applyInArrow(answer, ENTRIES)
        .groupBy("group").applyInArrow(per_text, "key long, found binary")
    )


def segments(flagged: DataFrame, length: int, n_ranges: int) -> DataFrame:
    """``anchor, segment, key, id, start``: the runs whose anchors are repeated."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                texts = _texts(part)
                text, start, windows, anchor = runs(texts, length, GRAM)
                full = _address(anchor, n_ranges)
                keep = np.zeros(len(full), bool)
                edges = np.searchsorted(text, np.arange(len(texts) + 1))
                for t, found in enumerate(part.column("found").to_pylist()):
                    a, b = edges[t], edges[t + 1]
                    keep[a:b] = np.isin(full[a:b], _unplaned(found))
                text, start = text[keep], start[keep]
                size = windows[keep] + length - 1
                data = np.frombuffer(b"".join(texts), np.uint8)
                begin = np.cumsum([0, *[len(t) for t in texts]])[text] + start
                through = np.cumsum(size)
                total = int(through[-1]) if len(through) else 0
                at = np.repeat(begin - (through - size), size) + np.arange(total)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[keep]),
                        pa.Array.from_buffers(
                            pa.binary(), len(size),
                            [None, pa.py_buffer(np.append(0, through).astype(np.int32)),
                             pa.py_buffer(data[at])],
                        ),
                        part.column("key").take(pa.array(text)),
                        part.column("id").take(pa.array(text)),
                        pa.array(start),
                    ],
                    names=["anchor", "segment", "key", "id", "start"],
                )

    return flagged.select("key", "id", "text", "found").mapInArrow(
        cut, "anchor long, segment binary, key long, id long, start long"
    )


def marks_in_buckets(distinct: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """``anchor, name, low, windows, mask``: see ``marks``; all of an anchor in one task."""

    def resolve(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("anchor")
        segment = bucket.column("segment").combine_chunks()
        anchor = bucket.column("anchor").to_numpy()
        low = bucket.column("low").to_numpy()
        mask = np.zeros(len(low), np.int64)
        # Segments of different anchors share no window: only an anchor with several
        # segments has something to merge.
        heads = np.flatnonzero(np.append(True, np.diff(anchor) != 0))[: len(anchor)]
        crowd = np.diff(np.append(heads, len(anchor)))
        mine = np.flatnonzero(np.repeat(crowd, crowd) > 1)
        if len(mine):
            owner, position, interval = merge(segment.take(pa.array(mine)).to_pylist(), length)
            owner = mine[owner]
            first = np.flatnonzero(np.append(True, np.diff(interval) != 0))
            earlier = np.minimum.reduceat(low[owner], first)[interval] < low[owner]
            np.add.at(mask, owner[earlier], np.left_shift(1, position[earlier]))
        kept = pa.array(np.flatnonzero((mask != 0) | bucket.column("shared").to_numpy()))
        windows = pc.subtract(pc.binary_length(segment.take(kept)), length - 1)
        return pa.table({
            "anchor": bucket.column("anchor").take(kept),
            "name": bucket.column("name").take(kept),
            "low": bucket.column("low").take(kept),
            "windows": windows.cast(pa.int32()), "mask": pa.array(mask).take(kept),
        })

    return (
        distinct.select(
            "anchor", "segment", "low", "shared", F.xxhash64("segment").alias("name"),
            F.pmod(F.xxhash64("anchor"), F.lit(n_buckets)).alias("bucket"),
        )
        .groupBy("bucket")
        .applyInArrow(resolve, "anchor long, name long, low long, windows int, mask long")
    )


def marks_by_window(distinct: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many segments: one row per window."""
    named = distinct.withColumn("name", F.xxhash64("segment")).withColumn(
        "windows", F.length("segment") - F.lit(length) + 1
    )
    windows = named.select(
        "anchor", "segment", "name", "low",
        F.explode(F.sequence(F.lit(1), "windows")).alias("at"),
    )
    windows = windows.withColumn(
        "window", F.sha2(F.substring(F.col("segment"), F.col("at"), F.lit(length)), 256)
    ).drop("segment")
    least = windows.groupBy("window").agg(F.min("low").alias("least"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") - 1)
    masks = windows.join(least, "window").where("least < low").groupBy("anchor", "name").agg(
        F.bit_or(bit).alias("mask")
    )
    none = F.lit(0).cast("long")
    return named.join(masks, ["anchor", "name"], "left").where(
        "shared OR mask IS NOT NULL"
    ).select("anchor", "name", "low", "windows", F.coalesce("mask", none).alias("mask"))


def _table(df: DataFrame, path: str) -> DataFrame:
    """Like ``materialize``, packed tighter: segments of a text overlap."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marks(cut: DataFrame, length: int, per_bucket: int, path: str) -> DataFrame:
    """``anchor, name, low, windows, mask`` of the segments that have windows to remove.

    ``low`` is the smallest id that has the segment: whoever has it and a larger id loses
    all ``windows``, the others those of the ``mask``, which an id below ``low`` has.
    Segments that one document has and no earlier window are left out.
    """
    spark = cut.sparkSession
    with scratch(spark):
        distinct = _table(
            cut.groupBy("anchor", "segment").agg(
                F.min("id").alias("low"), (F.count("*") > 1).alias("shared")
            ),
            fresh_path(spark, "distinct"),
        )
        busy = _table(
            distinct.groupBy("anchor").agg(F.count("*").alias("n"))
            .where(F.col("n") > per_bucket).select("anchor"),
            fresh_path(spark, "busy"),
        )
        n_buckets = max(1, math.ceil(distinct.count() / per_bucket))
        return _table(
            marks_in_buckets(
                distinct.join(busy, "anchor", "left_anti"), length, n_buckets
            ).unionByName(
                marks_by_window(distinct.join(busy, "anchor", "left_semi"), length)
            ),
            path,
        )


def repeated_windows(
    docs: DataFrame, lows: DataFrame, length: int, per_bucket: int = SEGMENTS_PER_BUCKET
) -> DataFrame:
    """``key, start, mask``: windows of documents that a document with a smaller id has.

    A set bit ``i`` of the mask is the window at ``start + i``.  ``docs``: ``key`` (of
    the text), ``id`` (NULL replaced by ``NO_ID``) and binary ``text``; ``lows``: the
    smallest id (``low``) of each text.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    per_anchor = (length - GRAM + 2) / 2
    n_ranges = max(1, math.ceil(total / per_anchor / ANCHORS_PER_RANGE))
    cut_path, marks_path = fresh_path(spark, "segments"), fresh_path(spark, "marks")
    with scratch(spark):
        found = _table(repeated_anchors(docs, length, n_ranges), fresh_path(spark, "found"))
        # Of equal texts only the one with the smallest id goes on.
        first = found.join(lows, "key").withColumnsRenamed({"key": "of", "low": "of_id"})
        flagged = docs.join(
            first, (F.col("key") == F.col("of")) & (F.col("id") == F.col("of_id"))
        )
        cut = _table(segments(flagged, length, n_ranges), cut_path)
    marked = marks(cut, length, per_bucket, marks_path)
    whole = F.call_function(
        "shiftrightunsigned", F.lit(-1).cast("long"), F.lit(64) - F.col("windows")
    )
    return (
        cut.select("anchor", F.xxhash64("segment").alias("name"), "key", "id", "start")
        .join(marked, ["anchor", "name"])
        .select("key", "start", F.when(F.col("id") > F.col("low"), whole)
                .otherwise(F.col("mask")).alias("mask"))
        .where("mask <> 0")
    )


def text_keys(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with ``key``, a number that no two texts share, and ``key, low``.

    Keys are cut out of the texts' SHA-256 (``sha``).  Where different texts meet in one
    key, which takes some billions of texts, all but one of them get unused numbers.
    """
    keyed = keyed.withColumn("key", short_key(F.col("sha")))
    lows = materialize(
        keyed.groupBy("key").agg(
            F.min("id").alias("low"), F.min("sha").alias("least"), F.max("sha").alias("most")
        ),
        "lows",
    )
    # About n^2 / 2^65 keys of n texts.
    shared = lows.where("least <> most").select(F.col("key").alias("of"), "least")
    if not shared.limit(1).count():
        return keyed.drop("sha"), lows.select("key", "low")
    others = materialize(
        keyed.join(F.broadcast(shared), (F.col("key") == F.col("of")) & (F.col("sha") != F.col("least")))
        .select(F.col("sha").alias("other")).distinct()
        .withColumn("new_key", F.monotonically_increasing_id()),
        "others",
    )
    # Numbers above all keys, or below them, or anywhere between: the first free run.
    n = others.agg(F.max("new_key")).first()[0] + 1
    used = lows.agg(F.min("key"), F.max("key")).first()
    start = used[1] + 1 if used[1] + n < NO_ID else used[0] - n
    keyed = keyed.join(F.broadcast(others), F.col("sha") == F.col("other"), "left").withColumn(
        "key", F.coalesce(F.col("new_key") + F.lit(start), "key")
    ).drop("sha", "other", "new_key")
    return keyed, materialize(keyed.groupBy("key").agg(F.min("id").alias("low")), "lows")


def short_key(sha: Column) -> Column:
    # One bit less than there is room for, so that there are always unused numbers.
    return F.shiftright(F.xxhash64(sha), 1)


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    per_bucket: int = SEGMENTS_PER_BUCKET,
) -> DataFrame:
    """Every document without the bytes an earlier document has.

    A byte goes if it is covered by a string of ``length`` bytes that also starts in a
    document with a smaller id; strings are judged on the input.  Returns
    ``id_column``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept_text`` (the remaining bytes).  Ids are whole numbers.  NULL text is empty;
    a NULL id comes after all others; rows with equal ids do not take from each other;
    an empty table gives an empty result.
    """
    keyed = docs.select(
        column(docs, id_column).alias("own_id"),
        F.coalesce(column(docs, id_column).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(column(docs, text_column), F.lit("")).cast("binary").alias("text"),
    ).withColumn("sha", F.unhex(F.sha2("text", 256)))
    spark = docs.sparkSession
    cover_path = fresh_path(spark, "cover")
    # Tables and shuffle files go as soon as what they lead to has been written.
    with shuffles_dropped(spark):
        keyed, lows = text_keys(keyed)
        with scratch(spark):
            cover = _table(
                repeated_windows(keyed, lows, length, per_bucket)
                .groupBy("key").agg(F.collect_list(F.struct("start", "mask")).alias("gone")),
                cover_path,
            )
    of_text = lows.join(cover, "key", "left").withColumnRenamed("key", "of")
    # Only a text's first row needs its windows; the others find no partner, so that
    # copies do not meet at their key.
    first = (F.col("key") == F.col("of")) & (F.col("id") == F.col("low"))
    joined = keyed.join(of_text, first, "left").select(
        "own_id", "text", F.col("of").isNull().alias("copy"),
        F.col("gone.start").alias("starts"), F.col("gone.mask").alias("masks"),
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                n, gone, spans, kept = [], [], [], []
                for text, copy, starts, masks in zip(
                    _texts(part), part.column("copy").to_pylist(),
                    part.column("starts"), part.column("masks"),
                ):
                    left, removed, runs_ = text, 0, 0
                    if copy and len(text) >= length:
                        left, removed, runs_ = b"", len(text), 1
                    elif starts.is_valid and len(starts):
                        change = np.zeros(len(text) + 1, np.int64)
                        mask = masks.values.to_numpy()[:, None] >> np.arange(length) & 1
                        row, step = np.nonzero(mask)
                        at = starts.values.to_numpy()[row] + step
                        np.add.at(change, at, 1)
                        np.add.at(change, at + length, -1)
                        covered = np.cumsum(change[:-1]) > 0
                        left = np.frombuffer(text, np.uint8)[~covered].tobytes()
                        removed = int(covered.sum())
                        runs_ = int(covered[0]) + int(((covered[1:]) & ~covered[:-1]).sum())
                    n.append(len(text))
                    gone.append(removed)
                    spans.append(runs_)
                    kept.append(left)
                yield pa.RecordBatch.from_arrays(
                    [part.column("own_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_text"],
                )

    kind = joined.schema["own_id"].dataType.simpleString()
    return joined.mapInArrow(
        remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_text binary"
    ).withColumnRenamed("id", id_column)
