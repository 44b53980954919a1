"""Burrows-Wheeler transforms of shards, merged by interleave refinement.

Pure array code over a bounded number of bytes; Spark decides what meets here.
"""

from __future__ import annotations

import numpy as np

SHARD_BYTES = 1 << 16

# Symbols of the first key of a shard: seven of nine bits fit a whole number.
FIRST = 7


def shard_transform(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` sorted by at least their first ``depth`` symbols.

    Symbol zero ends a string and sorts first; suffixes that agree up to there are
    equal and come in any order.  Prefix doubling from seven symbols on.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    for k in range(FIRST):
        symbol = np.zeros(n, np.int64)
        symbol[: max(n - k, 0)] = text[k:]
        symbol[~open_] = 0  # nothing behind the end of a string counts
        open_ &= symbol != 0
        key = key << 9 | symbol
    # A suffix that ends inside its key equals all with that key.
    step = FIRST
    while True:
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.concatenate([[1], 1 + np.cumsum(ranked[1:] != ranked[:-1])])[:n]
        if step >= depth or not n or fresh[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        after[~open_] = 0
        further = np.zeros(n, bool)
        further[: max(n - step, 0)] = open_[step:]
        open_ &= further
        key = rank * (n + 1) + after
        step *= 2


def merge(strings: list[bytes], depth: int, shard_bytes: int = SHARD_BYTES):
    """Suffixes of all strings with a common prefix of at least ``depth`` bytes.

    The strings are dealt into shards, each with its own transform.  The transforms
    are then interleaved: in every round the rows, in their present order, are dealt
    out by the two bytes before them, which sorts the merged rows by two bytes more.
    Rows stay in one block only while they came out of one block by the same bytes, so
    the blocks of a round are the rows that share the bytes compared so far: after
    ``depth`` bytes they are the intervals.

    Returns for every start of a suffix of ``depth`` bytes: the string's number, the
    position inside it, and the number of the interval of equal prefixes.
    """
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    raw = np.frombuffer(b"\x00".join([*strings, b""]), np.uint8)
    # The bytes there are, numbered from one on; zero is the end mark.
    there = np.zeros(256, bool)
    there[raw] = True
    number = np.cumsum(there)
    text = number[raw]
    text[np.cumsum(sizes) - 1] = 0
    n_symbols = int(number[-1]) + 1
    pair_kind = np.uint16 if n_symbols**2 <= 1 << 16 else np.uint32
    cut = np.concatenate([[0], 1 + np.flatnonzero(
        np.diff((np.cumsum(sizes) - 1) // shard_bytes)
    ), [len(sizes)]])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n_shards = len(cut) - 1
    shard_kind = np.uint8 if n_shards <= 1 << 8 else np.uint32
    rows, before, shard = [], [], []
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        lo, hi = starts[a], starts[b]
        own = text[lo:hi]
        order = shard_transform(own, depth + 1)
        rows.append(order + lo)
        # A shard is a ring: the bytes before its first one are its last ones.
        pairs = np.roll(own, 2) * n_symbols + np.roll(own, 1)
        before.append(pairs[order].astype(pair_kind))
        shard.append(np.full(hi - lo, k, shard_kind))
    rows, before = np.concatenate(rows), np.concatenate(before)
    interleave = np.concatenate(shard)
    block = np.zeros(len(rows), np.int32)
    settled = n_shards == 1
    # The same bytes are dealt out in every round, so their borders stay.
    edges = _edges(before)
    for done in range(0, depth, 2):
        if not settled or done == 0:
            # The i-th row of a shard in the present order is its i-th.
            place = np.argsort(interleave, kind="stable")
            pairs = np.empty(len(before), pair_kind)
            pairs[place] = before
        one = done + 1 == depth  # an odd depth ends with the last byte alone
        if one:
            pairs = pairs % n_symbols
            edges = _edges(pairs)
        if not settled or done == 0 or one:
            order = np.argsort(pairs, kind="stable")
        block = block[order]
        new = np.zeros(len(block), bool)
        np.not_equal(block[1:], block[:-1], out=new[1:])
        new[edges] = True
        block = np.cumsum(new, dtype=np.int32)
        if not settled or one:
            following = interleave[order]
            settled = np.array_equal(following, interleave)
            interleave = following
    merged = np.empty(len(rows), np.int64)
    merged[np.argsort(interleave, kind="stable")] = rows
    # Suffixes that end before have met an end mark; their blocks say nothing.
    owner = np.repeat(np.arange(len(sizes)), sizes)[merged]
    long = starts[owner + 1] - 1 - merged >= depth
    merged, owner, block = merged[long], owner[long], block[long]
    number = np.cumsum(np.append(False, block[1:] != block[:-1])[: len(block)])
    return owner, merged - starts[owner], number


def _edges(numbers: np.ndarray) -> np.ndarray:
    """Where other numbers begin once they are sorted."""
    ends = np.cumsum(np.bincount(numbers))[:-1]
    return np.unique(ends[ends > 0])
