"""Presence features of words, computed once per different word of a batch."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Beginnings of words of these lengths are features, besides the words.
PREFIXES = (3, 4, 5)

# What is cut from both ends of a word.
MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))

# Characters of text handled at a time.
BATCH_CHARS = 1_000_000


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself, its beginnings, its trailing marks, capitals."""
    core = word.strip(MARKS)
    low = core.lower()
    names = [low[:k] for k in PREFIXES if len(low) > k] if low else []
    if low:
        names.append(low + "$")
    marks = word[len(word.rstrip(MARKS)):]
    if len(marks) > 1 or not low:
        names.append("~" + marks[:4])
    if len(core) > 2 and core.isupper():
        names.append("^")
    return [zlib.crc32(n.encode()) for n in names]


def parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``BATCH_CHARS`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    through = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(through // BATCH_CHARS)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def presence(
    texts: pa.Array, wanted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Which text has which features: pairs (text, feature), each once, sorted.

    With ``wanted`` (sorted hashes) only those, as positions in ``wanted``.
    """
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    numbered = pc.dictionary_encode(words.flatten())
    found = [word_features(w) for w in numbered.dictionary.to_pylist()]
    counts = np.array([len(f) for f in found], np.int64)
    flat = np.fromiter((h for f in found for h in f), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(found)), counts)
    if wanted is not None:
        at = np.searchsorted(wanted, flat)
        at[at == len(wanted)] = 0
        hit = wanted[at] == flat if len(wanted) else np.zeros(len(flat), bool)
        owner, flat = owner[hit], at[hit]
    per_word = np.bincount(owner, minlength=len(found))
    starts = np.cumsum(per_word) - per_word
    offsets = words.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    of_text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    word = numbered.indices.to_numpy(zero_copy_only=False)
    busy = per_word[word] > 0
    of_text, word = of_text[busy], word[busy]
    pairs = np.unique(of_text * (len(found) + 1) + word)
    of_text, word = pairs // (len(found) + 1), pairs % (len(found) + 1)
    n = per_word[word]
    through = np.cumsum(n)
    total = int(through[-1]) if len(through) else 0
    step = np.arange(total) - np.repeat(through - n, n)
    both = np.unique(
        np.repeat(of_text, n) << 32 | flat[np.repeat(starts[word], n) + step]
    )
    return both >> 32, both & 0xFFFFFFFF
