"""Words of letters and digits, found in the bytes of many texts at once.

A word is a run of ASCII letters, ASCII digits and characters beyond ASCII; A to Z are
lowered.  Bytes of characters beyond ASCII are all 128 or more, so UTF-8 needs no decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = True
IN_WORD[ord("a") : ord("z") + 1] = True
IN_WORD[128:] = True


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words one after the other, and where each text's words end; NULL has none."""
    texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(data, np.uint8, last - first, first)
    offsets = offsets - first
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # A text that starts inside a run of the one before starts a word of its own.
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    before = np.cumsum(inside) - inside
    ends = np.append(before[starts], int(inside.sum()))
    found = pa.Array.from_buffers(
        pa.large_string(), len(starts),
        [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])],
    )
    return found, np.searchsorted(starts, offsets[1:])
