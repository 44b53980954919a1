"""Token ids of whole texts, computed once per different word.

The tokenizer drops white space and treats every run between white space alone,
so a text's ids are the ids of its words one after the other.  Words are collected
and numbered with Arrow, and only words not seen before are encoded.

Words of printable ASCII and Latin letters take a byte-pair encoder loaded with the
tokenizer's own vocabulary; it gives the ids of the ``tokenizers`` library (tested)
in a fraction of the time.  All other words go to the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = b"\xff"  # never part of UTF-8, stands for the end of a word

# Fixed values of the tokenizer file: its word pattern and its word end.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# Words of these characters mean the same to both encoders.
PLAIN = r"^[\x21-\x7EÀ-ÖØ-öø-ɏ]+$"

# Words a worker remembers; later ones are encoded when they come.
REMEMBERED = 300_000


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of words for one tokenizer file."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")
        alphabet = _byte_of_symbol()
        ranks = {}
        for symbol, token in spec["model"]["vocab"].items():
            if symbol in special:
                continue
            core = symbol.removesuffix(WORD_END)
            end = END if core != symbol else b""
            ranks[bytes(alphabet[c] for c in core) + end] = token
        self.encode_piece = tiktoken.Encoding(
            "words", pat_str=".+", mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_single_piece
        self.pieces = regex.compile(WORDS)
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(0, np.int64)

    def _encode_plain(self, words: list[str]) -> list[list[int]]:
        text = unicodedata.normalize("NFC", "\n".join(words)).lower()
        piece, find = self.encode_piece, self.pieces.findall
        return [
            [i for p in find(word) for i in piece(p.encode() + END)]
            for word in text.split("\n")
        ]

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and where each word ends."""
        plain = pc.match_substring_regex(words, PLAIN)
        if self.special.search("\n".join(words.to_pylist())):
            marked = pc.match_substring_regex(words, self.special.pattern)
            plain = pc.and_(plain, pc.invert(marked))
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        out: list = [None] * len(words)
        for at, ids in zip(
            np.flatnonzero(is_plain),
            self._encode_plain(words.filter(plain).to_pylist()) if is_plain.any() else [],
        ):
            out[at] = ids
        rest = np.flatnonzero(~is_plain)
        if len(rest):
            texts = words.take(pa.array(rest)).to_pylist()
            for at, encoded in zip(
                rest, self.library.encode_batch(texts, add_special_tokens=False)
            ):
                out[at] = encoded.ids
        ends = np.cumsum([len(ids) for ids in out], dtype=np.int64)
        flat = np.fromiter((i for ids in out for i in ids), np.uint32, ends[-1] if len(ends) else 0)
        return flat, ends

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts one after the other, and where each text ends."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = pc.dictionary_encode(words.flatten())
        distinct = numbered.dictionary
        at = pc.index_in(distinct, value_set=self.known)
        fresh = distinct.filter(pc.is_null(at))
        new_ids, new_ends = self._encode(fresh)
        ids = np.concatenate([self.ids, new_ids])
        shift = self.ends[-1] if len(self.ends) else 0
        ends = np.concatenate([self.ends, new_ends + shift])
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(fresh))
        if len(self.known) + len(fresh) <= REMEMBERED:
            self.known = pa.concat_arrays([self.known, fresh])
            self.ids, self.ends = ids, ends
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        of_word = place[numbered.indices.to_numpy(zero_copy_only=False)]
        lengths = (ends - starts)[of_word]
        through = np.cumsum(lengths)
        # Position of every id: word start plus the step inside the word.
        total = int(through[-1]) if len(through) else 0
        steps = np.arange(total) - np.repeat(through - lengths, lengths)
        flat = ids[np.repeat(starts[of_word], lengths) + steps]
        offsets = words.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        through = np.concatenate([[0], through])
        return flat, through[offsets[1:] - offsets[0]]


def encoder(path: str) -> WordEncoder:
    """An encoder; every task makes its own, so that nothing has to be imported by name."""
    return WordEncoder(path)
